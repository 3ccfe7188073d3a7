"""DuckDB SQL for the registered queries, written as joins and windows over long tables.

The texts are put together from named common table expressions; `sql(name, ...)` lists those a query
needs, in order.
"""

from __future__ import annotations

from formwright.plans import catalog
from formwright.sources.synthetic import EXAMPLE_TEXTS, EXAMPLE_TOKENS

# Fixed values, written out apart from those of the package, so that a wrong one there shows.
DOCUMENT_TYPES = ("W-2", "1099-R", "1099-MISC", "1099-DIV", "Receipt", "Bank Statement", "1040", "Schedule A")
FIELD_TYPES = (
    "SSN", "EMPLOYER_NAME", "WAGE_AMOUNT", "TAX_WITHHELD", "ADDRESS", "DATE", "EMPLOYER_EIN", "EMPLOYEE_NAME",
    "FEDERAL_TAX", "STATE_TAX", "SOCIAL_SECURITY_TAX", "MEDICARE_TAX", "ACCOUNT_NUMBER", "ROUTING_NUMBER",
    "PHONE_NUMBER", "EMAIL",
)
BIO_TAGS = ("O", *(f"{mark}-{name}" for name in FIELD_TYPES for mark in "BI"))
CLASSIFIER_TOKEN_LIMIT = 512
SSN_PATTERNS = (r"\b\d{3}-?\d{2}-?\d{4}\b",)
EIN_PATTERNS = (r"\b\d{2}-?\d{7}\b",)
AMOUNT_PATTERNS = (r"\$[\d,]+\.?\d*", r"\b\d{1,3}(?:,\d{3})*\.?\d*\b")
DATE_PATTERNS = (
    r"\b\d{1,2}/\d{1,2}/\d{4}\b",
    r"\b\d{1,2}-\d{1,2}-\d{4}\b",
    r"\b\d{4}-\d{1,2}-\d{1,2}\b",
    r"\b(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]* \d{1,2},? \d{4}\b",
)

SQL: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def values(rows) -> str:
    return ", ".join(
        "(" + ", ".join(quoted(x) if isinstance(x, str) else str(x) for x in row) + ")" for row in rows
    )


CTE: dict[str, str] = {}

CTE["types"] = f"types(label_id, doc_type) AS (VALUES {values(enumerate(DOCUMENT_TYPES))})"
CTE["fieldtypes"] = f"fieldtypes(type_ord, field_name) AS (VALUES {values(enumerate(FIELD_TYPES))})"

CTE["docs"] = """
titles(t, title) AS (VALUES (0, 'W-2 Wage and Tax Statement'), (1, '1099-R Distributions From Pensions'),
  (2, '1099-MISC Miscellaneous Income'), (3, '1099-DIV Dividends and Distributions'),
  (4, 'Receipt Business expense'), (5, 'Bank Statement'),
  (6, '1040 U.S. Individual Income Tax Return'), (7, 'Schedule A Itemized Deductions')),
parts AS (
  SELECT o_orderkey AS k, (o_orderkey % 8)::INT AS t, o_orderdate AS od,
    'Customer ' || o_orderkey AS name,
    lpad(((7919 * o_orderkey + 13) % 1000)::VARCHAR, 3, '0') || '-' ||
      lpad(((31 * o_orderkey + 7) % 100)::VARCHAR, 2, '0') || '-' ||
      lpad(((104729 * o_orderkey + 1) % 10000)::VARCHAR, 4, '0') AS ssn,
    lpad((17 * o_orderkey % 100)::VARCHAR, 2, '0') || '-' ||
      lpad((999983 * o_orderkey % 10000000)::VARCHAR, 7, '0') AS ein,
    '$' || format('{:,}', (4241 * o_orderkey % 200000000) // 100) || '.' ||
      lpad((4241 * o_orderkey % 100)::VARCHAR, 2, '0') AS wages,
    strftime(o_orderdate, '%m/%d/%Y') AS day,
    lpad((21000021 * o_orderkey % 1000000000)::VARCHAR, 9, '0') AS routing
  FROM orders),
docs AS (
  SELECT parts.*, k AS doc_id, types.doc_type AS true_type,
    'Form ' || title || ' Name: ' || name || ' SSN: ' || ssn || ' EIN: ' || ein || ' Wages: ' || wages
      || ' Date: ' || day || ' Routing: ' || routing AS text
  FROM parts JOIN titles USING (t) JOIN types ON types.label_id = t)"""

CTE["pages"] = """
raw_docs AS (
  SELECT doc_id, replace(replace(text, ' SSN:', chr(10) || chr(10) || ' SSN:'), ' Wages:',
    chr(10) || 'Wages:') AS raw FROM docs),
raw_lines AS (
  SELECT doc_id, unnest(string_split(raw, chr(10))) AS line,
    (generate_subscripts(string_split(raw, chr(10)), 1) - 1)::INT AS i FROM raw_docs),
lines AS (
  SELECT doc_id, i AS line_no, trim(line) AS text,
    (70 + (doc_id * 7 + i * 13) % 30) / 100.0::DOUBLE AS confidence
  FROM raw_lines WHERE trim(line) <> '')"""

CTE["ocr"] = """
ocr AS (
  SELECT doc_id, string_agg(text, ' ' ORDER BY line_no) AS text,
    avg(confidence) AS ocr_confidence FROM lines GROUP BY doc_id)"""

CTE["ents"] = """
ents AS (
  SELECT doc_id, ord, grp AS entity_group, word, ((doc_id * 13 + ord * 29) % 100) / 100.0::DOUBLE AS score,
    CASE WHEN word <> 'noise' THEN instr(text, word) - 1 END AS s
  FROM (
    SELECT doc_id, text, 0 AS ord, 'PERSON' AS grp, name AS word FROM docs
    UNION ALL SELECT doc_id, text, 1, 'SSN', ssn FROM docs
    UNION ALL SELECT doc_id, text, 2, 'MISC', 'noise' FROM docs
    UNION ALL SELECT doc_id, text, 3, 'ssn', ssn FROM docs)),
model AS (
  SELECT doc_id, ord, field_name, word AS value, score AS confidence, s::INT AS start_,
    (s + length(word))::INT AS end_
  FROM (SELECT *, CASE upper(entity_group) WHEN 'PERSON' THEN 'EMPLOYEE_NAME'
      WHEN 'ORG' THEN 'EMPLOYER_NAME' WHEN 'MONEY' THEN 'WAGE_AMOUNT' WHEN 'LOC' THEN 'ADDRESS'
      WHEN 'PHONE' THEN 'PHONE_NUMBER' ELSE upper(entity_group) END AS field_name FROM ents)
  WHERE field_name IN (SELECT field_name FROM fieldtypes))"""


def hits(source: str, *groups: tuple[str, float, tuple[str, ...], str]) -> str:
    """Matches of patterns over `source` (doc_id, text) with their offsets."""
    parts = []
    for field, confidence, patterns, flags in groups:
        for number, pattern in enumerate(patterns):
            p = quoted(flags + pattern)
            parts.append(
                f"SELECT doc_id, '{field}' AS field_name, {confidence}::DOUBLE AS confidence, "
                f"{number} AS pat, regexp_extract_all(text, {p}) AS ms, "
                f"regexp_split_to_array(text, {p}) AS gs FROM {source}"
            )
    return (
        "hits AS (" + " UNION ALL ".join(parts) + "),\n"
        "located AS (SELECT doc_id, field_name, confidence, pat, pos, ms[pos] AS value, "
        "(list_sum(list_transform(gs[1:pos], lambda g: length(g))) + "
        "coalesce(list_sum(list_transform(ms[1:pos - 1], lambda m: length(m))), 0))::INT AS start_ "
        "FROM (SELECT *, unnest(range(1, len(ms) + 1)) AS pos FROM hits)),\n"
        "digits9 AS (SELECT *, regexp_replace(value, '[^0-9]', '', 'g') AS d FROM located),\n"
        "cands AS (SELECT doc_id, field_name, value, confidence, pat, pos, start_, "
        "(start_ + length(value))::INT AS end_, "
        "(row_number() OVER (PARTITION BY doc_id, field_name ORDER BY pat, pos) - 1)::INT AS arrival "
        "FROM digits9 WHERE NOT (field_name = 'EMPLOYER_EIN' AND length(d) = 9 "
        "AND d[1:3] NOT IN ('000', '666') AND d[1:1] <> '9' AND d[4:5] <> '00' AND d[6:9] <> '0000'))"
    )


SSN = ("SSN", 0.9, SSN_PATTERNS, "")
AMOUNT = ("WAGE_AMOUNT", 0.8, AMOUNT_PATTERNS, "")
DATE = ("DATE", 0.8, DATE_PATTERNS, "(?i)")
EIN = ("EMPLOYER_EIN", 0.7, EIN_PATTERNS, "")

CTE["cands"] = hits("docs", SSN, AMOUNT, DATE, EIN)

CTE["ranked"] = """
accepted AS (
  SELECT * FROM model WHERE confidence > 0.3::DOUBLE
  QUALIFY row_number() OVER (PARTITION BY doc_id, field_name, value ORDER BY ord) = 1),
fresh AS (
  SELECT * FROM cands c
  WHERE NOT EXISTS (SELECT 1 FROM model m WHERE m.doc_id = c.doc_id
    AND m.field_name = c.field_name AND m.value = c.value)
  QUALIFY row_number() OVER (PARTITION BY doc_id, field_name, value ORDER BY pat, pos) = 1),
fields AS (
  SELECT doc_id, field_name, value, confidence, start_, end_, 0 AS src, ord AS o1, 0 AS o2 FROM accepted
  UNION ALL SELECT doc_id, field_name, value, confidence, start_, end_, 1, pat, pos FROM fresh),
ranked AS (
  SELECT f.*, type_ord, row_number() OVER (
    PARTITION BY doc_id, f.field_name ORDER BY confidence DESC, src, o1, o2)::INT AS field_rank
  FROM fields f JOIN fieldtypes USING (field_name))"""


def score_of(value: str, as_of: str) -> str:
    """Score of the stripped `value` under the rule of `field_name`."""
    d = f"regexp_replace({value}, '[^0-9]', '', 'g')"
    repeats = " OR ".join(
        f"{d}[{i}:{i + n - 1}] = {d}[{i + n}:{i + 2 * n - 1}]"
        for n in (2, 3, 4)
        for i in range(1, 9 - 2 * n + 2)
    )
    runs = " OR ".join(f"contains({d}, '{a}{a + 1}{a + 2}')" for a in range(8))
    plain = f"regexp_replace(regexp_replace({value}, '[$,]', '', 'g'), '^-', '')"
    number = (
        f"CASE WHEN regexp_full_match({plain}, '\\s*[+-]?([0-9](_?[0-9])*\\.?([0-9](_?[0-9])*)?"
        f"|\\.[0-9](_?[0-9])*)([eE][+-]?[0-9](_?[0-9])*)?\\s*') "
        f"OR regexp_full_match(lower({plain}), '\\s*[+-]?(inf|infinity|nan)\\s*') "
        f"THEN try_cast(replace({plain}, '_', '') AS DOUBLE) END"
    )
    # `%Y` is four digits; DuckDB alone would read two-digit years with it as well.
    day = (
        f"coalesce(CASE WHEN regexp_matches({value}, '[0-9]{{4}}') THEN try_strptime({value}, "
        "['%m/%d/%Y', '%m-%d-%Y', '%Y-%m-%d', '%B %d, %Y', '%b %d, %Y', '%d %B %Y', '%d %b %Y']) END, "
        f"try_strptime({value}, ['%m/%d/%y', '%m-%d-%y', '%y-%m-%d']))::DATE"
    )
    checksum = "(" + " + ".join(
        f"{w} * try_cast({d}[{i}:{i}] AS INT)" for i, w in enumerate((3, 7, 1) * 3, 1)
    ) + ") % 10"
    amounts = (
        "'WAGE_AMOUNT', 'TAX_WITHHELD', 'FEDERAL_TAX', 'STATE_TAX', 'SOCIAL_SECURITY_TAX', "
        "'MEDICARE_TAX'"
    )
    special = f"length(regexp_replace({value}, '[^.,''-]', '', 'g'))"
    return f"""(CASE
  WHEN coalesce({value}, '') = '' THEN 0
  WHEN field_name = 'SSN' THEN CASE
    WHEN length({d}) <> 9 OR {d}[1:3] IN ('000', '666') OR {d}[1:1] = '9' OR {d}[4:5] = '00'
      OR {d}[6:9] = '0000' THEN 0
    WHEN {runs} THEN 0.2 WHEN {repeats} THEN 0.3 ELSE 0.9 END
  WHEN field_name = 'EMPLOYER_EIN' THEN CASE WHEN length({d}) <> 9 THEN 0
    WHEN {d}[1:2]::INT NOT BETWEEN 10 AND 98 THEN 0.3 ELSE 0.8 END
  WHEN field_name IN ({amounts}) THEN CASE WHEN {number} IS NULL THEN 0.1
    WHEN isnan({number}) THEN 0.9
    WHEN {number} < 0 THEN 0.3 WHEN {number} > 10000000 THEN 0.2
    WHEN contains({plain}, '.') AND length(split_part({plain}, '.', 2)) > 2 THEN 0.4 ELSE 0.9 END
  WHEN field_name = 'DATE' THEN CASE WHEN {day} IS NULL THEN 0
    WHEN year({day}) < 1900 OR year({day}) > year(DATE '{as_of}') + 1 THEN 0.2
    WHEN {day} > DATE '{as_of}' THEN 0.6 ELSE 0.9 END
  WHEN field_name = 'PHONE_NUMBER' THEN CASE WHEN length({d}) = 10 THEN 0.9
    WHEN length({d}) = 11 AND {d}[1:1] = '1' THEN 0.8 ELSE 0.2 END
  WHEN field_name = 'EMAIL' THEN CASE
    WHEN regexp_full_match({value}, '[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\\.[a-zA-Z]{{2,}}') THEN 0.9
    ELSE 0.1 END
  WHEN field_name = 'ACCOUNT_NUMBER' THEN CASE WHEN length({d}) BETWEEN 8 AND 17 THEN 0.8 ELSE 0.3 END
  WHEN field_name = 'ROUTING_NUMBER' THEN CASE WHEN length({d}) <> 9 THEN 0.1
    WHEN {checksum} = 0 THEN 0.9 ELSE 0.6 END
  WHEN field_name IN ('EMPLOYER_NAME', 'EMPLOYEE_NAME') THEN CASE WHEN length({value}) < 2 THEN 0.1
    WHEN NOT regexp_full_match({value}, '[A-Za-z\\s.,''-]+') THEN 0.2
    WHEN {special} > length({value}) * 0.3::DOUBLE THEN 0.3 ELSE 0.8 END
  WHEN field_name = 'ADDRESS' THEN CASE WHEN length({value}) < 10 THEN 0.2
    WHEN regexp_matches({value}, '[0-9]') THEN 0.7 ELSE 0.3 END
  ELSE 0.5 END)::DOUBLE"""


def scored(source: str, w=(0.3, 0.4, 0.3), ocr: str = "ocr_confidence") -> str:
    a, b, c = w
    return (
        f"validated AS (SELECT *, {score_of('value', catalog.AS_OF)} AS validation_score FROM ranked),\n"
        f"scored AS (SELECT v.*, {ocr} AS source_confidence, "
        f"least({ocr} * {a}::DOUBLE + confidence * {b}::DOUBLE + validation_score * {c}::DOUBLE, "
        f"1::DOUBLE) AS composite FROM validated v JOIN {source} USING (doc_id)),\n"
        "summaries AS (SELECT d.doc_id, count(composite) AS n, coalesce(avg(composite), 0) AS mean, "
        "count(*) FILTER (composite >= 0.8::DOUBLE) AS high, "
        "count(*) FILTER (composite >= 0.5::DOUBLE AND composite < 0.8::DOUBLE) AS medium, "
        "count(*) FILTER (composite < 0.5::DOUBLE) AS low, stddev_pop(composite) AS std, "
        "count(*) FILTER (composite > 0.8::DOUBLE) AS n_high "
        "FROM docs d LEFT JOIN scored USING (doc_id) GROUP BY d.doc_id)"
    )


CTE["scored"] = scored("ocr")
CTE["missing"] = """
missing AS (
  SELECT d.doc_id, c.field_name, c.o FROM docs d
  CROSS JOIN (VALUES (0, 'SSN'), (1, 'WAGE_AMOUNT'), (2, 'EMPLOYER_NAME')) c(o, field_name)
  WHERE NOT EXISTS (SELECT 1 FROM scored s WHERE s.doc_id = d.doc_id AND s.field_name = c.field_name
    AND s.composite > 0.5::DOUBLE))"""

CTE["samples"] = f"""
examples(label_id, e, base) AS (VALUES {values((i, j, text) for i, texts in enumerate(EXAMPLE_TEXTS)
    for j, text in enumerate(texts))}),
samples AS (
  SELECT o_orderkey AS sample_id, label_id, CASE o_orderkey % 7 WHEN 0 THEN base WHEN 1 THEN upper(base)
    WHEN 2 THEN lower(base) WHEN 3 THEN base || ' Additional information here.'
    WHEN 4 THEN 'Document: ' || base WHEN 5 THEN replace(base, '2023', '2024')
    ELSE replace(base, '$', 'USD ') END AS text
  FROM orders JOIN examples ON label_id = o_orderkey % 8 AND e = o_orderkey % 3)"""

CTE["weights"] = """
sample_words AS (
  SELECT label_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS token FROM samples),
sample_tokens AS (SELECT label_id, ('0x' || substr(md5(token), 1, 4))::INT % 16384 AS token FROM sample_words),
vocab AS (SELECT DISTINCT token FROM sample_tokens),
token_n AS (SELECT token, label_id, count(*) AS n FROM sample_tokens GROUP BY ALL),
label_n AS (SELECT label_id, count(*) AS n FROM sample_tokens GROUP BY ALL),
weights AS (
  SELECT v.token, t.label_id, ln((coalesce(x.n, 0) + 1) /
    (coalesce(l.n, 0) + (SELECT count(*) FROM vocab))::DOUBLE) AS weight
  FROM vocab v CROSS JOIN types t LEFT JOIN token_n x ON x.token = v.token AND x.label_id = t.label_id
  LEFT JOIN label_n l ON l.label_id = t.label_id),
priors AS (
  SELECT t.label_id, t.doc_type, ln((count(s.sample_id) + 1) /
    ((SELECT count(*) FROM samples) + 8)::DOUBLE) AS prior
  FROM types t LEFT JOIN samples s ON s.label_id = t.label_id GROUP BY ALL)"""


def classified(source: str, limit: int | None = None) -> str:
    cut = f"[1:{limit}]" if limit else ""
    return (
        "doc_words AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), "
        f"'[\\p{{L}}\\p{{N}}]+'){cut}) AS token FROM {source}),\n"
        "doc_tokens AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 4))::INT % 16384 AS token FROM doc_words),\n"
        "doc_sums AS (SELECT doc_id, label_id, sum(weight) AS s FROM doc_tokens JOIN weights "
        "USING (token) GROUP BY ALL),\n"
        f"logits AS (SELECT d.doc_id, p.label_id, p.doc_type, prior + coalesce(s, 0) AS x "
        f"FROM {source} d CROSS JOIN priors p LEFT JOIN doc_sums x ON x.doc_id = d.doc_id "
        "AND x.label_id = p.label_id),\n"
        "shifted AS (SELECT *, exp(x - max(x) OVER (PARTITION BY doc_id)) AS e FROM logits),\n"
        "probs AS (SELECT doc_id, label_id, doc_type, e / sum(e) OVER (PARTITION BY doc_id) AS p "
        "FROM shifted),\n"
        "classified AS (SELECT doc_id, doc_type AS document_type, p AS classification_confidence "
        "FROM probs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_id) = 1)"
    )


CTE["classified"] = classified("docs")
NB = ("samples", "weights", "classified")

CTE["truth"] = """
truth AS (
  SELECT doc_id, field_name, value, (instr(text, value) - 1)::INT AS start_,
    (instr(text, value) - 1 + length(value))::INT AS end_
  FROM (SELECT doc_id, text, 'SSN' AS field_name, ssn AS value FROM docs
    UNION ALL SELECT doc_id, text, 'WAGE_AMOUNT', wages FROM docs
    UNION ALL SELECT doc_id, text, 'EMPLOYEE_NAME', name FROM docs
    UNION ALL SELECT doc_id, text, 'DATE', day FROM docs WHERE doc_id % 10 <> 0))"""

CTE["matches"] = """
pred AS (SELECT DISTINCT doc_id, field_name, value, coalesce(start_, 0)::INT AS start_,
  coalesce(end_, length(value))::INT AS end_ FROM ranked),
matches AS (
  SELECT coalesce(p.doc_id, t.doc_id) AS doc_id, coalesce(p.field_name, t.field_name) AS field_name,
    coalesce(p.value, t.value) AS value, coalesce(p.start_, t.start_)::INT AS start_,
    coalesce(p.end_, t.end_)::INT AS end_, (p.doc_id IS NOT NULL)::INT AS in_pred,
    (t.doc_id IS NOT NULL)::INT AS in_true
  FROM pred p FULL JOIN (SELECT DISTINCT * FROM truth) t ON p.doc_id = t.doc_id
    AND p.field_name = t.field_name AND p.value = t.value AND p.start_ = t.start_ AND p.end_ = t.end_)"""

CTE["runs"] = """
runs AS (
  SELECT d.*, 'docs/' || k || '.jpg' AS path, x.doc_type AS expected_type,
    (k * 53 % 1200) / 100.0::DOUBLE AS seconds, CASE WHEN k % 4 <> 0 THEN k % 3 END AS corrections,
    CASE WHEN k % 97 = 0 THEN 'unreadable' END AS error, q.doc_type AS pred_type,
    (k * 37 % 100) / 100.0::DOUBLE AS pred_confidence
  FROM docs d JOIN types x ON x.label_id = CASE WHEN k % 7 = 0 THEN (t + 1) % 8 ELSE t END
    JOIN types q ON q.label_id = CASE WHEN k % 5 = 0 THEN (t + 1) % 8 ELSE t END)"""


def per_class(source: str) -> str:
    """Measures per class of `source` (true_label, pred_label)."""
    return (
        f"class_n AS (SELECT doc_type AS label, "
        f"(SELECT count(*) FROM {source} WHERE true_label = doc_type AND pred_label = doc_type) AS tp, "
        f"(SELECT count(*) FROM {source} WHERE pred_label = doc_type) AS n_pred, "
        f"(SELECT count(*) FROM {source} WHERE true_label = doc_type) AS support FROM types),\n"
        "class_pr AS (SELECT label, support, coalesce(tp / nullif(n_pred, 0)::DOUBLE, 0) AS p, "
        "coalesce(tp / nullif(support, 0)::DOUBLE, 0) AS r FROM class_n),\n"
        "per_class AS (SELECT label, p AS precision, r AS recall, "
        "coalesce(2 * p * r / nullif(p + r, 0), 0) AS f1, support FROM class_pr),\n"
        f"overall AS (SELECT (SELECT avg((true_label = pred_label)::INT) FROM {source}) AS accuracy, "
        "sum(precision * support) / sum(support) AS precision, "
        "sum(recall * support) / sum(support) AS recall, sum(f1 * support) / sum(support) AS f1, "
        "sum(support)::BIGINT AS total_samples FROM per_class)"
    )


CTE["preds"] = "preds AS (SELECT true_type AS true_label, pred_type AS pred_label FROM runs)"
CTE["per_class"] = per_class("preds")

CTE["ner"] = """
ner AS (
  SELECT sum(in_pred * in_true)::BIGINT AS tp, sum(in_pred * (1 - in_true))::BIGINT AS fp,
    sum((1 - in_pred) * in_true)::BIGINT AS fn FROM matches),
ner_scores AS (
  SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p,
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r FROM ner)"""

CTE["run_sums"] = """
run_sums AS (
  SELECT avg(seconds) AS average_time, stddev_pop(seconds) AS time_std, min(seconds) AS min_time,
    max(seconds) AS max_time, avg(mean) AS average_confidence, stddev_pop(mean) AS confidence_std,
    sum(n)::BIGINT AS total_fields_extracted, sum(n_high)::BIGINT AS high_confidence_fields,
    sum(coalesce(corrections, 0))::BIGINT AS total_corrections, count(*) AS total_documents,
    sum(n_high) / sum(n)::DOUBLE AS field_accuracy,
    sum(coalesce(corrections, 0)) / count(*)::DOUBLE AS correction_rate
  FROM runs JOIN summaries USING (doc_id) WHERE error IS NULL),
bvs AS (
  SELECT greatest(0, 1 - average_time / 10) AS speed_score, average_confidence AS confidence_score,
    least(1, total_fields_extracted / (total_documents * 10)::DOUBLE) AS field_score,
    greatest(0, 1 - correction_rate) AS correction_score FROM run_sums),
bv AS (SELECT *, (speed_score + confidence_score + field_score + correction_score) / 4
  AS business_value_score FROM bvs)"""


def tag_list(index: int) -> str:
    return "CASE o_orderkey % 8 " + " ".join(
        f"WHEN {i} THEN [{', '.join(quoted(w) for w in example[index])}]"
        for i, example in enumerate(EXAMPLE_TOKENS)
    ) + " END"


CTE["sequences"] = f"""
bases AS (SELECT o_orderkey AS seq_id, o_orderkey % 5 AS v, {tag_list(0)} AS tk, {tag_list(1)} AS tg
  FROM orders),
varied AS (
  SELECT seq_id, v, CASE v WHEN 1 THEN list_transform(tk, lambda x: upper(x))
      WHEN 2 THEN list_transform(tk, lambda x: lower(x)) WHEN 3 THEN tk || ['Additional', 'text']
      WHEN 4 THEN ['Document', ':'] || tk ELSE tk END AS tokens,
    CASE WHEN v = 4 THEN ['O', 'O'] || tg ELSE tg[1:len(tk)] END AS tags FROM bases),
token_rows AS (
  SELECT seq_id, v, (pos - 1)::INT AS pos, tokens[pos] AS token, tags[pos] AS tag
  FROM (SELECT *, unnest(range(1, len(tokens) + 1)) AS pos FROM varied))"""

CTE["tag_ids"] = f"""
tag_ids(id, name) AS (VALUES {values(enumerate(BIO_TAGS))}),
encoded AS (
  SELECT seq_id, pos, token, CASE WHEN tag IS NULL THEN -100 ELSE coalesce(id, 0) END::INT AS label_id
  FROM token_rows LEFT JOIN tag_ids ON name = CASE WHEN v = 2 THEN lower(tag) ELSE tag END)"""


def sql(name: str, ctes: str, body: str, **extra: str) -> None:
    """Registers the SQL of a query; `ctes` names its parts in order, `extra` replaces some."""
    parts = [extra.get(cte) or CTE[cte] for cte in ctes.split()]
    SQL[name] = ("WITH " + ",\n".join(p.strip() for p in parts) + "\n" if parts else "") + body.strip()


DOCS = "types docs"
RANKED = "types fieldtypes docs ents cands ranked"
SCORED = "types fieldtypes docs pages ocr ents cands ranked scored"

sql("ocr_lines", DOCS + " pages", """
SELECT doc_id, i AS line_no, trim(line) AS text, 0.9::DOUBLE AS confidence, 0::DOUBLE AS box_left,
  (20 * i)::DOUBLE AS box_top, (10 * length(line))::DOUBLE AS box_right, (20 * (i + 1))::DOUBLE AS box_bottom
FROM raw_lines WHERE trim(line) <> ''""")
sql("assemble_text", DOCS + " pages ocr",
    "SELECT doc_id, text, round(ocr_confidence, 6) AS ocr_confidence FROM ocr")
sql("text_only_sources", DOCS + " pages ocr", """
SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN o.text WHEN doc_id % 5 > 0 THEN d.text END AS text,
  CASE WHEN doc_id % 3 > 0 THEN round(ocr_confidence, 6) ELSE 0.8::DOUBLE END AS ocr_confidence
FROM docs d JOIN ocr o USING (doc_id)""")
sql("nested_entities", DOCS + " ents", """
SELECT doc_id, upper(entity_group) AS entity_group, word, round(arg_min(score, ord), 6) AS score
FROM ents WHERE score > 0.3 AND NOT (ord = 1 AND doc_id % 2 = 0) GROUP BY 1, 2, 3""")
sql("hook_entities", DOCS, """
SELECT doc_id, doc_id + 9007199254740993 AS big,
  CASE WHEN sevens <= 6 THEN regexp_extract(text, '[0-9]+') END AS word,
  CASE WHEN sevens > 6 THEN 'too many sevens' END AS error
FROM (SELECT *, length(text) - length(replace(text, '7', '')) AS sevens FROM docs)""")
sql("label_checks", "", """
SELECT problem, count(*) AS n FROM (SELECT CASE
  WHEN o_orderkey % 19 = 0 THEN 'texts and labels must have same length'
  WHEN o_orderkey % 17 = 0 THEN 'labels must be integers'
  WHEN o_orderkey % 13 = 0 THEN 'labels must be 0-7' END AS problem FROM orders)
WHERE problem IS NOT NULL GROUP BY problem""")
sql("synthetic_docs", "samples", "SELECT sample_id, label_id, text FROM samples")
sql("synthetic_tokens", "sequences",
    "SELECT seq_id, pos, token, coalesce(tag, 'O') AS tag FROM token_rows")
SQL["sequence_lines"] = SQL["synthetic_tokens"]
sql("quarantine", DOCS + " runs", """
SELECT doc_id, path, error, od::TIMESTAMP AS ts, 'failed' AS status FROM runs WHERE error IS NOT NULL""")
sql("path_list", "", """
SELECT 'scans/' || o_orderkey || '.png' AS path FROM orders WHERE o_orderkey % 4 <> 0""")
sql("missing_inputs", "", """
SELECT 'docs/' || o_orderkey || '.jpg' AS path,
  'Image file not found: docs/' || o_orderkey || '.jpg' AS error, 'failed' AS status
FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)""")
sql("classification_details", DOCS + " runs", """
SELECT doc_id AS sample_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text,
  true_type AS true_label, pred_type AS predicted_label, pred_confidence AS confidence,
  pred_type = true_type AS correct FROM runs""")
sql("ner_details", RANKED + " truth", """
SELECT d.doc_id AS sample_id, CASE WHEN length(text) > 200 THEN text[1:200] || '...' ELSE text END AS text,
  n_true::INT AS n_true, n_pred::INT AS n_pred, true_values, pred_values
FROM docs d
JOIN (SELECT doc_id, count(*) AS n_true, string_agg(value, '|' ORDER BY value) AS true_values
  FROM truth GROUP BY doc_id) USING (doc_id)
JOIN (SELECT doc_id, count(*) AS n_pred, string_agg(value, '|' ORDER BY value) AS pred_values
  FROM ranked GROUP BY doc_id) USING (doc_id)""")

sql("map_entities", "types fieldtypes docs ents", """
SELECT doc_id, ord::INT AS ord, field_name, value AS word, confidence AS score, start_ AS start,
  end_ AS "end" FROM model""")
EXTRACTED = """
SELECT doc_id, arrival, field_name, value, confidence, start_ AS start, end_ AS "end" FROM cands"""
sql("extract_ssn", DOCS + " cands", EXTRACTED, cands=hits("docs", SSN))
sql("extract_amounts", DOCS + " cands", EXTRACTED, cands=hits("docs", AMOUNT))
sql("extract_dates", DOCS + " cands", EXTRACTED, cands=hits("docs", DATE))
sql("extract_ein", DOCS + " cands", EXTRACTED, cands=hits("docs", EIN))
sql("extract_amounts_prose", "cands", """
SELECT doc_id, arrival, value, start_ AS start, end_ AS "end" FROM cands""",
    cands=hits("documents", AMOUNT))
VARIED = CTE["docs"].replace("\ndocs AS (", "\nplain_docs AS (") + """,
docs AS (SELECT * REPLACE (CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN ''
  WHEN 2 THEN 'Zoë Ñandú ' || text || ' – 漢字 DECEMBER 5, 2023 été'
  WHEN 3 THEN replace(text, day, strftime(od, '%m-%d-%Y')) WHEN 4 THEN replace(text, day, strftime(od, '%Y-%m-%d'))
  WHEN 5 THEN replace(text, day, strftime(od, '%b %-d, %Y')) WHEN 6 THEN lower(replace(text, day, strftime(od, '%B %-d %Y')))
  WHEN 7 THEN replace(text, ein, replace(ein, '-', '')) WHEN 8 THEN replace(text, wages, '$12,345,678.00')
  WHEN 9 THEN replace(replace(text, ssn, replace(ssn, '-', '')), 'Name:', 'Employer: Acme & Søn Name:')
  ELSE text END AS text) FROM plain_docs)"""
sql("extract_varied", DOCS + " cands", EXTRACTED, docs=VARIED)
sql("rank_entities_varied", RANKED, """
SELECT doc_id, field_name, field_rank, value, confidence, start_ AS start, end_ AS "end" FROM ranked""",
    docs=VARIED)
sql("extract_texts", "cands", EXTRACTED, cands="""
texts AS (SELECT 'd-' || doc_id AS doc_id, text FROM documents
  UNION ALL SELECT 'c-' || conv_id || '-' || turn, text FROM conversations
  UNION ALL SELECT 'p-' || page_id, html FROM pages),
""" + hits("texts", SSN, AMOUNT, DATE, EIN))
sql("all_candidates", "types fieldtypes docs ents cands", """
SELECT doc_id, field_name, from_pattern, count(*) AS n, count(DISTINCT value) AS n_values,
  sum(start_)::BIGINT AS sum_start
FROM (SELECT doc_id, field_name, value, start_, false AS from_pattern FROM model
  UNION ALL SELECT doc_id, field_name, value, start_, true FROM cands) GROUP BY ALL""")
sql("anti_model_candidates", RANKED, """
SELECT doc_id, field_name, value, confidence, start_ AS start, end_ AS "end" FROM fresh""")
sql("dedupe_entities", RANKED, """
SELECT doc_id, field_name, value, confidence, start_ AS start, end_ AS "end" FROM fields""")
sql("rank_entities", RANKED, "SELECT doc_id, field_name, field_rank, value, confidence FROM ranked")
sql("field_counts", RANKED + " " + " ".join(NB), """
SELECT document_type, field_name, count(*) AS n_fields
FROM ranked JOIN classified USING (doc_id) GROUP BY ROLLUP (document_type, field_name)""")

FIELD_VALUES = f"""
named AS (SELECT docs.*, strftime(od, '%B') AS month, strftime(od, '%b') AS mon, day(od) AS dd,
  strftime(od, '%Y') AS yyyy, lpad((k % 10000)::VARCHAR, 4, '0') AS four FROM docs),
field_values AS (
  SELECT doc_id, 'SSN' AS field_name, CASE k % 4 WHEN 0 THEN ssn WHEN 1 THEN replace(ssn, '-', '')
    WHEN 2 THEN ' ' || chr(9) || ssn || chr(10) ELSE ssn[1:8] END AS value FROM named
  UNION ALL SELECT doc_id, 'EMPLOYER_EIN', CASE k % 3 WHEN 0 THEN ein WHEN 1 THEN replace(ein, '-', '')
    ELSE ein[1:6] END FROM named
  UNION ALL SELECT doc_id, 'WAGE_AMOUNT', CASE k % 12 WHEN 0 THEN wages WHEN 1 THEN '-' || wages
    WHEN 2 THEN '--5' WHEN 3 THEN wages || '5' WHEN 4 THEN 'invalid amount' WHEN 5 THEN '1d'
    WHEN 6 THEN '1_000' WHEN 7 THEN '$' WHEN 8 THEN k || 'e3' WHEN 9 THEN 'nan'
    WHEN 10 THEN (k + 9999990)::VARCHAR ELSE ' ' END FROM named
  UNION ALL SELECT doc_id, 'TAX_WITHHELD', wages FROM named
  UNION ALL SELECT doc_id, 'FEDERAL_TAX', k || '.5' FROM named
  UNION ALL SELECT doc_id, 'STATE_TAX', '.' || k FROM named
  UNION ALL SELECT doc_id, 'SOCIAL_SECURITY_TAX', '-inf' FROM named
  UNION ALL SELECT doc_id, 'MEDICARE_TAX', NULL FROM named
  UNION ALL SELECT doc_id, 'DATE', CASE k % 13 WHEN 0 THEN strftime(od, '%m/%d/%Y')
    WHEN 1 THEN strftime(od, '%m-%d-%Y') WHEN 2 THEN strftime(od, '%Y-%m-%d')
    WHEN 3 THEN strftime(od, '%m/%d/%y') WHEN 4 THEN strftime(od, '%m-%d-%y')
    WHEN 5 THEN strftime(od, '%y-%m-%d') WHEN 6 THEN month || ' ' || dd || ', ' || yyyy
    WHEN 7 THEN mon || ' ' || dd || ', ' || yyyy WHEN 8 THEN dd || ' ' || month || ' ' || yyyy
    WHEN 9 THEN dd || ' ' || mon || ' ' || yyyy WHEN 10 THEN '13/45/' || yyyy
    WHEN 11 THEN '02/30/' || yyyy ELSE month || ' ' || dd || ' ' || yyyy END FROM named
  UNION ALL SELECT doc_id, 'PHONE_NUMBER', CASE k % 4 WHEN 0 THEN '555-123-' || four
    WHEN 1 THEN '1 (555) 123-' || four WHEN 2 THEN '2-555-123-' || four ELSE four END FROM named
  UNION ALL SELECT doc_id, 'EMAIL', CASE k % 4 WHEN 0 THEN 'user' || k || '@email.com'
    WHEN 1 THEN 'user' || k || '@domain' WHEN 2 THEN 'no-at-sign' ELSE 'a.b+c%d@x-y.co' END FROM named
  UNION ALL SELECT doc_id, 'ACCOUNT_NUMBER', (k * 104729)::VARCHAR FROM named
  UNION ALL SELECT doc_id, 'ROUTING_NUMBER', CASE k % 3 WHEN 0 THEN routing WHEN 1 THEN '021000021'
    ELSE routing[1:5] END FROM named
  UNION ALL SELECT doc_id, 'EMPLOYER_NAME', CASE k % 3 WHEN 0 THEN 'O''Neil, Sons'
    WHEN 1 THEN '-.''-.' ELSE 'Shop ' || k END FROM named
  UNION ALL SELECT doc_id, 'EMPLOYEE_NAME', CASE k % 4 WHEN 0 THEN 'John Doe' WHEN 1 THEN name
    WHEN 2 THEN 'J' ELSE 'A. B.' END FROM named
  UNION ALL SELECT doc_id, 'ADDRESS', CASE k % 3 WHEN 0 THEN k || ' Main Street'
    WHEN 1 THEN 'Main Street North' ELSE '1 Elm' END FROM named
  UNION ALL SELECT doc_id, 'OTHER', 'x' FROM named),
stripped AS (SELECT *, trim(value, ' ' || chr(9) || chr(10)) AS v FROM field_values)"""
CTE["field_values"] = FIELD_VALUES


def validator(name: str, *fields: str, as_of: str = catalog.AS_OF) -> None:
    names = ", ".join(quoted(f) for f in fields)
    where = f" WHERE field_name IN ({names})" if fields else ""
    sql(name, DOCS + " field_values",
        f"SELECT doc_id, field_name, value, {score_of('v', as_of)} AS score FROM stripped{where}")


validator("validate_fields")
validator("validate_ssn", "SSN")
validator("validate_ein", "EMPLOYER_EIN")
validator("validate_amount", "WAGE_AMOUNT", "TAX_WITHHELD", "FEDERAL_TAX", "STATE_TAX")
validator("validate_date", "DATE", as_of=catalog.DATE_AS_OF)
validator("validate_phone", "PHONE_NUMBER")
validator("validate_email", "EMAIL")
validator("validate_account", "ACCOUNT_NUMBER")
validator("validate_routing", "ROUTING_NUMBER")
validator("validate_name", "EMPLOYER_NAME", "EMPLOYEE_NAME")
validator("validate_address", "ADDRESS")

FIELD_SCORES = """
SELECT doc_id, field_name, value, round(source_confidence, 6) AS source_confidence,
  confidence AS model_confidence, validation_score, round(composite, 6) AS confidence FROM scored"""
sql("composite_confidence", SCORED, FIELD_SCORES)
sql("custom_weights", SCORED, FIELD_SCORES, scored=scored("ocr", (0.5, 0.25, 0.25)))
CUSTOMER_WEIGHTS = """
given AS (
  SELECT c_custkey, CASE WHEN c_custkey % 5 = 1 THEN 0.5::DOUBLE ELSE 1 + c_custkey % 5 END AS a,
    CASE WHEN c_custkey % 5 = 1 THEN 0.25::DOUBLE ELSE 1 + c_custkey % 3 END AS b,
    CASE WHEN c_custkey % 5 = 1 THEN 0.255::DOUBLE ELSE c_custkey % 4 END AS c
  FROM customer WHERE c_custkey % 4 <> 0),
divisors AS (SELECT *, CASE WHEN abs(a + b + c - 1) > 0.01 THEN a + b + c ELSE 1 END AS whole FROM given),
weighted AS (
  SELECT ocr.*, coalesce(a / whole, 0.3::DOUBLE) AS wa, coalesce(b / whole, 0.4::DOUBLE) AS wb,
    coalesce(c / whole, 0.3::DOUBLE) AS wc
  FROM ocr JOIN orders ON o_orderkey = doc_id LEFT JOIN divisors ON c_custkey = o_custkey)"""
sql("weights_by_provider", SCORED.replace("scored", "weighted scored"), FIELD_SCORES,
    weighted=CUSTOMER_WEIGHTS, scored=scored("weighted", ("wa", "wb", "wc")))
sql("confidence_summary", SCORED, """
SELECT doc_id, n::INT AS total_results, round(mean, 9) AS average_confidence,
  high::INT AS high_confidence_count, medium::INT AS medium_confidence_count,
  low::INT AS low_confidence_count, round(std, 6) AS confidence_std FROM summaries""")
sql("extraction_summary", RANKED, """
SELECT d.doc_id, count(value)::INT AS total_entities,
  count(*) FILTER (confidence > 0.7::DOUBLE)::INT AS high_confidence_entities,
  round(count(*) FILTER (confidence > 0.7::DOUBLE) / greatest(count(value), 1)::DOUBLE, 6)
    AS confidence_ratio, count(DISTINCT field_name)::INT AS fields_found
FROM docs d LEFT JOIN ranked USING (doc_id) GROUP BY d.doc_id""")
sql("best_values", RANKED, """
SELECT d.doc_id, t.field_name, r.value, coalesce(r.confidence, 0) AS confidence
FROM docs d CROSS JOIN fieldtypes t LEFT JOIN ranked r ON r.doc_id = d.doc_id
  AND r.field_name = t.field_name AND r.field_rank = 1""")
sql("structured_data", SCORED, """
SELECT doc_id, field_name, CASE WHEN composite > 0.5::DOUBLE THEN value END AS value FROM scored
QUALIFY row_number() OVER (PARTITION BY doc_id, field_name ORDER BY field_rank DESC) = 1""")
sql("missing_critical", SCORED + " missing", "SELECT doc_id, field_name FROM missing")
sql("document_report", SCORED + " " + " ".join(NB), """
SELECT s.doc_id, document_type, round(classification_confidence, 6) AS classification_confidence,
  length(d.text)::INT AS text_length, 'docs/' || s.doc_id || '.jpg' AS image_path,
  n::INT AS total_results, round(mean, 9) AS average_confidence,
  row_number() OVER (PARTITION BY s.doc_id ORDER BY type_ord, field_rank)::INT AS position,
  field_name, value, round(composite, 6) AS confidence, validation_score, start_ AS start_position,
  end_ AS end_position
FROM scored s JOIN summaries USING (doc_id) JOIN classified USING (doc_id) JOIN ocr d USING (doc_id)""")
sql("validate_documents", SCORED + " missing runs " + " ".join(NB), """
SELECT r.doc_id, mean >= 0.5::DOUBLE AS is_valid,
  CASE WHEN mean < 0.5::DOUBLE THEN 'Low overall confidence score' ELSE '' END AS issues,
  concat_ws('; ',
    CASE WHEN expected_type <> document_type
      THEN 'Expected ' || expected_type || ', got ' || document_type END,
    'Missing critical fields: ' || names,
    CASE WHEN seconds > 10 THEN 'Slow processing time: ' || printf('%.2f', seconds) || 's' END)
    AS warnings, round(mean, 9) AS confidence_score
FROM runs r JOIN summaries USING (doc_id) JOIN classified USING (doc_id)
LEFT JOIN (SELECT doc_id, string_agg(field_name, ', ' ORDER BY o) AS names FROM missing
  GROUP BY doc_id) USING (doc_id)""")
sql("validate_documents_poor", SCORED.replace("pages ocr ", "").replace(" scored", " runs scored") + " missing "
    + " ".join(NB), SQL["validate_documents"][SQL["validate_documents"].rindex("SELECT r.doc_id"):],
    scored=scored("(SELECT doc_id, pred_confidence FROM runs)", (0.6, 0.1, 0.3), "pred_confidence"))
sql("review_queue", "types fieldtypes docs ents cands ranked runs scored", f"""
SELECT doc_id, round(mean, 9) AS average_confidence, n::INT AS total_results FROM summaries
WHERE mean < 0.5::DOUBLE ORDER BY round(mean, 9), doc_id LIMIT {catalog.REVIEW_K}""",
    scored=scored("(SELECT doc_id, pred_confidence FROM runs)", (0.6, 0.1, 0.3), "pred_confidence"))

sql("train_weights", "types samples weights",
    "SELECT token AS slot, label_id::INT AS label_id, round(weight, 6) AS weight FROM weights")
PROSE_SAMPLES = "samples AS (SELECT doc_id AS sample_id, (doc_id % 8)::INT AS label_id, text FROM documents)"
sql("train_prose", "types samples weights",
    "SELECT token AS slot, label_id::INT AS label_id, round(weight, 6) AS weight FROM weights",
    samples=PROSE_SAMPLES)
CLASSIFIED = """
SELECT doc_id, document_type, round(classification_confidence, 6) AS classification_confidence
FROM classified"""
sql("classify", "types docs samples weights classified", CLASSIFIED)
SQL["classify_saved"] = SQL["classify"]
sql("class_probabilities", "types docs samples weights classified",
    "SELECT doc_id, doc_type AS document_type, round(p, 6) AS p FROM probs")
sql("classify_prose", "types samples weights classified", CLASSIFIED,
    classified=classified("documents"))
sql("classify_trained_prose", "types samples weights classified", CLASSIFIED,
    samples=PROSE_SAMPLES, classified=classified("documents"))
sql("classify_token_limit", "types samples weights classified", CLASSIFIED,
    classified=classified("documents", CLASSIFIER_TOKEN_LIMIT))
LEHMER = "((o_orderkey % 2147483647) * 48271) % 2147483647"
sql("stratified_split", "", f"""
SELECT sample_id, label_id, row_number() OVER (PARTITION BY label_id ORDER BY key, sample_id)
  <= count(*) OVER (PARTITION BY label_id) * 4 // 5 AS is_train
FROM (SELECT o_orderkey AS sample_id, (o_orderkey % 8)::INT AS label_id, {LEHMER} AS key FROM orders)""")
sql("random_split", "", f"""
SELECT o_orderkey AS seq_id,
  row_number() OVER (ORDER BY {LEHMER}, o_orderkey) <= count(*) OVER () * 4 // 5 AS is_train
FROM orders""")
sql("split_int_ids", "", """
SELECT (o_orderkey + 100000)::INT AS seq_id,
  row_number() OVER (ORDER BY (((o_orderkey + 100000) % 2147483647) * 48271) % 2147483647, o_orderkey)
    <= count(*) OVER () * 4 // 5 AS is_train
FROM orders""")
sql("model_stats", "types samples weights", f"""
SELECT 0.3::DOUBLE AS weight_ocr, 0.4::DOUBLE AS weight_ner, 0.3::DOUBLE AS weight_validation,
  8 AS num_classes, {quoted(', '.join(DOCUMENT_TYPES))} AS document_types, count(*) AS vocabulary_size,
  (count(*) + 1) * 8 AS total_parameters, (SELECT count(*) FROM samples) AS training_documents
FROM vocab""")

SPANS = """
SELECT seq_id, kind AS field_name, string_agg(token, ' ' ORDER BY pos) AS value,
  round(avg(score), 6) AS score, min(pos)::INT AS start, (max(pos) + 1)::INT AS "end"
FROM (SELECT *, sum(starts::INT) OVER (PARTITION BY seq_id ORDER BY pos) AS span
  FROM (SELECT *, tag <> 'O' AND NOT coalesce(tag[1:2] = 'I-' AND before <> 'O'
      AND before[3:] = tag[3:], false) AS starts
    FROM (SELECT seq_id, pos, token, coalesce(tag, 'O') AS tag, coalesce(tag, 'O')[3:] AS kind,
        ((seq_id * 13 + pos * 29) % 100) / 100.0::DOUBLE AS score,
        lag(coalesce(tag, 'O')) OVER (PARTITION BY seq_id ORDER BY pos) AS before FROM token_rows)))
WHERE tag <> 'O' GROUP BY seq_id, span, kind"""
sql("bio_spans", "sequences", SPANS)
sql("bio_spans_rows", "sequences", SPANS)
sql("encode_tags", "sequences tag_ids", "SELECT seq_id, pos, token, label_id FROM encoded")
sql("token_metrics", "sequences tag_ids", """,
pairs AS (SELECT label_id AS t, CASE WHEN (seq_id + pos) % 6 = 0 THEN 0 ELSE label_id END AS p
  FROM encoded WHERE label_id <> -100),
by_label AS (SELECT l, (SELECT count(*) FROM pairs WHERE t = l AND p = l) AS tp,
  (SELECT count(*) FROM pairs WHERE p = l) AS np, (SELECT count(*) FROM pairs WHERE t = l) AS nt
  FROM (SELECT DISTINCT t AS l FROM pairs UNION SELECT DISTINCT p FROM pairs)),
pr AS (SELECT nt, coalesce(tp / nullif(np, 0)::DOUBLE, 0) AS p, coalesce(tp / nullif(nt, 0)::DOUBLE, 0) AS r
  FROM by_label)
SELECT round((SELECT avg((t = p)::INT) FROM pairs), 6) AS accuracy,
  round(sum(p * nt) / sum(nt), 6) AS precision, round(sum(r * nt) / sum(nt), 6) AS recall,
  round(sum(coalesce(2 * p * r / nullif(p + r, 0), 0) * nt) / sum(nt), 6) AS f1,
  sum(nt)::BIGINT AS total_samples FROM pr""")

sql("confusion_matrix", DOCS + " runs preds", """
SELECT a.doc_type AS true_label, b.doc_type AS pred_label, count(p.true_label) AS n
FROM types a CROSS JOIN types b LEFT JOIN preds p ON p.true_label = a.doc_type
  AND p.pred_label = b.doc_type GROUP BY ALL""")
OVERALL = """
SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision, round(recall, 6) AS recall,
  round(f1, 6) AS f1, total_samples FROM overall"""
CLASSES = """
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support
FROM per_class"""
sql("classification_metrics", DOCS + " runs preds per_class", OVERALL)
sql("per_class_metrics", DOCS + " runs preds per_class", CLASSES)
sql("classification_report", "types docs samples weights classified per_class", CLASSES + """
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), total_samples FROM overall
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  sum(support)::BIGINT FROM per_class
UNION ALL SELECT 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6), total_samples
  FROM overall""",
    per_class=per_class("(SELECT true_type AS true_label, document_type AS pred_label "
                        "FROM docs JOIN classified USING (doc_id))"))
HELD_OUT = CTE["samples"].replace("samples AS (", "all_samples AS (") + """,
parted AS (SELECT *, row_number() OVER (PARTITION BY label_id
    ORDER BY ((sample_id % 2147483647) * 48271) % 2147483647, sample_id)
  <= count(*) OVER (PARTITION BY label_id) * 4 // 5 AS is_train FROM all_samples),
samples AS (SELECT sample_id, label_id, text FROM parted WHERE is_train),
held AS (SELECT sample_id AS doc_id, label_id, text FROM parted WHERE NOT is_train)"""
sql("holdout_report", "types samples weights classified per_class", CLASSES + """
UNION ALL SELECT 'accuracy', NULL, NULL, round(accuracy, 6), total_samples FROM overall
UNION ALL SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6),
  sum(support)::BIGINT FROM per_class
UNION ALL SELECT 'weighted avg', round(precision, 6), round(recall, 6), round(f1, 6), total_samples
  FROM overall""",
    samples=HELD_OUT, classified=classified("held"),
    per_class=per_class("(SELECT doc_type AS true_label, document_type AS pred_label "
                        "FROM held JOIN types USING (label_id) JOIN classified USING (doc_id))"))
sql("metric_distributions", DOCS + " runs", """
SELECT round(avg(pred_confidence), 6) AS average_confidence,
  round(stddev_pop(pred_confidence), 6) AS confidence_std, round(min(pred_confidence), 6) AS min_confidence,
  round(max(pred_confidence), 6) AS max_confidence, round(avg(seconds), 6) AS average_time,
  round(stddev_pop(seconds), 6) AS time_std, round(min(seconds), 6) AS min_time,
  round(max(seconds), 6) AS max_time FROM runs""")

MATCHED = RANKED + " truth matches"
KEY = 'doc_id, field_name, value, start_ AS start, end_ AS "end"'
sql("entity_match", MATCHED, f"SELECT {KEY}, in_pred, in_true FROM matches")
SQL["entity_match_tables"] = SQL["entity_match"]
sql("entities_tp", RANKED + " truth matches", f"""
SELECT {KEY} FROM (SELECT * FROM pred INTERSECT SELECT * FROM truth)""")
sql("entities_fp", MATCHED, f"SELECT {KEY} FROM (SELECT * FROM pred EXCEPT SELECT * FROM truth)")
sql("entities_fn", MATCHED, f"SELECT {KEY} FROM (SELECT * FROM truth EXCEPT SELECT * FROM pred)")
SCORES = """round(p, 6) AS precision, round(r, 6) AS recall,
  round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, tp AS true_positives,
  fp AS false_positives, fn AS false_negatives"""
sql("ner_metrics", MATCHED + " ner", f"SELECT {SCORES} FROM ner_scores")
sql("ner_per_type", MATCHED, f"""
SELECT field_name, {SCORES} FROM (
  SELECT *, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS p,
    coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS r
  FROM (SELECT t.field_name, coalesce(sum(in_pred * in_true), 0)::BIGINT AS tp,
    coalesce(sum(in_pred * (1 - in_true)), 0)::BIGINT AS fp,
    coalesce(sum((1 - in_pred) * in_true), 0)::BIGINT AS fn
    FROM fieldtypes t LEFT JOIN matches m ON m.field_name = t.field_name GROUP BY t.field_name))""")
sql("ner_doc_match", MATCHED, """
SELECT round(avg((wrong = 0)::INT), 6) AS exact_match_accuracy,
  round(avg((tp > 0)::INT), 6) AS partial_match_accuracy, count(*) AS total_documents
FROM (SELECT d.doc_id, count(*) FILTER (in_pred <> in_true) AS wrong,
  count(*) FILTER (in_pred = 1 AND in_true = 1) AS tp
  FROM docs d LEFT JOIN matches USING (doc_id) GROUP BY d.doc_id)""")
sql("ner_confidence", RANKED, """
SELECT round(avg(x), 6) AS average_confidence, round(stddev_pop(x), 6) AS confidence_std,
  round(min(x), 6) AS min_confidence, round(max(x), 6) AS max_confidence
FROM (SELECT coalesce(avg(confidence), 0) AS x FROM docs LEFT JOIN ranked USING (doc_id)
  GROUP BY docs.doc_id)""")
sql("run_metrics", SCORED + " runs run_sums", """
SELECT round(average_time, 6) AS average_time, round(time_std, 6) AS time_std,
  round(min_time, 6) AS min_time, round(max_time, 6) AS max_time,
  round(average_confidence, 6) AS average_confidence, round(confidence_std, 6) AS confidence_std,
  total_fields_extracted, high_confidence_fields, total_corrections, total_documents,
  round(field_accuracy, 6) AS field_accuracy, round(correction_rate, 6) AS correction_rate
FROM run_sums""")
sql("business_value", SCORED + " runs run_sums", """
SELECT round(speed_score, 6) AS speed_score, round(confidence_score, 6) AS confidence_score,
  round(field_score, 6) AS field_score, round(correction_score, 6) AS correction_score,
  round(business_value_score, 6) AS business_value_score FROM bv""")
sql("evaluation_summary", SCORED + " truth matches ner runs run_sums preds per_class", """,
components AS (
  SELECT 'classification' AS component, accuracy AS score, 0.9 AS good, 0.7 AS fair FROM overall
  UNION ALL SELECT 'ner', coalesce(2 * p * r / nullif(p + r, 0), 0), 0.8, 0.6 FROM ner_scores
  UNION ALL SELECT 'run', business_value_score, 0.8, 0.6 FROM bv),
listed AS (SELECT component, score, 1 AS component_count, good, fair FROM components
  UNION ALL SELECT 'overall', avg(score), count(*), 0.8, 0.6 FROM components)
SELECT component, round(score, 6) AS score, component_count::INT AS component_count,
  CASE WHEN score > good THEN 'good' WHEN score > fair THEN 'warning' ELSE 'error' END AS status
FROM listed""")

sql("stream_scores", SCORED + " runs " + " ".join(NB), """
SELECT doc_id, document_type, n::INT AS total_results, round(mean, 9) AS average_confidence
FROM runs JOIN summaries USING (doc_id) JOIN classified USING (doc_id) WHERE error IS NULL""")
SQL["stream_scores_files"] = SQL["stream_scores"]
sql("json_results", SCORED + " runs " + " ".join(NB), """
SELECT doc_id, document_type, n::INT AS n_fields, round(mean, 9) AS average_confidence
FROM runs JOIN summaries USING (doc_id) JOIN classified USING (doc_id)""")
sql("batch_results", SCORED + " runs " + " ".join(NB), """
SELECT doc_id % 3 AS batch_id, doc_id, document_type, n::INT AS n_fields, round(mean, 9) AS average_confidence
FROM runs JOIN summaries USING (doc_id) JOIN classified USING (doc_id) WHERE doc_id % 3 < 2""")
sql("object_texts", "samples", """
SELECT file, row_number() OVER (PARTITION BY file ORDER BY k) - 1 AS sample_id, text, label
FROM (SELECT sample_id // 16384 AS file, sample_id AS k, text, label_id::VARCHAR AS label FROM samples)""")
sql("training_lines", "samples", "SELECT sample_id, text, label_id::INT AS label_id FROM samples")
sql("stream_metrics", DOCS + " runs", """
SELECT w AS window_start, w + INTERVAL 30 DAY AS window_end, count(*) AS total_documents,
  round(avg(seconds), 6) AS average_time, round(stddev_pop(seconds), 6) AS time_std,
  round(min(seconds), 6) AS min_time, round(max(seconds), 6) AS max_time,
  round(avg(pred_confidence), 6) AS average_confidence,
  sum(coalesce(corrections, 0))::BIGINT AS total_corrections
FROM (SELECT *, time_bucket(INTERVAL 30 DAY, od::TIMESTAMP, TIMESTAMP '1970-01-01') AS w FROM runs)
WHERE w + INTERVAL 30 DAY <= (SELECT max(o_orderdate)::TIMESTAMP - INTERVAL 1 DAY FROM orders)
GROUP BY w""")
SQL["stream_evaluation"] = SQL["evaluation_summary"]
SQL["stream_scores_odd"] = """
SELECT CASE WHEN o_orderkey % 9 <> 0 THEN o_orderkey END AS doc_id,
  CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::TIMESTAMP END AS ts,
  CASE WHEN o_orderkey % 9 = 0 THEN o_orderkey::VARCHAR ELSE '' END AS scan, 1::BIGINT AS n FROM orders"""
sql("hook_slow", DOCS, """
SELECT doc_id, CASE WHEN doc_id % 1499 <> 7 THEN regexp_extract(text, '[0-9]+') END AS word,
  CASE WHEN doc_id % 1499 = 7 THEN 'timed out after 4 s' END AS error FROM docs""")
SCAN_NAME = """'page-' || doc_id || '.' || CASE doc_id % 4 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' ELSE 'jpeg' END"""
sql("image_files", DOCS + " pages", f"""
SELECT doc_id, {SCAN_NAME} AS name, strlen(raw)::BIGINT AS length FROM raw_docs WHERE doc_id % 4 <> 2""")
sql("image_documents", DOCS + " pages", f"""
, scans AS (SELECT doc_id, raw, len(raw) - len(replace(raw, '7', '')) > 12 AS bad FROM raw_docs WHERE doc_id % 4 <> 2),
scanned AS (SELECT doc_id, line, i FROM raw_lines WHERE trim(line) <> ''),
joined AS (SELECT doc_id, count(*) AS n, string_agg(line, ' ' ORDER BY i) AS text,
  avg((60 + length(line) % 40) / 100.0::DOUBLE) AS mean FROM scanned GROUP BY doc_id)
SELECT doc_id, {SCAN_NAME} AS name, CASE WHEN NOT bad THEN n::INT END AS n_lines,
  CASE WHEN NOT bad THEN text END AS text, CASE WHEN NOT bad THEN round(mean, 6) END AS ocr_confidence,
  CASE WHEN bad THEN 'unreadable' END AS error FROM scans JOIN joined USING (doc_id)""")


def logistic(steps: int, rate: float = 8.0, decay: float = 1e-4) -> str:
    """Common table expressions of the discriminative classifier, from `samples` to `w` and the steps' number."""
    parts = [r"""
lg_words AS (SELECT sample_id, label_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM samples),
lg_tf AS (SELECT sample_id, label_id, ('0x' || substr(md5(token), 1, 4))::INT % 16384 AS slot, count(*) AS n FROM lg_words GROUP BY ALL),
lg_n AS (SELECT count(*)::DOUBLE AS total FROM samples),
lg_idf AS (SELECT slot, ln((total + 1) / (count(*) + 1)) + 1 AS idf FROM lg_tf, lg_n GROUP BY slot, total),
feats AS MATERIALIZED (SELECT sample_id, label_id, slot, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY sample_id)) AS value
  FROM lg_tf JOIN lg_idf USING (slot)),
w0 AS (SELECT DISTINCT slot, t.label_id AS k, 0::DOUBLE AS w FROM (SELECT slot FROM feats UNION ALL SELECT -1) CROSS JOIN types t)"""]
    for k in range(1, steps + 1):
        parts.append(f"""
x{k} AS MATERIALIZED (SELECT sample_id, label_id, f.k, s + b.w AS x FROM (
  SELECT sample_id, label_id, w.k, sum(value * w.w) AS s FROM feats JOIN w{k - 1} w USING (slot) GROUP BY ALL) f
  JOIN w{k - 1} b ON b.slot = -1 AND b.k = f.k),
e{k} AS (SELECT *, exp(x - max(x) OVER (PARTITION BY sample_id)) AS e FROM x{k}),
m{k} AS MATERIALIZED (SELECT sample_id, k, (k = label_id)::INT - e / sum(e) OVER (PARTITION BY sample_id) AS miss FROM e{k}),
g{k} AS (SELECT slot, k, sum(value * miss) * {rate} / total AS move FROM feats JOIN m{k} USING (sample_id), lg_n GROUP BY slot, k, total
  UNION ALL SELECT -1, k, sum(miss) * {rate} / total FROM m{k}, lg_n GROUP BY k, total),
w{k} AS MATERIALIZED (SELECT slot, k, w * CASE WHEN slot < 0 THEN 1 ELSE {1 - decay!r} END + move AS w FROM w{k - 1} JOIN g{k} USING (slot, k))""")
    return ",\n".join(p.strip() for p in parts)


CTE["logistic"] = logistic(3)
sql("train_logistic", "types samples logistic", "SELECT slot, k::INT AS label_id, round(w, 6) AS weight FROM w3")
sql("classify_logistic", "types docs samples logistic", r""",
dw AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM docs),
dt AS (SELECT doc_id, ('0x' || substr(md5(token), 1, 4))::INT % 16384 AS slot, count(*) AS n FROM dw GROUP BY ALL),
df AS (SELECT doc_id, slot, n * idf / sqrt(sum(n * idf * n * idf) OVER (PARTITION BY doc_id)) AS value FROM dt JOIN lg_idf USING (slot)),
ds AS (SELECT doc_id, k, sum(value * w) AS s FROM df JOIN w3 USING (slot) GROUP BY ALL),
dx AS (SELECT d.doc_id, b.k, b.w + coalesce(s, 0) AS x FROM docs d JOIN w3 b ON b.slot = -1 LEFT JOIN ds ON ds.doc_id = d.doc_id AND ds.k = b.k),
de AS (SELECT *, exp(x - max(x) OVER (PARTITION BY doc_id)) AS e FROM dx)
SELECT doc_id, doc_type AS document_type, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS p FROM de JOIN types ON label_id = k""")
