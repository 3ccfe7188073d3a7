"""A deterministic tax-document corpus that Spark derives from the `orders` table, row by row.

One order gives one document with its text, OCR lines, model entities, true entities, and the record
of its run. Nothing is shuffled for it: every column is an expression over the order's key and date.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions.arrays import rows_of
from formwright.operators.text_assembly import with_text
from formwright.operators.tokens import encoded_tags
from formwright.sources.synthetic import synthetic_sequences
from formwright.vocabulary import DOCUMENT_TYPES

TITLES = (
    "W-2 Wage and Tax Statement",
    "1099-R Distributions From Pensions",
    "1099-MISC Miscellaneous Income",
    "1099-DIV Dividends and Distributions",
    "Receipt Business expense",
    "Bank Statement",
    "1040 U.S. Individual Income Tax Return",
    "Schedule A Itemized Deductions",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: How many partitions the orders' keys are dealt into before texts are made of them; unset, it follows their number.
PARTITIONS = "spark.formwright.corpusPartitions"
#: So many documents are a few seconds of work.
ROWS_A_TASK = 16384


def spread(keys: DataFrame, key: str | Column = "o_orderkey", rows: DataFrame | None = None) -> DataFrame:
    """The rows dealt by key into tasks of a few seconds: a file of a few MB of keys, one task to Spark, gives GB of texts.

    They are counted, or the `rows` they were made of, one of each.
    """
    spark = keys.sparkSession
    partitions = spark.conf.get(PARTITIONS, None)
    if not partitions:
        partitions = max(-(-(keys if rows is None else rows).count() // ROWS_A_TASK), spark.sparkContext.defaultParallelism)
    return keys.repartition(int(partitions), key)


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"))


def _case(*choices: str, key: str = "doc_id") -> str:
    """SQL for the choice that the key's remainder names."""
    return f"get(array({', '.join(choices)}), int({key} % {len(choices)}))"


def _literals(texts: Iterable[str]) -> list[str]:
    return ["'" + text.replace("'", "\\'") + "'" for text in texts]


def _type_name(label: str) -> str:
    return f"get(array({', '.join(_literals(DOCUMENT_TYPES))}), int({label}))"


def with_document(rows: DataFrame) -> DataFrame:
    """Adds the document's columns to rows with `o_orderkey` and `o_orderdate`."""
    k = "o_orderkey"
    parts = rows.selectExpr(
        "*",
        f"{k} AS doc_id",
        f"int({k} % 8) AS label_id",
        f"{_type_name(f'{k} % 8')} AS true_type",
        f"concat('Customer ', {k}) AS _name",
        f"concat_ws('-', lpad(({k} * 7919 + 13) % 1000, 3, '0'), lpad(({k} * 31 + 7) % 100, 2, '0'), "
        f"lpad(({k} * 104729 + 1) % 10000, 4, '0')) AS _ssn",
        f"concat_ws('-', lpad({k} * 17 % 100, 2, '0'), lpad({k} * 999983 % 10000000, 7, '0')) AS _ein",
        f"concat('$', format_number(({k} * 4241 % 200000000) div 100, 0), '.', "
        f"lpad({k} * 4241 % 100, 2, '0')) AS _wages",
        "date_format(o_orderdate, 'MM/dd/yyyy') AS _date",
        f"lpad({k} * 21000021 % 1000000000, 9, '0') AS _routing",
        f"{_case(*_literals(TITLES), key=k)} AS _title",
    )
    return parts.selectExpr(
        "*",
        "format_string('Form %s Name: %s SSN: %s EIN: %s Wages: %s Date: %s Routing: %s', "
        "_title, _name, _ssn, _ein, _wages, _date, _routing) AS text",
    )


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, label_id, true_type, text) and the columns the texts are made of."""
    return with_document(orders(spark, sf_dir))


def batch_documents(batch: DataFrame) -> DataFrame:
    """The documents of a batch of orders.

    A file of a batch may hold the keys of one remainder of their hash; dealt by that hash again, they would all go to few
    tasks, so they are dealt by the hash of another one.
    """
    return with_document(spread(batch.select("o_orderkey", "o_orderdate"), F.xxhash64("o_orderkey")))


def varied_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents with NULL and empty texts, letters outside ASCII, and all forms of dates and numbers."""

    def dated(pattern: str) -> str:
        return f"replace(text, _date, date_format(o_orderdate, '{pattern}'))"

    text = f"""CASE doc_id % 12 WHEN 0 THEN NULL WHEN 1 THEN ''
        WHEN 2 THEN concat('Zoë Ñandú ', text, ' – 漢字 DECEMBER 5, 2023 été')
        WHEN 3 THEN {dated('MM-dd-yyyy')} WHEN 4 THEN {dated('yyyy-MM-dd')} WHEN 5 THEN {dated('MMM d, yyyy')}
        WHEN 6 THEN lower({dated('MMMM d yyyy')}) WHEN 7 THEN replace(text, _ein, replace(_ein, '-', ''))
        WHEN 8 THEN replace(text, _wages, '$12,345,678.00')
        WHEN 9 THEN replace(replace(text, _ssn, replace(_ssn, '-', '')), 'Name:', 'Employer: Acme & Søn Name:')
        ELSE text END"""
    return documents(spark, sf_dir).withColumn("text", F.expr(text))


def raw_pages(docs: DataFrame) -> DataFrame:
    """Adds `raw`: the text as a page with line breaks and a blank line."""
    page = r"replace(replace(text, ' SSN:', '\n\n SSN:'), ' Wages:', '\nWages:')"
    return docs.selectExpr("*", f"{page} AS raw")


def with_lines(docs: DataFrame) -> DataFrame:
    """Adds `lines` as an OCR engine would report them: own confidences, blank lines left out."""
    lines = r"""filter(transform(split(raw, '\n', -1), (line, i) -> struct(
        i AS line_no, trim(line) AS text, (70 + (doc_id * 7 + i * 13) % 30) / 100D AS confidence)),
        x -> x.text <> '')"""
    return raw_pages(docs).selectExpr("*", f"{lines} AS lines")


def with_entities(docs: DataFrame) -> DataFrame:
    """Adds `entities`, what a field model found: a name, the number twice, and noise."""

    def entity(ordinal: int, group: str, word: str, known: bool = True) -> str:
        start = f"instr(text, {word}) - 1" if known else "int(NULL)"
        return (
            f"struct('{group}' AS entity_group, {word} AS word, "
            f"(doc_id * 13 + {ordinal * 29}) % 100 / 100D AS score, "
            f"{start} AS start, {start} + length({word}) AS end)"
        )

    entities = (
        entity(0, "PERSON", "_name"),
        entity(1, "SSN", "_ssn"),
        entity(2, "MISC", "'noise'", known=False),
        entity(3, "ssn", "_ssn"),
    )
    return docs.selectExpr("*", f"array({', '.join(entities)}) AS entities")


def with_true_entities(docs: DataFrame) -> DataFrame:
    """Adds `true_entities`; every tenth document lacks its date."""

    def entity(field: str, value: str) -> str:
        start = f"instr(text, {value}) - 1"
        return (
            f"struct('{field}' AS field_name, {value} AS value, {start} AS start, "
            f"{start} + length({value}) AS end)"
        )

    always = ", ".join(
        entity(field, value)
        for field, value in (("SSN", "_ssn"), ("WAGE_AMOUNT", "_wages"), ("EMPLOYEE_NAME", "_name"))
    )
    dated = f"array({always}, {entity('DATE', '_date')})"
    return docs.selectExpr(
        "*", f"CASE WHEN doc_id % 10 = 0 THEN array({always}) ELSE {dated} END AS true_entities"
    )


PATH = "concat('docs/', doc_id, '.jpg')"
ERROR = "CASE WHEN doc_id % 97 = 0 THEN 'unreadable' END"


def with_run(docs: DataFrame) -> DataFrame:
    """Adds the record of the document's run, and a prediction to evaluate."""

    def shifted_every(n: int) -> str:
        return _type_name(f"CASE WHEN doc_id % {n} = 0 THEN (label_id + 1) % 8 ELSE label_id END")

    return docs.selectExpr(
        "*",
        f"{PATH} AS path",
        f"{shifted_every(7)} AS expected_type",
        "(doc_id * 53 % 1200) / 100D AS processing_time_seconds",
        "CASE WHEN doc_id % 4 <> 0 THEN doc_id % 3 END AS user_corrections",
        "CAST(o_orderdate AS TIMESTAMP) AS arrival",
        f"{ERROR} AS error",
        f"{shifted_every(5)} AS pred_type",
        "(doc_id * 37 % 100) / 100D AS pred_confidence",
    )


def predictions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, true_label, pred_label, confidence, processing_time)"""
    return with_run(docs).select(
        "doc_id",
        "text",
        F.col("true_type").alias("true_label"),
        F.col("pred_type").alias("pred_label"),
        F.col("pred_confidence").alias("confidence"),
        F.col("processing_time_seconds").alias("processing_time"),
    )


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as they come out of OCR and the field model, with the record of their run."""
    return run_documents(documents(spark, sf_dir))


def run_documents(docs: DataFrame) -> DataFrame:
    return with_text(with_lines(with_run(with_true_entities(with_entities(docs)))))


def entity_table(docs: DataFrame) -> DataFrame:
    """(doc_id, entity_group, word, score, start, end, ord): the model entities as a table."""
    numbered = F.transform("entities", lambda e, i: F.struct(e.alias("e"), i.alias("ord")))
    return rows_of(docs, numbered, "doc_id").select("doc_id", "e.*", "ord")


def field_values(docs: DataFrame) -> DataFrame:
    """(doc_id, field_name, value): for every document a value of each field type, in many shapes."""

    def dated(pattern: str) -> str:
        return f"date_format(o_orderdate, '{pattern}')"

    four = "lpad(doc_id % 10000, 4, '0')"
    values = {
        "SSN": _case(
            "_ssn", "replace(_ssn, '-', '')", r"concat(' \t', _ssn, '\n')", "substr(_ssn, 1, 8)"
        ),
        "EMPLOYER_EIN": _case("_ein", "replace(_ein, '-', '')", "substr(_ein, 1, 6)"),
        "WAGE_AMOUNT": _case(
            "_wages", "concat('-', _wages)", "'--5'", "concat(_wages, '5')", "'invalid amount'",
            "'1d'", "'1_000'", "'$'", "concat(doc_id, 'e3')", "'nan'", "string(doc_id + 9999990)",
            "' '",
        ),
        "TAX_WITHHELD": "_wages",
        "FEDERAL_TAX": "concat(doc_id, '.5')",
        "STATE_TAX": "concat('.', doc_id)",
        "SOCIAL_SECURITY_TAX": "'-inf'",
        "MEDICARE_TAX": "string(NULL)",
        "DATE": _case(
            dated("MM/dd/yyyy"), dated("MM-dd-yyyy"), dated("yyyy-MM-dd"), dated("MM/dd/yy"),
            dated("MM-dd-yy"), dated("yy-MM-dd"), dated("MMMM d, yyyy"), dated("MMM d, yyyy"),
            dated("d MMMM yyyy"), dated("d MMM yyyy"), f"concat('13/45/', {dated('yyyy')})",
            f"concat('02/30/', {dated('yyyy')})", dated("MMMM d yyyy"),
        ),
        "PHONE_NUMBER": _case(
            f"concat('555-123-', {four})", f"concat('1 (555) 123-', {four})",
            f"concat('2-555-123-', {four})", four,
        ),
        "EMAIL": _case(
            "concat('user', doc_id, '@email.com')", "concat('user', doc_id, '@domain')",
            "'no-at-sign'", "'a.b+c%d@x-y.co'",
        ),
        "ACCOUNT_NUMBER": "string(doc_id * 104729)",
        "ROUTING_NUMBER": _case("_routing", "'021000021'", "substr(_routing, 1, 5)"),
        "EMPLOYER_NAME": _case(r"'O\'Neil, Sons'", r"'-.\'-.'", "concat('Shop ', doc_id)"),
        "EMPLOYEE_NAME": _case("'John Doe'", "_name", "'J'", "'A. B.'"),
        "ADDRESS": _case("concat(doc_id, ' Main Street')", "'Main Street North'", "'1 Elm'"),
        "OTHER": "'x'",
    }
    rows = ", ".join(f"struct('{n}' AS field_name, {value} AS value)" for n, value in values.items())
    return docs.selectExpr("doc_id", f"inline_outer(array({rows}))")


def labelled_samples(docs: DataFrame) -> DataFrame:
    """(sample_id, text, label): labels as read from a file, some of them unusable."""
    k = F.col("doc_id")
    label = (
        F.when(k % 19 == 0, F.lit(None).cast("string"))
        .when(k % 17 == 0, F.lit("2.5"))
        .when(k % 13 == 0, F.lit("9"))
        .otherwise((k % 8).cast("string"))
    )
    return docs.select(k.alias("sample_id"), "text", label.alias("label"))


def tagged_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tokens, tags, scores): token sequences with the score of each tag."""
    sequences = synthetic_sequences(orders(spark, sf_dir), "o_orderkey")
    scores = F.transform("tokens", lambda _, i: (F.col("seq_id") * 13 + i * 29) % 100 / 100)
    return sequences.withColumn("scores", scores)


def encoded_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, tokens, true_ids, pred_ids): tags not filled up, lower-case ones in every fifth."""
    sequences = synthetic_sequences(orders(spark, sf_dir), "o_orderkey", padded=False)
    odd = F.col("seq_id") % 5 == 2
    tags = F.when(odd, F.transform("tags", F.lower)).otherwise(F.col("tags"))
    encoded = sequences.withColumn("true_ids", encoded_tags(F.col("tokens"), tags))
    return encoded.withColumn(
        "pred_ids",
        F.transform(
            "true_ids",
            lambda x, i: F.when((F.col("seq_id") + i) % 6 == 0, F.lit(0)).otherwise(x),
        ),
    )
