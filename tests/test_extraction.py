"""Candidates against Python's `re`, and dedup and rank against a plain loop."""

import random
import re

import pytest
from pyspark.sql import functions as F

from formwright import vocabulary as v
from formwright.functions.arrays import running_total
from formwright.functions.candidates import (
    CANDIDATES,
    model_candidates,
    pattern_candidates,
    ranked_fields,
    ranked_values,
)
from formwright.operators import entities as ent

DEMO = (
    "Employee Name: John Doe SSN: 123-45-6789 Employer: ABC Corporation EIN: 12-3456789 "
    "Wages: $50,000.00"
)
PIECES = [
    "SSN: 123-45-6789", "123456789", "é123-45-6789", "123-45-6789é", "932-38-4730", "17-0999983",
    "12-3456789", "$42.41", "$1,234.56.", "$", "1,234,567.89", "12.abc", "1234", "05/28/1997",
    "5-8-1997", "1997-5-28", "Jan 5, 2020", "SEPTEMBER 15 2021", "decem 1, 1999", "x12", "12x", "_12",
    "\n", "  ", "漢字", "😀 12", "\u0001", "12\u000134", "no numbers", "900-12-3456", "000-12-3456",
]


def expected_candidates(text):
    out = []
    tables = (
        ("SSN", v.SSN_PATTERNS, 0),
        ("WAGE_AMOUNT", v.AMOUNT_PATTERNS, 0),
        ("DATE", v.DATE_PATTERNS, re.IGNORECASE),
        ("EMPLOYER_EIN", v.EIN_PATTERNS, 0),
    )
    for field, patterns, flags in tables:
        for pattern in patterns:
            for m in re.finditer(pattern, text, flags):
                digits = re.sub(r"\D", "", m.group())
                plausible = (
                    len(digits) == 9
                    and digits[:3] not in ("000", "666")
                    and digits[0] != "9"
                    and digits[3:5] != "00"
                    and digits[5:] != "0000"
                )
                if field == "EMPLOYER_EIN" and plausible:
                    continue
                out.append((field, m.group(), m.start(), m.end()))
    return out


def found(df, column="c"):
    return {
        row["id"]: [(c["field_name"], c["value"], c["start"], c["end"]) for c in row[column]]
        for row in df.collect()
    }


def test_offsets_match_python(spark):
    rng = random.Random(7)
    texts = [DEMO, "", "x"] + [
        rng.choice(["", " ", ", "]).join(rng.choices(PIECES, k=rng.randint(1, 14))) for _ in range(300)
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    got = found(df.select("id", pattern_candidates(F.col("text")).alias("c")))
    for i, text in enumerate(texts):
        assert got[i] == expected_candidates(text), text


def test_long_text_is_processed_whole(spark):
    text = " ".join(f"{i % 1000} $ab" for i in range(5000)) + " é 123-45-6789"
    df = spark.createDataFrame([(0, text)], "id int, text string")
    got = found(df.select("id", pattern_candidates(F.col("text")).alias("c")))
    assert got[0] == expected_candidates(text)


def test_null_text_has_no_candidates(spark):
    df = spark.createDataFrame([(0, None)], "id int, text string")
    assert found(df.select("id", pattern_candidates(F.col("text")).alias("c"))) == {0: []}


@pytest.mark.parametrize("n", [0, 1, 1023, 1024, 1025, 5000])
def test_running_total(spark, n):
    values = [(i * 7) % 11 for i in range(n)]
    df = spark.createDataFrame([(values,)], "a array<int>")
    got = df.select(running_total(F.col("a"))).first()[0]
    expected = [0]
    for x in values:
        expected.append(expected[-1] + x)
    assert got == expected


def test_demo_document(spark):
    df = spark.createDataFrame([(1, DEMO)], "doc_id int, text string")
    rows = ent.ranked_rows(ent.with_ranked_fields(df)).orderBy("type_ord", "field_rank").collect()
    assert [(r.field_name, r.value, r.start) for r in rows] == [
        ("SSN", "123-45-6789", 29),
        ("WAGE_AMOUNT", "$50,000.00", 90),
        ("WAGE_AMOUNT", "123", 29),
        ("WAGE_AMOUNT", "45", 33),
        ("WAGE_AMOUNT", "6789", 36),
        ("WAGE_AMOUNT", "12", 72),
        ("WAGE_AMOUNT", "3456789", 75),
        ("WAGE_AMOUNT", "50,000.00", 91),
    ]


def expected_ranked(candidates):
    """The rule as a loop: `candidates` are (type_ord, value, confidence, from_pattern)."""
    out = []
    for t in range(len(v.FIELD_TYPES)):
        model = [(i, c) for i, c in enumerate(candidates) if c[0] == t and not c[3]]
        patterns = [(i, c) for i, c in enumerate(candidates) if c[0] == t and c[3]]
        known = {c[1] for _, c in model}
        kept, seen = [], set()
        for i, c in model + [(i, c) for i, c in patterns if c[1] not in known]:
            if c[1] not in seen and c[2] > 0.3:
                seen.add(c[1])
                kept.append((i, c))
        kept.sort(key=lambda e: (-e[1][2], e[0]))
        out += [(t, rank, c[1], c[2]) for rank, (_, c) in enumerate(kept, 1)]
    return out


def test_rank_against_a_loop(spark):
    rng = random.Random(3)
    docs = []
    for i in range(200):
        model = [
            (rng.randrange(4), rng.choice("abcd"), rng.choice([0.1, 0.3, 0.31, 0.5, 0.9]), False)
            for _ in range(rng.randrange(12))
        ]
        patterns = [
            (rng.randrange(4), rng.choice("abcdef"), rng.choice([0.7, 0.8, 0.9]), True)
            for _ in range(rng.randrange(12))
        ]
        docs.append((i, model + patterns))
    rows = [
        (i, [(t, v.FIELD_TYPES[t], value, conf, 0, 1, pattern) for t, value, conf, pattern in cs])
        for i, cs in docs
    ]
    df = spark.createDataFrame(rows, f"id int, c {CANDIDATES}")
    got = {r["id"]: r["r"] for r in df.select("id", ranked_fields(F.col("c")).alias("r")).collect()}
    for i, cs in docs:
        assert [
            (f["type_ord"], f["field_rank"], f["value"], f["confidence"]) for f in got[i]
        ] == expected_ranked(cs)


def test_entity_groups(spark):
    entities = [
        ("person", "Ann", 0.9, 0, 3), ("ORG", "Acme", 0.8, 5, 9), ("money", "$1", 0.7, 10, 12),
        ("LOC", "Elm St", 0.6, 13, 19), ("PHONE", "555", 0.5, 20, 23), ("date", "May 1", 0.4, 24, 29),
        ("email", "a@b.co", 0.9, 30, 36), ("medicare_tax", "9", 0.9, None, None), ("MISC", "x", 0.9, 0, 1),
    ]
    schema = "e array<struct<entity_group:string,word:string,score:double,start:int,end:int>>"
    df = spark.createDataFrame([(entities,), (None,)], schema)
    rows = [r[0] for r in df.select(model_candidates(F.col("e"))).collect()]
    assert [c["field_name"] for c in rows[0]] == [
        "EMPLOYEE_NAME", "EMPLOYER_NAME", "WAGE_AMOUNT", "ADDRESS", "PHONE_NUMBER", "DATE", "EMAIL",
        "MEDICARE_TAX",
    ]
    assert rows[1] == []


def test_nested_entity_table_gives_the_same_fields(spark):
    """A table of entities, with many copies of one, against the array it stands for."""
    entities = [("SSN", "111", 0.2), ("ssn", "111", 0.5), ("SSN", "222", 0.1), ("SSN", "333", 0.9)]
    entities += [("ssn", "333", 0.95)] * 500
    rows = [(1, g, w, s, 0, 3, i) for i, (g, w, s) in enumerate(entities)]
    table = spark.createDataFrame(
        rows, "doc_id int, entity_group string, word string, score double, start int, end int, ord int"
    )
    docs = spark.createDataFrame([(1, "222 111")], "doc_id int, text string")
    array = table.groupBy("doc_id").agg(
        F.transform(
            F.sort_array(F.collect_list(F.struct("ord", "entity_group", "word", "score", "start", "end"))),
            lambda e: F.struct(*[e[n].alias(n) for n in ("entity_group", "word", "score", "start", "end")]),
        ).alias("entities")
    )
    nested = ent.nest_entities(table)
    assert nested.select(F.size("entities")).first()[0] == 3

    def ranked(entities):
        df = ent.with_ranked_fields(docs.join(entities, "doc_id"), "entities")
        return ent.ranked_rows(df).drop("start", "end").collect()

    assert ranked(nested) == ranked(array)


def test_unseen_candidates_against_a_loop(spark):
    rng = random.Random(5)
    candidates = [(rng.randrange(3), rng.choice("AB"), rng.choice("xyz"), i) for i in range(60)]
    known = [(rng.randrange(3), rng.choice("AB"), rng.choice("xyz")) for _ in range(6)] * 50
    first = {}
    for d, f, value, i in candidates:
        first.setdefault((d, f, value), i)
    expected = {(*k, i) for k, i in first.items() if k not in set(known)}
    c = spark.createDataFrame(
        [(d, f, value, i, 0.5, i, i + 1) for d, f, value, i in candidates],
        "doc_id int, field_name string, value string, arrival int, confidence double, start int, end int",
    )
    k = spark.createDataFrame(known, "doc_id int, field_name string, value string")
    got = {(r.doc_id, r.field_name, r.value, r.start) for r in ent.unseen_candidates(c, k).collect()}
    assert got == expected


def test_one_document_with_most_of_the_matches(spark):
    """A text with 60,000 numbers beside small ones: nothing is cut, and the work is about linear."""
    big = " ".join(f"{i % 97},{i % 1000:03d}" for i in range(60_000))
    rows = [(0, big)] + [(i, f"$ {i} {i}") for i in range(1, 50)]
    df = spark.createDataFrame(rows, "doc_id int, text string")
    ranked = ent.with_ranked_fields(df)
    sizes = {r.doc_id: r.n for r in ranked.select("doc_id", F.size("ranked").alias("n")).collect()}
    expected = {m.group() for m in re.finditer(v.AMOUNT_PATTERNS[1], big)}
    assert sizes[0] == len(expected)
    first = ent.ranked_rows(ranked.filter("doc_id = 0")).orderBy(F.desc("start")).first()
    assert big[first.start : first.end] == first.value


def test_values_of_texts_are_ranked_as_candidates_are(spark):
    """Short texts type by type, long ones and those with many entities by sorting: the same fields but for their places."""
    page = "$1,000.50 SSN 123-45-6789 or 123456789, 12-3456789, 01/02/2023 1-2-2023 March 5, 2023 $1,000.50 é 漢 7\u0001 7"
    model = [("MONEY", "$1,000.50", 0.9), ("MONEY", "$1,000.50", 0.95), ("MONEY", "7", 0.2), ("MONEY", "x", 0.8), ("MONEY", "y", 0.1)]
    model += [("DATE", None, 0.31), ("DATE", None, 0.9), ("DATE", "01/02/2023", float("nan")), ("DATE", "z", 0.1), ("DATE", "z", 0.9), ("NONE", "q", 0.9)]
    texts = [page, page * 20, "", None]
    rows = [(t, None if e is None else [(*x, 0, 1) for x in e]) for t in texts for e in (None, [], model, model * 9)]
    entity = "array<struct<entity_group:string,word:string,score:double,start:int,end:int>>"
    docs = spark.createDataFrame(rows, f"text string, entities {entity}")

    def kept(ranked):
        names = ("type_ord", "field_name", "field_rank", "value", "confidence")
        return F.to_json(F.transform(ranked, lambda f: F.struct(*[f[n].alias(n) for n in names])))

    whole = ranked_fields(ent.all_candidates(F.col("text"), F.col("entities")))
    for old, new in docs.select(kept(whole), kept(ranked_values(F.col("text"), F.col("entities")))).collect():
        assert old == new
    plain = docs.select(F.size(ranked_values(F.col("text"))).alias("n")).distinct().collect()
    assert {r.n for r in plain} >= {0}


def test_places_are_not_looked_for_where_nobody_reads_them(spark):
    docs = spark.createDataFrame([(1, "SSN 518-52-8063")], "doc_id int, text string")
    got = ent.with_ranked_fields(docs, places=False).first().ranked
    assert [(f.field_name, f.value, f.start) for f in got][0] == ("SSN", "518-52-8063", None)
    assert ent.with_ranked_fields(docs).first().ranked[0].start == 4
