"""Documents end to end: results, accepted values, checks, weights."""

import pytest
from pyspark.sql import functions as F

from formwright import DocumentEngine
from formwright.functions.scoring import (
    SCORED_FIELDS,
    confidence_summary,
    document_check,
    normalized_weights,
    structured_values,
)
from formwright.operators.entities import nest_entities
from formwright.operators.text_assembly import assemble_text, text_lines, with_text
from formwright.plans import catalog


def fields(*rows):
    """Scored fields from (name, value, confidence)."""
    return [(0, n, i, x, c, 0.9, c, 0.9, None, None) for i, (n, x, c) in enumerate(rows)]


def one(spark, rows, column):
    df = spark.createDataFrame([(rows,)], f"fields {SCORED_FIELDS}")
    return df.select(column).first()[0]


def test_structured_values_drop_low_confidence(spark):
    rows = fields(
        ("SSN", "123-45-6789", 0.9), ("WAGE_AMOUNT", "$50,000.00", 0.8), ("EMPLOYER_NAME", "ABC", 0.3)
    )
    got = one(spark, rows, structured_values(F.col("fields")))
    assert [(r.field_name, r.value) for r in got] == [
        ("SSN", "123-45-6789"), ("WAGE_AMOUNT", "$50,000.00"), ("EMPLOYER_NAME", None)
    ]


def test_structured_values_last_row_wins(spark):
    rows = fields(("SSN", "a", 0.9), ("SSN", "b", 0.6), ("DATE", "c", 0.9), ("DATE", "d", 0.5))
    got = one(spark, rows, structured_values(F.col("fields")))
    assert [(r.field_name, r.value) for r in got] == [("SSN", "b"), ("DATE", None)]


def check(spark, rows, mean, kind="W-2", expected=None, seconds=2.5):
    column = document_check(
        F.col("fields"), F.lit(mean), F.lit(kind), F.lit(expected).cast("string"), F.lit(seconds)
    )
    return one(spark, rows, column)


def test_check_valid(spark):
    rows = fields(("SSN", "x", 0.9), ("WAGE_AMOUNT", "y", 0.8), ("EMPLOYER_NAME", "z", 0.6))
    got = check(spark, rows, 0.85, expected="W-2")
    assert (got.is_valid, got.issues, got.warnings, got.confidence_score) == (True, [], [], 0.85)


def test_check_wrong_type_is_a_warning(spark):
    got = check(spark, [], 0.85, expected="1099-R")
    assert got.is_valid
    assert got.warnings == [
        "Expected 1099-R, got W-2", "Missing critical fields: SSN, WAGE_AMOUNT, EMPLOYER_NAME"
    ]


def test_check_low_confidence_is_an_issue(spark):
    got = check(spark, fields(("SSN", "x", 0.5)), 0.3, seconds=10.126)
    assert not got.is_valid
    assert got.issues == ["Low overall confidence score"]
    assert got.warnings[-1] == "Slow processing time: 10.13s"
    assert "SSN" in got.warnings[0]  # 0.5 is not above the threshold


def test_summary_bands_and_population_deviation(spark):
    got = one(spark, fields(("A", "", 0.8), ("A", "", 0.5), ("A", "", 0.2)), confidence_summary(F.col("fields")))
    assert (got.total_results, got.high_confidence_count, got.medium_confidence_count) == (3, 1, 1)
    assert got.average_confidence == pytest.approx(0.5)
    assert got.confidence_std == pytest.approx(0.244949, abs=1e-6)
    empty = one(spark, [], confidence_summary(F.col("fields")))
    assert (empty.total_results, empty.average_confidence, empty.confidence_std) == (0, 0.0, None)


def test_weights():
    assert normalized_weights() == normalized_weights({}) == {"ocr": 0.3, "ner": 0.4, "validation": 0.3}
    assert normalized_weights({"ocr": 2, "ner": 1, "validation": 1}) == {
        "ocr": 0.5, "ner": 0.25, "validation": 0.25
    }
    close = {"ocr": 0.3, "ner": 0.4, "validation": 0.305}
    assert normalized_weights(close) == close


def test_process_result_shape(spark):
    docs = spark.createDataFrame(
        [(1, "SSN 518-52-8063", 0.9, "a.jpg", 2.5), (2, None, 0.0, "b.jpg", 1.0)],
        "doc_id int, text string, ocr_confidence double, path string, processing_time_seconds double",
    )
    got = {r.doc_id: r for r in DocumentEngine(as_of="2026-01-01").process(docs).collect()}
    first = got[1]
    ssn = first.extracted_fields[0]
    assert (ssn.field_name, ssn.value, ssn.start_position, ssn.end_position) == ("SSN", "518-52-8063", 4, 15)
    assert ssn.confidence == pytest.approx(0.9)
    assert first.processing_metadata.processing_time_seconds == 2.5
    assert first.processing_metadata.image_path == "a.jpg"
    assert first.confidence_summary.total_results == len(first.extracted_fields) == 4
    assert (got[2].extracted_fields, got[2].document_type) == ([], "Unknown")


def test_lines_boxes_and_text(spark):
    df = spark.createDataFrame([(1, " ab \n\n \t\nc\n")], "doc_id int, raw string")
    got = with_text(df.withColumn("lines", text_lines(F.col("raw")))).first()
    assert [(x.line_no, x.text, x.confidence) for x in got.lines] == [(0, "ab", 0.9), (3, "c", 0.9)]
    assert got.lines[1].bbox == [[0, 60], [10, 60], [10, 80], [0, 80]]
    assert got.lines[0].bbox[1] == [40, 0]
    assert (got.text, got.ocr_confidence) == ("ab c", pytest.approx(0.9))


def test_assembled_table_equals_rows(spark):
    """Blocks of two lines, and a document without lines."""
    rows = [(1, i, f"t{i}", i / 10) for i in range(7)] + [(2, 0, "only", 0.5)]
    lines = spark.createDataFrame(rows, "doc_id int, line_no int, text string, confidence double")
    docs = spark.createDataFrame([(1,), (2,), (3,)], "doc_id int")
    got = {r.doc_id: (r.text, r.ocr_confidence) for r in assemble_text(lines, docs, block=2).collect()}
    assert got[1] == ("t0 t1 t2 t3 t4 t5 t6", pytest.approx(0.3))
    assert got[2] == ("only", 0.5)
    assert got[3] == ("", 0.0)


def executed(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["confidence_summary", "document_report", "validate_documents", "best_values"])
def test_documents_are_processed_without_a_shuffle(spark, sf_dir, name):
    plan = executed(catalog.QUERIES[name](spark, sf_dir))
    assert "Exchange" not in plan
    assert "Join" not in plan and "Window" not in plan and "Python" not in plan
    assert "ReadSchema: struct<o_orderkey:bigint,o_orderdate:timestamp_ntz>" in plan


def test_matching_stays_within_the_row(spark, sf_dir):
    plan = executed(catalog.QUERIES["entity_match"](spark, sf_dir))
    assert "Join" not in plan and "Exchange" not in plan
    for name in ("ner_metrics", "ner_doc_match", "ner_per_type"):
        plan = executed(catalog.QUERIES[name](spark, sf_dir))
        assert "hashpartitioning(doc_id" not in plan and plan.count("FileScan") == 1
    tables = executed(catalog.QUERIES["entity_match_tables"](spark, sf_dir))
    assert "Join" not in tables and tables.count("Exchange hashpartitioning") == 1


def test_text_without_lines_is_kept(spark):
    df = spark.createDataFrame(
        [(1, "own", None), (2, "own", [("a", 0.5), ("b", 0.7)]), (3, None, None), (4, "own", [])],
        "doc_id int, text string, lines array<struct<text: string, confidence: double>>",
    )
    got = {r.doc_id: (r.text, r.ocr_confidence) for r in with_text(df).collect()}
    assert got == {1: ("own", 0.8), 2: ("a b", pytest.approx(0.6)), 3: (None, 0.8), 4: ("", 0.0)}


def test_scores_that_are_not_numbers_are_no_matches(spark):
    rows = [(1, "SSN", "x", float("nan"), 0, 1, 0), (1, "SSN", "x", 0.9, 2, 3, 1)]
    table = spark.createDataFrame(
        rows, "doc_id int, entity_group string, word string, score double, start int, end int, ord int"
    )
    nested = nest_entities(table).first().entities
    assert [(e.word, e.score) for e in nested] == [("x", 0.9)]
