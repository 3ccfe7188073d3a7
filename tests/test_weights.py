"""Weights by provider, and result batches that are written again."""

import pytest
from pyspark.sql import functions as F

from formwright.functions.scoring import normalized_weights
from formwright.operators.weights import provider_weights, with_weights
from formwright.sources import sinks

ROWS = [("a", "ocr", 2.0), ("a", "ner", 1.0), ("a", "validation", 1.0), ("b", "ocr", 1.005), ("c", "ocr", 0.0),
        (None, "ocr", 1.0), ("d", "other", 1.0), ("d", "ner", None), ("d", "ocr", 1.0), ("d", "ocr", 3.0)]


@pytest.fixture(scope="module")
def weights(spark):
    return spark.createDataFrame(ROWS, "provider string, part string, weight double")


def test_sets_follow_the_rule_for_one_set(weights):
    found = {r.provider: r.weights.asDict() for r in provider_weights(weights).collect()}
    assert found["a"] == normalized_weights({"ocr": 2.0, "ner": 1.0, "validation": 1.0})
    assert found["b"] == normalized_weights({"ocr": 1.005, "ner": 0.0, "validation": 0.0})
    assert found["d"] == {"ocr": 1.0, "ner": 0.0, "validation": 0.0}
    assert set(found) == {"a", "b", "d"}


@pytest.mark.parametrize("limit", [0, 1 << 20])
def test_both_joins_give_every_document_its_weights(spark, weights, limit):
    docs = spark.range(400).select(
        F.col("id").alias("doc_id"), F.expr("element_at(array('a', 'b', 'c', 'x', NULL), int(id % 5) + 1)").alias("provider")
    )
    out = with_weights(docs, weights, broadcast_bytes=limit)
    assert out.columns == ["doc_id", "provider", "weights"]
    rows = out.collect()
    assert sorted(r.doc_id for r in rows) == list(range(400))
    assert {(r.provider, r.weights.ocr, r.weights.ner) for r in rows} == {
        ("a", 0.5, 0.25), ("b", 1.005, 0.0), ("c", 0.3, 0.4), ("x", 0.3, 0.4), (None, 0.3, 0.4)
    }


def test_no_sets_and_no_documents(spark, weights):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, provider string")
    assert with_weights(docs, weights.limit(0)).first().weights.ner == 0.4
    assert with_weights(docs.limit(0), weights).count() == 0


def test_a_batch_written_again_replaces_only_itself(spark, tmp_path):
    path = str(tmp_path / "batches")
    rows = spark.createDataFrame([(1, "W-2"), (2, "1040"), (3, "1040")], "doc_id long, document_type string")
    sinks.write_batch(rows, path, 0)
    sinks.write_batch(rows, path, 1)
    sinks.write_batch(rows.where("doc_id = 3"), path, 1)
    back = sinks.read_batches(spark, path, rows.schema)
    assert sorted((r.batch_id, r.doc_id, r.document_type) for r in back.collect()) == [
        (0, 1, "W-2"), (0, 2, "1040"), (0, 3, "1040"), (1, 3, "1040")
    ]
    plan = back.where("batch_id = 1 AND document_type = '1040'")._jdf.queryExecution().toString()
    filters = plan[plan.index("PartitionFilters: [") :].split("]")[0]
    assert "batch_id" in filters and "document_type" in filters
    sinks.write_batch(rows.limit(0), path, 0)
    assert {r.batch_id for r in sinks.read_batches(spark, path, rows.schema).collect()} == {1}
