"""Spans of token tables: the same as those of arrays, whatever the blocks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formwright.operators import tokens as tok

SCHEMA = "seq_id long, tokens array<string>, tags array<string>, scores array<double>"
TAGS = np.array(["O", "B-SSN", "I-SSN", "B-DATE", "I-DATE", None], dtype=object)


@pytest.fixture(scope="module")
def sequences(spark):
    rng = np.random.default_rng(5)
    rows = []
    # One sequence has most of all tokens; one is a single span; one has no tokens.
    for key, n in ((1, 3000), (2, 7), (3, 0), (None, 40), (5, 1)):
        rows.append((key, [f"t{i}" for i in range(n)], rng.choice(TAGS, n).tolist(), rng.random(n).round(3).tolist()))
    rows.append((6, [f"u{i}" for i in range(500)], ["B-SSN"] + ["I-SSN"] * 499, [0.5] * 500))
    return spark.createDataFrame(rows, SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.mark.parametrize("block", [1, 7, 64, tok.BLOCK])
def test_equal_to_arrays(sequences, block):
    table = tok.token_rows(sequences, tag=F.col("tags"), score=F.col("scores"))
    assert rows_of(tok.spans_of_rows(table, block)) == rows_of(tok.span_rows(sequences))


def test_gaps_nulls_and_empty(spark):
    schema = "seq_id string, pos int, token string, tag string, score double, block int, span string"
    rows = [
        ("a", 10, "x", "B-SSN", 0.5, 1, "q"),
        ("a", 20, None, "I-SSN", 0.7, 1, "q"),
        ("a", 30, "z", None, 0.7, 1, "q"),
        ("a", 40, "w", "I-SSN", None, 1, "q"),
        ("a", None, "v", "B-SSN", 0.1, 1, "q"),
        (None, 1, "n", "B-DATE", 1.0, None, None),
    ]
    got = rows_of(tok.spans_of_rows(spark.createDataFrame(rows, schema), 16))
    assert got == sorted(
        [("a", "SSN", "x", 0.6, 10, 21), ("a", "SSN", "w", None, 40, 41), (None, "DATE", "n", 1.0, 1, 2)], key=str
    )
    assert tok.spans_of_rows(spark.createDataFrame([], schema)).count() == 0


def test_no_sequence_in_one_task(sequences):
    """Tokens are dealt by sequence and block; only a row per block is dealt by sequence alone."""
    table = tok.token_rows(sequences, tag=F.col("tags"), score=F.col("scores"))
    plan = tok.spans_of_rows(table, 64)._jdf.queryExecution().optimizedPlan().toString()
    for line in plan.splitlines():
        if "Window [" in line and "block" not in line.split("], [", 1)[-1]:
            raise AssertionError(line)
