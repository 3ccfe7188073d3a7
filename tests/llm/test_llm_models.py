"""Held-out accuracy of the trained models, and their parts against simple versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from formwright.llm import quality, queries, toxicity

LARGER = "/root/testdata/sf0.1"


@pytest.mark.parametrize(
    "name, label, least", [("op6_quality", "quality", 0.96), ("op8_toxicity", "toxic", 0.97)]
)
def test_held_out(spark, name, label, least):
    found = queries.QUERIES[name](spark, LARGER)
    labels = spark.read.parquet(f"{LARGER}/labels.parquet")
    rows = found.join(labels, "doc_id").where("held_out").select("score", "predicted", F.col(label).alias("label")).collect()
    assert len(rows) > 500
    assert np.mean([r.predicted == r.label for r in rows]) > least
    assert all(0 <= r.score <= 1 for r in rows)
    good, bad = ([r.score for r in rows if r.label == v] for v in (1, 0))
    assert np.mean([[g > b for b in bad[:200]] for g in good[:200]]) > 0.97


def test_held_out_rows_do_not_matter(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    turned = labels.withColumn(
        "quality", F.when(queries.id_fold(4) == 2, 1 - F.col("quality")).otherwise(F.col("quality"))
    )
    usable = queries.id_fold(4) != 2
    a, b = (quality.train(docs, x, "quality", usable) for x in (labels, turned))
    assert np.array_equal(a.table, b.table) and a.offset == b.offset


def test_chunks_cover_every_byte_with_overlap():
    for n in (1, 5, 64, 65, 511, 512, 513, 960, 961, 5000):
        starts = quality.chunk_starts(n)
        ends = np.minimum(starts + quality.CHUNK, n)
        assert starts[0] == 0 and ends[-1] == n
        assert all(a - b == quality.OVERLAP for a, b in zip(ends, starts[1:]))


def test_network_reads_the_whole_text():
    rng = np.random.default_rng(2)
    net = quality.fit([], 1)
    net.table[:] = rng.normal(0, 1, net.table.shape)
    net.weights[:] = rng.normal(0, 1, net.weights.shape)
    for n in (1, 3, 512, 700, 40_000):
        text = rng.integers(97, 122, n).astype(np.uint8).tobytes()
        data = np.frombuffer(text.ljust(quality.WIDTH, b"\0"), np.uint8)
        pooled = []
        for s in quality.chunk_starts(len(data)):
            part = data[s : s + quality.CHUNK]
            if len(part) >= quality.WIDTH:
                windows = [sum(net.table[j][part[i + j]] for j in range(quality.WIDTH)) for i in range(len(part) - quality.WIDTH + 1)]
                pooled.append(np.maximum(np.max(windows, axis=0) + net.bias, 0))
        expected = np.concatenate([np.mean(pooled, axis=0), np.max(pooled, axis=0)])
        np.testing.assert_allclose(net.features(text), expected, rtol=1e-4, atol=1e-5)


def test_one_class_or_none():
    assert quality.fit([], 1).score(b"anything") == pytest.approx(0.5)
    assert quality.fit([([b"some text"], 1)] * 4, 1).score(b"") > 0.9
    none = toxicity.fit(np.zeros((0, len(toxicity.FEATURES))), np.zeros(0), np.zeros(0, bool), {})
    assert none.scores(np.zeros((1, len(toxicity.FEATURES))))[0] == pytest.approx(0.5)


def test_isotonic_is_the_least_squares_monotone_fit():
    rng = np.random.default_rng(4)
    margin = np.round(rng.normal(0, 1, 200), 1)
    y = (rng.random(200) < 1 / (1 + np.exp(-2 * margin))).astype(float)
    at, value = toxicity.isotonic(margin, y)
    assert (np.diff(value) >= 0).all() and (np.diff(at) >= 0).all()
    # Minimax formula of the monotone fit, shrunk in the same way by the sizes of its level sets.
    order = np.argsort(margin, kind="stable")
    m, t = margin[order], y[order]
    keys = np.unique(m)
    sums, sizes = np.array([t[m == k].sum() for k in keys]), np.array([(m == k).sum() for k in keys])
    fit = [
        max(min(sums[a : b + 1].sum() / sizes[a : b + 1].sum() for b in range(i, len(keys))) for a in range(i + 1))
        for i in range(len(keys))
    ]
    fit = np.round(fit, 12)
    shrunk = [(sums[fit == f].sum() + 0.5) / (sizes[fit == f].sum() + 1) for f in fit]
    np.testing.assert_allclose(np.interp(keys, at, value), np.maximum.accumulate(shrunk), atol=1e-9)


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(6)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.5)).astype(float)
    p = toxicity.boost(x, y).margins(x) > 0
    assert (p == y).mean() > 0.98


def test_toxicity_features():
    codes = toxicity.WordCodes({"scum": 3.0, "lowe*": 2.0})
    f = dict(zip(toxicity.FEATURES, toxicity.features("You SCUM! loweiab sc@m wooord a1b?".encode(), codes)))
    assert f["lexicon_density"] == pytest.approx(2 / 6) or f["lexicon_density"] == pytest.approx(3 / 6)
    assert f["lexicon_max"] == 3.0
    assert f["near_second_person"] > 0 and f["second_person"] == pytest.approx(1 / 6)
    assert f["capital_words"] == pytest.approx(1 / 6)
    assert f["obfuscated"] == pytest.approx(2 / 6) and f["drawn_out"] == pytest.approx(1 / 6)
    assert not toxicity.features(b" \n", codes).any()
