"""The whole pipeline against a brute-force version, and the helpers that deal with hot keys."""

from collections import Counter

import duckdb
import numpy as np
from pyspark.sql import functions as F
from test_llm_queries import brute_components, brute_fingerprint, brute_tokens, words_of

import corpus_pipeline
from formwright.llm import common, quality
from formwright.llm.queries import quality_model


def leaks_into(text, items):
    words = np.array(brute_tokens(text), dtype=object)
    for own in items:
        span = min(len(own), 13)
        if not len(own) or len(words) < span:
            continue
        same = (words[:, None] == own[None, :]).astype(int)
        counts = sum(same[j : len(words) - span + 1 + j, j : len(own) - span + 1 + j] for j in range(span))
        if (counts >= span - (span // 5 if span >= 8 else 0)).any():
            return True
    return False


def test_pipeline_against_brute_force(spark, sf_dir):
    con = duckdb.connect()
    docs = con.execute(f"SELECT doc_id, text FROM '{sf_dir}/documents.parquet'").fetchall()
    items = [np.array(brute_tokens(t), dtype=object) for (t,) in con.execute(f"SELECT text FROM '{sf_dir}/benchmark.parquet'").fetchall()]
    net = quality_model(spark, sf_dir)
    docs = [(k, t or "") for k, t in docs if net.score((t or "").encode()) >= quality.THRESHOLD]
    least = brute_components([k for k, _ in docs], [brute_fingerprint(t) for _, t in docs])
    docs = [(k, t) for k, t in docs if least[k] == k]
    seen = Counter()
    split = {k: words_of(t) for k, t in docs}
    for w in split.values():
        seen.update(tuple(w[i : i + 35]) for i in range(len(w) - 34))
    shorter = []
    for k, t in docs:
        w = split[k]
        gone = {j for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1 for j in range(i, i + 35)}
        shorter.append((k, " ".join(x for j, x in enumerate(w) if j not in gone) if gone else t))
    docs = [(k, t) for k, t in shorter if not leaks_into(t, items)]

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    expected = {k: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for k, t in docs}
    rows = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id: r.doc_tokens for r in rows} == expected
    lengths = Counter()
    for r in rows:
        lengths[r.doc_id] += r.length
    assert lengths == expected


def test_hot_keys_join_like_any_other(spark):
    rows = spark.range(5000).select("id", F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") % 1000 + 100).alias("key"))
    counted = rows.groupBy("key").agg(F.count("*").alias("n")).where("key <> 101").withColumn("name", F.col("key") * 2)
    for how in ("left", "inner", "left_semi"):
        got = common.join_counted(rows, counted, ["key"], "n", how, share=10)
        plain = rows.join(counted, "key", how).select(*got.columns)
        assert sorted(map(tuple, got.fillna(-1).collect())) == sorted(map(tuple, plain.fillna(-1).collect()))


def test_bitmap_has_what_went_in(spark):
    values = spark.range(1000).select(F.xxhash64("id").alias("x"))
    bits = np.frombuffer(common.bitmap(values, F.col("x"), 16), np.uint8)
    inside = np.array([r.x for r in values.collect()], np.int64).view(np.uint64)
    assert common.in_bitmap(bits, inside, 16).all() and len(bits) == 1 << 13
    assert common.in_bitmap(bits, np.arange(1 << 16, dtype=np.uint64), 16).sum() <= 1000


def test_hashes_tell_sequences_apart():
    h = common.RollingHash(5)
    texts = [b"a b c d", b"a b d c", b"ab c d", b"a bc d", b"", b" a  b\tc\nd "]
    lists = [h.words(t) for t in texts]
    assert np.array_equal(lists[0], lists[5]) and len(lists[4]) == 0
    assert len({tuple(x) for x in map(np.ndarray.tolist, lists)}) == 5
    long = " ".join(f"w{i}" for i in range(400_000)).encode()
    assert len(common.pieces(long)) > 1 and b"".join(common.pieces(long)) == long
    words = h.words(long)
    assert len(words) == 400_000 == len(set(words.tolist()))
    assert h.windows(words, 35)[123_456] == h.windows(words[123_456 : 123_456 + 35], 35)[0]
