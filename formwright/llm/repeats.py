"""Removal of word windows that occur more than once, by Rabin-Karp hashes counted in Spark.

Hashes of all windows of a large corpus are several times its size. So that they need not all be shuffled,
neighbouring windows are counted together first, without losing any:

- A window's anchor is the `GRAM`-word sequence in it with the least hash (the leftmost, if equal). Equal
  windows have equal anchors at equal places. A run is all consecutive windows with one anchor; on average
  it holds about fourteen. Runs are counted by the hash of their words.
- Runs whose anchor's hash occurs once in the corpus hold no repeated window.
- Runs that occur twice or more as a whole are repeated as a whole.
- What is left are anchors that differing runs share, as at the ends of copied passages. One run of each
  kind is resolved into its windows, whose own hashes are then counted.

Hashes of windows and runs are two independent ones of 64 bits each. All counting is by grouped aggregation,
and rows come back by joins that Spark splits where a passage is very frequent.
"""

from __future__ import annotations

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from formwright.functions.arrays import let
from formwright.llm.common import (
    U64,
    WORD,
    RollingHash,
    bitmap,
    fresh,
    in_bitmap,
    join_counted,
    map_rows,
    mix,
    row_key,
    signed,
    text_bytes,
    written,
)

WINDOW = 35
GRAM = 8
#: The filter of documents worth a join takes 2**BITS / 8 bytes: 2 MiB.
BITS = 24
#: Windows searched for their anchors at a time.
BLOCK = 1 << 16

HASHES = RollingHash(11), RollingHash(23)
RUNS = "k1 long, k2 long, v long, r1 long, r2 long, a int, n int"


def runs_of(data: bytes, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(v, r1, r2, a, n) of a text's runs: anchor hash, hashes of the run, first window, number of windows."""
    words = [h.words(data) for h in HASHES]
    count = len(words[0]) - width + 1
    if count <= 0:
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    grams = HASHES[0].windows(words[0], gram)
    span = width - gram + 1
    at = np.concatenate(
        [
            sliding_window_view(grams[i : i + BLOCK + span - 1], span).argmin(axis=1) + np.arange(i, min(i + BLOCK, count))
            for i in range(0, count, BLOCK)
        ]
    )
    first = np.flatnonzero(np.diff(at, prepend=-1))
    n = np.diff(first, append=count)
    end = first + n + width - 1
    where = (at[first] - first).astype(U64)
    runs = [signed(mix(h.ranges(h.prefix(w), first, end) + where)) for h, w in zip(HASHES, words)]
    return signed(grams[at[first]]), *runs, first, n


def _runs(source: DataFrame, width: int, gram: int) -> DataFrame:
    def rows(columns):
        found = [runs_of(data, width, gram) for data in columns["text"]]
        sizes = [len(f[0]) for f in found]
        out = {k: np.repeat(np.array(columns[k], np.int64), sizes) for k in ("k1", "k2")}
        for i, name in enumerate(("v", "r1", "r2", "a", "n")):
            out[name] = np.concatenate([f[i] for f in found])
        return out

    return map_rows(source, rows, RUNS)


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """(k1, k2, s, w1, w2): the windows of each document's `runs`."""

    def rows(columns):
        out = {name: [] for name in ("k1", "k2", "s", "w1", "w2")}
        for k1, k2, data, runs in zip(columns["k1"], columns["k2"], columns["text"], columns["runs"]):
            starts = np.concatenate([np.arange(r["a"], r["a"] + r["n"]) for r in runs])
            for name, h in zip(("w1", "w2"), HASHES):
                out[name].append(signed(h.windows(h.words(data), width)[starts]))
            out["s"].append(starts)
            out["k1"].append(np.full(len(starts), k1, np.int64))
            out["k2"].append(np.full(len(starts), k2, np.int64))
        return {name: np.concatenate(parts) for name, parts in out.items()}

    return map_rows(docs, rows, "k1 long, k2 long, s int, w1 long, w2 long")


def may_have(keys: DataFrame):
    """A test on (k1, k2): false only for documents that are not in `keys`; of a fixed size."""
    shared = keys.sparkSession.sparkContext.broadcast(bitmap(keys, F.xxhash64("k1", "k2"), BITS))

    @pandas_udf("boolean")
    def test(key):
        import pandas as pd

        return pd.Series(in_bitmap(np.frombuffer(shared.value, np.uint8), key.to_numpy().view(U64), BITS))

    return test


def repeated_intervals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW
) -> DataFrame:
    """(k1, k2, intervals): for documents with repeated windows, the maximal runs of words they cover.

    `intervals` is an ordered array of (first, end), in words, the end not included.
    """
    gram = min(GRAM, width)
    source = docs.select(*row_key(doc_id, text), text_bytes(text).alias("text"))
    runs = written(_runs(source, width, gram), "runs")
    anchors = written(runs.groupBy("v").agg(F.count("*").alias("c")).where("c > 1"), "anchors")
    shared = written(join_counted(runs, anchors, ["v"], "c", "left_semi"), "shared-runs")
    kinds = written(
        shared.groupBy("v", "r1", "r2").agg(F.count("*").alias("c"), F.min(F.struct("k1", "k2", "a", "n")).alias("one")),
        "run-kinds",
    )
    mixed = written(kinds.groupBy("v").agg(F.count("*").alias("kinds")).where("kinds > 1"), "mixed-anchors")
    samples = written(join_counted(kinds, mixed, ["v"], "kinds", "left_semi").select("one.*", "c"), "mixed-runs")
    wanted = samples.groupBy("k1", "k2").agg(F.collect_list(F.struct("a", "n")).alias("runs"))
    may = may_have(samples)
    windows = written(
        _windows(source.where(may(F.xxhash64("k1", "k2"))).join(wanted, ["k1", "k2"]), width), "mixed-windows"
    )
    again = written(windows.groupBy("w1", "w2").agg(F.count("*").alias("c")).where("c > 1"), "repeated-windows")
    whole = join_counted(shared, kinds.where("c > 1"), ["v", "r1", "r2"], "c", "left_semi").select(
        "k1", "k2", F.col("a").alias("first"), (F.col("a") + F.col("n") + (width - 1)).alias("end")
    )
    single = join_counted(windows, again, ["w1", "w2"], "c", "left_semi").select(
        "k1", "k2", F.col("s").alias("first"), (F.col("s") + width).alias("end")
    )
    gathered = whole.unionByName(single).groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "end")).alias("parts"))

    def merged(columns):
        return {
            "k1": columns["k1"],
            "k2": columns["k2"],
            "intervals": [merge([(p["first"], p["end"]) for p in parts]) for parts in columns["parts"]],
        }

    return map_rows(gathered, merged, "k1 long, k2 long, intervals array<struct<first: int, end: int>>")


def merge(parts: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Overlapping and adjoining intervals as one."""
    out: list[list[int]] = []
    for first, end in sorted(parts):
        if out and first <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return [{"first": first, "end": end} for first, end in out]


def with_intervals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW, name: str = "intervals"
) -> DataFrame:
    """`docs` with the column `name`: the maximal intervals of repeated words, empty where there are none.

    Windows in other documents and in the same one count alike; texts with fewer words than a window have
    none, nor have null and empty ones. A repeated row repeats its windows. An existing column of that name
    is not touched: underscores are put in front. An empty table stays empty.
    """
    name = fresh(docs, name)
    found = written(repeated_intervals(docs, doc_id, text, width), "intervals")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    first, second = row_key(doc_id, text)
    keyed = docs.withColumns({k1: first, k2: second})
    named = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("intervals").alias(name))
    may = may_have(found)(F.xxhash64(k1, k2))
    none = F.expr("cast(array() AS array<struct<first: int, end: int>>)")
    columns = [*docs.columns, name]
    hit = keyed.where(may).join(named, [k1, k2], "left")
    return (
        hit.withColumn(name, F.coalesce(name, none)).select(*columns)
        .unionByName(keyed.where(~may).withColumn(name, none).select(*columns))
    )


def kept_words(data: bytes, intervals: list[dict[str, int]]) -> tuple[int, list[bytes]]:
    """How many words the text has, and those outside the intervals."""
    words = data.split()
    n, out, at = len(words), [], 0
    for part in intervals:
        out += words[at : part["first"]]
        at = part["end"]
    return n, out + words[at:]


def without_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WINDOW) -> DataFrame:
    """`docs` with the repeated words removed from their texts; texts without any stay as they are, null ones too.

    What is kept of a text is joined by single blanks, and is empty if nothing is kept. The words are cut out by
    functions of Spark, one text at a time and only of texts that lose some, so no batch of texts is held.
    An empty table stays empty.
    """
    name = fresh(docs, "intervals")
    found = with_intervals(docs, doc_id, text, width, name)
    words = F.regexp_extract_all(F.col(text), F.lit(f"({WORD})"), F.lit(1))
    firsts = F.transform(name, lambda p: p["first"])
    ends = F.transform(name, lambda p: p["end"])

    def kept(words):
        gaps = F.zip_with(
            F.array_prepend(ends, F.lit(0)),
            F.array_append(firsts, F.size(words)),
            lambda start, end: F.slice(words, start + 1, end - start),
        )
        return F.array_join(F.flatten(gaps), " ")

    changed = F.when(F.size(name) > 0, let(words, kept)).otherwise(F.col(text))
    return found.withColumn(text, changed).select(*docs.columns)
