"""Near copies by the Jaccard similarity of their word shingles.

Each text gives the set of its `SHINGLE`-word shingles; texts with equal sets are one class. Two classes are
candidates if they agree in a band, `ROWS` minima of the set under hash functions of their own, in any of `BANDS`
bands: at a similarity of 0.8 three pairs in a million agree in none. Candidates are compared by their whole sets,
so every link is exact.

Groups of near copies are large, so their pairs are not all compared. First each class is compared with the
centre of its bands, the one that shares most; then only classes of a band that are still apart.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import (
    U64,
    UPPER_TO_LOWER,
    RollingHash,
    hot_and_cold,
    join_counted,
    map_rows,
    mix,
    row_key,
    signed,
    text_bytes,
    written,
)
from formwright.llm.repeats import may_have
from formwright.llm.simhash import components, first_of_each, grouped

SHINGLE = 5
#: The least similarity of near copies, as a fraction.
LEAST = (4, 5)
BANDS = 24
ROWS = 4
#: Shingles of a text whose minima are taken at a time.
BLOCK = 512

HASH = RollingHash(43)
_NUMBERS = np.arange(1, BANDS * ROWS + 1, dtype=U64)[:, None]
_TURNS = mix(_NUMBERS * U64(0x9E3779B97F4A7C15))
_FACTORS = mix(_NUMBERS * U64(0xC2B2AE3D27D4EB4F)) | U64(1)


def shingles(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """The distinct shingles' hashes in order; a text of fewer words is one shingle, one without words has none."""
    words = HASH.words(text.translate(UPPER_TO_LOWER))
    return np.unique(HASH.windows(words, min(shingle, len(words)))) if len(words) else words


def bands(values: np.ndarray) -> np.ndarray:
    """The bands' keys; none for an empty set."""
    if not len(values):
        return values
    least = np.full(BANDS * ROWS, np.iinfo(U64).max, dtype=U64)
    for i in range(0, len(values), BLOCK):
        np.minimum(least, ((values[None, i : i + BLOCK] ^ _TURNS) * _FACTORS).min(1), out=least)
    return mix((mix(least) * _FACTORS[:, 0]).reshape(BANDS, ROWS).sum(1, dtype=U64) + _TURNS[:BANDS, 0])


def _prints(docs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(k1, k2, doc_id, fp, size, bands): one row a document; `fp` is the key of its set, of `size` shingles."""

    def rows(columns):
        out = {"fp": [], "size": [], "bands": []}
        for content in columns.pop("text"):
            values = shingles(content, shingle)
            out["fp"].append(int(signed(np.array([xxhash.xxh64_intdigest(values.tobytes(), 42)], U64))[0]))
            out["size"].append(len(values))
            out["bands"].append(signed(bands(values)))
        return {**columns, **out}

    source = docs.select(
        *row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")
    )
    return map_rows(source, rows, "k1 long, k2 long, doc_id long, fp long, size int, bands array<long>")


def _sizes_fit(a: str, b: str) -> Column:
    """Whether sets of these sizes can be similar enough."""
    return LEAST[1] * F.least(a, b) >= LEAST[0] * F.greatest(a, b)


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(fp, n, shingles): the sets of the classes in `wanted`, each from one of its rows; `n` is that of `wanted`."""
    places = written(
        classes.select("fp", "at.*", F.col("n").alias("rows")).join(wanted, "fp"), "places"
    )
    keyed = docs.select(*row_key(doc_id, text), text_bytes(text).alias("text"))
    keyed = keyed.where(may_have(places)(F.xxhash64("k1", "k2")))
    # A row that is repeated very often is merged where it lies, as in `first_of_each`.
    hot, cold = hot_and_cold(places, "rows")
    hot = F.broadcast(hot)
    often = keyed.join(hot, ["k1", "k2"]).dropDuplicates(["fp"])
    seldom = keyed.join(hot, ["k1", "k2"], "left_anti").join(cold, ["k1", "k2"]).dropDuplicates(["fp"])

    def rows(columns):
        columns["shingles"] = [signed(shingles(t, shingle)) for t in columns.pop("text")]
        return columns

    found = often.unionByName(seldom).select("fp", "n", "text")
    return map_rows(found, rows, "fp long, n long, shingles array<long>")


def _similar(docs: DataFrame, classes: DataFrame, pairs: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """The pairs (a, b) of the written `pairs` that are similar enough, by their whole sets."""
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n"))
    sets = written(_sets(docs, classes, wanted, doc_id, text, shingle), "shingle-sets")
    first = sets.select(F.col("fp").alias("a"), "n", F.col("shingles").alias("sa"))
    second = sets.select(F.col("fp").alias("b"), "n", F.col("shingles").alias("sb"))
    half = written(join_counted(pairs, first, ["a"], "n", "inner").drop("n"), "half-pairs")
    both = join_counted(half, second, ["b"], "n", "inner").withColumn("common", F.size(F.array_intersect("sa", "sb")))
    either = F.size("sa") + F.size("sb") - F.col("common")
    return both.where(LEAST[1] * F.col("common") >= LEAST[0] * either).select("a", "b")


def links(docs: DataFrame, classes: DataFrame, doc_id: str, text: str, shingle: int) -> DataFrame:
    """(a, b): pairs of similar classes that connect all that candidates connect, each once."""
    buckets = classes.select("fp", "size", F.explode("bands").alias("key"))
    shared = written(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared-bands")
    members = written(join_counted(buckets, shared, ["key"], "n", "inner"), "band-members")
    weights = members.groupBy("fp").agg(F.sum("n").alias("weight"))
    centres = members.join(weights, "fp").groupBy("key").agg(
        F.count("*").alias("n"), F.max(F.struct("weight", "fp", "size")).alias("centre")
    )
    starred = join_counted(members.drop("n"), written(centres, "centres"), ["key"], "n", "inner")
    stars = written(
        starred.where((F.col("fp") != F.col("centre.fp")) & _sizes_fit("size", "centre.size"))
        .select(F.least("fp", "centre.fp").alias("a"), F.greatest("fp", "centre.fp").alias("b"))
        .distinct(),
        "star-pairs",
    )
    near = written(_similar(docs, classes, stars, doc_id, text, shingle), "star-links")

    roots = components(near).select(F.col("node").alias("fp"), "root")
    placed = members.drop("n").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    placed = written(placed, "placed")
    parts = placed.groupBy("key", "root").agg(F.count("*").alias("m"))
    apart = parts.groupBy("key").agg(
        F.sum("m").alias("n"), F.max(F.struct("m", "root")).alias("top"), F.count("*").alias("parts")
    )
    apart = written(apart.where("parts > 1").select("key", "n", F.col("top.root").alias("top")), "apart")
    members = written(join_counted(placed, apart, ["key"], "n", "inner").drop("n"), "apart-members")
    left = members.where("root <> top").select("key", *[F.col(c).alias(f"l_{c}") for c in ("fp", "size", "root")])
    across = left.join(members, "key").where(
        (F.col("l_root") != F.col("root"))
        & ((F.col("root") == F.col("top")) | (F.col("l_fp") < F.col("fp")))
        & _sizes_fit("size", "l_size")
    )
    others = across.select(F.least("fp", "l_fp").alias("a"), F.greatest("fp", "l_fp").alias("b")).distinct()
    others = written(others.join(stars, ["a", "b"], "left_anti"), "other-pairs")
    return near.unionByName(_similar(docs, classes, others, doc_id, text, shingle))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """One row of each component, in the columns of `docs`, chosen as in `simhash.one_of_each`.

    Components are over links of a similarity of `LEAST` or more. Texts without words (null, empty, blanks) are
    one class, which has no links. An empty table gives an empty result.
    """
    prints = written(_prints(docs, doc_id, text, shingle), "shingle-prints")
    classes = written(
        prints.groupBy("fp").agg(
            F.min("doc_id").alias("first"),
            F.count("*").alias("n"),
            F.first("size").alias("size"),
            F.first("bands").alias("bands"),
            F.min(F.struct("k1", "k2")).alias("at"),
        ),
        "shingle-classes",
    )
    pairs = written(links(docs, classes, doc_id, text, shingle), "links")
    found = grouped(classes.select("fp", "first", "n"), pairs)
    return first_of_each(docs, prints.drop("size", "bands"), found, doc_id, text)
