"""SimHash near-duplicates whose candidates come from chains of segments on a ring.

A fingerprint is cut into `SEGMENTS` segments, seen as a ring. If two fingerprints differ in at most
`budget` bits, then from at least one segment on every chain of consecutive segments stays within its
proportional share: its first l segments differ in at most l * budget / SEGMENTS bits. With four segments
and three bits: none in the first, one in the first two, two in the first three. The first two conditions
become an equi-join on 32 bits (one side lists the second segment's single-bit changes), the third prunes
the candidates, and the full distance is only then taken.

Fingerprints are grouped first, so a text's copies take part once, however many there are.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import (
    UPPER_TO_LOWER,
    fresh,
    hot_and_cold,
    join_counted,
    map_rows,
    row_key,
    text_bytes,
    written,
)

SEGMENTS = 4
SEGMENT_BITS = 16
SHINGLE = 3
BUDGET = 3
#: Shingles hashed at a time within one text.
BLOCK = 1 << 16

_FULL = (1 << SEGMENT_BITS) - 1


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """A bit is set if more than half of the shingles' hashes have it; 0 for a text without words."""
    words = text.translate(UPPER_TO_LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    if len(words) > shingle:
        starts, ends = starts[: 1 - shingle] if shingle > 1 else starts, ends[shingle - 1 :]
    else:
        starts, ends = starts[:1], ends[-1:]
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for i in range(0, len(starts), BLOCK):
        a, b = starts[i : i + BLOCK].tolist(), ends[i : i + BLOCK].tolist()
        hashes = np.array([digest(joined[x:y], 42) for x, y in zip(a, b)], dtype=">u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(k1, k2, doc_id, fp): one row a document; null texts have no words."""

    def rows(columns):
        prints = [_signed(fingerprint(t, shingle)) for t in columns.pop("text")]
        return {**columns, "fp": prints}

    source = docs.select(
        *row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")
    )
    return map_rows(source, rows, "k1 long, k2 long, doc_id long, fp long")


def _segment(fp: str, i: int) -> Column:
    """Segment `i` of the ring, the highest bits first."""
    return F.expr(f"shiftrightunsigned({fp}, {64 - SEGMENT_BITS * (i % SEGMENTS + 1)}) & {_FULL}")


def links(classes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """(a, b), a < b: all pairs of distinct `fp` that differ in 1 to `budget` bits, each once.

    The key holds what the first two conditions of a chain demand at up to 3 bits; a larger budget would
    need other segments.
    """
    if budget * 2 // SEGMENTS > 1 or budget >= SEGMENTS:
        raise ValueError("chains of four segments hold for at most three bits")
    flips = F.array(F.lit(0).cast("long"), *[F.lit(1 << j).cast("long") for j in range(SEGMENT_BITS)])
    near = flips if budget * 2 // SEGMENTS else F.array(F.lit(0).cast("long"))
    starts = F.array(*[F.struct(F.lit(i).alias("i"), _segment("fp", i).alias("x"), _segment("fp", i + 1).alias("y")) for i in range(SEGMENTS)])
    rows = classes.select("fp", F.inline(starts))
    key = F.col("i").cast("long") * F.lit(1 << 32) + F.col("x") * F.lit(1 << SEGMENT_BITS)
    left = rows.select(F.col("fp").alias("a"), "i", (key + F.col("y")).alias("key"))
    right = rows.select(
        F.col("fp").alias("b"), key.alias("key"), "y", F.explode(near).alias("flip")
    ).select("b", (F.col("key") + F.col("y").bitwiseXOR(F.col("flip"))).alias("key"))
    differ = F.expr("a ^ b")
    # The chain's first three segments, as bits of the difference turned so that segment i is the highest.
    turned = F.expr(
        f"shiftleft(a ^ b, {SEGMENT_BITS} * i) | CASE WHEN i = 0 THEN 0L "
        f"ELSE shiftrightunsigned(a ^ b, 64 - {SEGMENT_BITS} * i) END"
    )
    chain = F.bit_count(F.shiftrightunsigned(turned, 64 - 3 * SEGMENT_BITS)) <= budget * 3 // SEGMENTS
    # Both sides are many times the table they come from, by whose size Spark would choose to broadcast one.
    pairs = left.hint("merge").join(right.hint("merge"), (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & chain & (F.bit_count(differ) <= budget))
    return pairs.select("a", "b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): for every node of the written edges (a, b) the smallest node it can reach.

    Alternates large and small stars until nothing changes. Each is a grouped minimum joined back with its
    edges, so no neighbourhood is gathered in one place. Every round is a written table.
    """
    before = None
    stars = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    while True:
        stars = written(stars, "stars")
        state = stars.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))"), F.sum(F.col("u") % 1000003)).first()
        if state == before or not state[0]:
            break
        before = state
        both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        stars = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .unionByName(least.select("u", F.col("m").alias("v")))
            .distinct()
        )
    roots = stars.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())


def _grouped(docs: DataFrame, doc_id: str, text: str, shingle: int, budget: int) -> tuple[DataFrame, DataFrame]:
    """The rows as (k1, k2, doc_id, fp), and one row a fingerprint: (fp, n, component_id, root, n_links)."""
    prints = written(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    classes = written(
        prints.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "classes"
    )
    pairs = written(links(classes.select("fp"), budget), "links")
    return prints, grouped(classes, pairs)


def grouped(classes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(fp, n, component_id, root, n_links): the written classes (fp, first, n), grouped by their written links."""
    degrees = pairs.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    roots = components(pairs).select(F.col("node").alias("fp"), "root")
    smallest = classes.join(roots, "fp").groupBy("root").agg(F.min("first").alias("smallest"))
    linked = roots.join(smallest, "root").join(degrees, "fp")
    found = classes.join(linked, "fp", "left").select(
        "fp",
        "n",
        F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("smallest")).alias("component_id"),
        F.coalesce("root", "fp").alias("root"),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
    return written(found, "components")


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """(doc_id, fp, component_id, n_links), a row for each row of `docs`.

    `component_id` is the smallest id that can be reached over links of at most `budget` bits, `n_links` the
    number of other fingerprints within that distance. Texts without words (null, empty, blanks) have
    fingerprint 0, and are linked like any other. Null ids are never the smallest; a component of null ids
    alone has a null one. Repeated rows and ids stay as they are. An empty table gives an empty result.
    """
    prints, found = _grouped(docs, doc_id, text, shingle, budget)
    return join_counted(prints, found, ["fp"], "n").select("doc_id", "fp", "component_id", "n_links")


def one_of_each(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, budget: int = BUDGET
) -> DataFrame:
    """One row of each component, in the columns of `docs`: of the smallest id, of that id the first text by hash.

    Rows without an id stay only if their whole component has none; repeated rows count as one document. Those
    repeated very often are merged where they lie, before any shuffle.
    """
    return first_of_each(docs, *_grouped(docs, doc_id, text, shingle, budget), doc_id, text)


def first_of_each(docs: DataFrame, prints: DataFrame, found: DataFrame, doc_id: str, text: str) -> DataFrame:
    """What `one_of_each` keeps, by the rows' prints (k1, k2, doc_id, fp) and their components."""
    kept = (
        join_counted(prints, found, ["fp"], "n")
        .where(F.col("doc_id").eqNullSafe(F.col("component_id")))
        .groupBy("root", "k1", "k2")
        .agg(F.count("*").alias("n"))
        .groupBy("root")
        .agg(F.min(F.struct("k1", "k2", "n")).alias("row"))
        .select("row.*")
    )
    hot, cold = hot_and_cold(written(kept, "kept"), "n")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    first, second = row_key(doc_id, text)
    rows = docs.withColumns({k1: first, k2: second})
    often, seldom = (part.select(F.col("k1").alias(k1), F.col("k2").alias(k2)) for part in (hot, cold))
    often = F.broadcast(often)
    merged = rows.join(often, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    others = rows.join(often, [k1, k2], "left_anti").join(seldom, [k1, k2], "left_semi").dropDuplicates([k1, k2])
    return merged.unionByName(others).select(*docs.columns)
