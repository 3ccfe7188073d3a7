"""Benchmark decontamination by spaced-seed hashing.

Texts and benchmark items become tokens: A-Z in lower case, ASCII punctuation as blanks. A seed is the hash of
the tokens at a mask's positions; the positions between are ignored, so a substituted token there does not
matter. Seeds of all documents are joined with those of the benchmark, and around each hit the tokens of both
are compared along the diagonal.

An item leaks into a document if some `SPAN` consecutive tokens of it stand in the document with at most
`SPAN` // 5 of them substituted. Items of fewer tokens, but at least `LEAST`, must stand there whole, with at
most a fifth substituted. The three masks are such that each of these overlaps has a seed without a
substitution: the search finds them all. Items shorter than a mask must stand there token by token; each of their
lengths has a mask of its own, without ignored positions.

The seeds of documents are first tested against a bitmap of the benchmark's, whose size is fixed.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import (
    U64,
    UPPER_TO_LOWER,
    RollingHash,
    bitmap,
    fresh,
    in_bitmap,
    map_rows,
    mix,
    row_key,
    signed,
    text_bytes,
    written,
)

#: The token positions that each mask looks at.
MASKS = ((0, 1, 2, 3, 7), (0, 1, 2, 4, 5), (0, 3, 5, 6, 7))
SPAN = 13
#: Shorter items must stand in a document unchanged.
LEAST = 8
#: The bitmap of the benchmark's seeds takes 2**BITS / 8 bytes: 2 MiB. Each seed sets and asks two bits.
BITS = 24
#: Tokens of a document kept to either side of a hit, for every overlap that may hold it.
AROUND = SPAN + 8

HASH = RollingHash(41)
_PUNCTUATION = bytes(i for i in range(128) if not (48 <= i <= 57 or 65 <= i <= 90 or 97 <= i <= 122))
_TOKENS = bytes.maketrans(_PUNCTUATION, b" " * len(_PUNCTUATION))
_FACTORS = mix(np.arange(1, 17, dtype=U64) * U64(0x9E3779B97F4A7C15)) | U64(1)


def tokens(text: bytes) -> np.ndarray:
    """The hashes of a text's tokens."""
    return HASH.words(text.translate(_TOKENS).translate(UPPER_TO_LOWER))


def seeds(values: np.ndarray, mask: tuple[int, ...], number: int) -> np.ndarray:
    """The seed at every position where the mask fits."""
    n = len(values) - mask[-1]
    if n <= 0:
        return np.zeros(0, dtype=U64)
    total = np.full(n, number + 1, dtype=U64)
    for j, at in enumerate(mask):
        total += values[at : at + n] * _FACTORS[j]
    return mix(total)


def allowed(n: int) -> tuple[int, int]:
    """The length of an overlap with an item of `n` tokens, and how many of them may be substituted."""
    span = min(n, SPAN)
    return span, span // 5 if n >= LEAST else 0


def masks_of(n: int) -> list[tuple[int, tuple[int, ...]]]:
    """The numbers and masks of the seeds of an item of `n` tokens."""
    return list(enumerate(MASKS)) if n >= LEAST else [(len(MASKS) + n, tuple(range(n)))]


def _items(benchmark: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_key, item_id, tokens): the items that have tokens, equal texts once, by the smallest id."""
    source = (
        benchmark.select(F.col(item_id).cast("long").alias("item_id"), text_bytes(text).alias("text"))
        .groupBy("text")
        .agg(F.min("item_id").alias("item_id"), F.xxhash64(F.first("text")).alias("item_key"))
    )

    def rows(columns):
        found = [signed(tokens(t)) for t in columns["text"]]
        keep = [i for i, f in enumerate(found) if len(f)]
        return {
            "item_key": [columns["item_key"][i] for i in keep],
            "item_id": [columns["item_id"][i] for i in keep],
            "tokens": [found[i] for i in keep],
        }

    return map_rows(source, rows, "item_key long, item_id long, tokens array<long>")


def _item_seeds(items: DataFrame) -> DataFrame:
    """(seed, item_key, at): every seed of every item."""

    def rows(columns):
        out = {"seed": [], "item_key": [], "at": []}
        for key, values in zip(columns["item_key"], columns["tokens"]):
            words = np.array(values, np.int64).view(U64)
            for number, mask in masks_of(len(words)):
                found = seeds(words, mask, number)
                out["seed"].append(signed(found))
                out["item_key"].append(np.full(len(found), key, np.int64))
                out["at"].append(np.arange(len(found)))
        return {name: np.concatenate(parts) for name, parts in out.items()}

    return map_rows(items, rows, "seed long, item_key long, at int")


HITS = (
    "k1 long, k2 long, doc_id long, first int, around array<long>, "
    "seeds array<struct<seed: long, at: int>>"
)


def _known(bits: np.ndarray, found: np.ndarray) -> np.ndarray:
    """The positions whose seeds the benchmark may have."""
    at = np.flatnonzero(in_bitmap(bits, found, BITS))
    return at[in_bitmap(bits, found[at] >> U64(32), BITS)]


def _hits(docs: DataFrame, filter_bytes, masks: list[tuple[int, tuple[int, ...]]]) -> DataFrame:
    """A row for each stretch of a document with hits in the bitmap: its tokens and its seeds."""

    def rows(columns):
        bits = np.frombuffer(filter_bytes.value, np.uint8)
        out = {"k1": [], "k2": [], "doc_id": [], "first": [], "around": [], "seeds": []}
        for k1, k2, key, text in zip(*(columns[c] for c in ("k1", "k2", "doc_id", "text"))):
            words = tokens(text)
            found = [(s, _known(bits, s)) for s in (seeds(words, m, i) for i, m in masks)]
            at = np.concatenate([a for _, a in found])
            if not len(at):
                continue
            order = np.argsort(at, kind="stable")
            at, values = at[order], np.concatenate([s[a] for s, a in found])[order]
            for part in np.split(np.arange(len(at)), np.flatnonzero(np.diff(at) > AROUND) + 1):
                first = max(0, int(at[part[0]]) - AROUND)
                out["k1"].append(k1)
                out["k2"].append(k2)
                out["doc_id"].append(key)
                out["first"].append(first)
                out["around"].append(signed(words[first : int(at[part[-1]]) + AROUND + 1]))
                out["seeds"].append([{"seed": s, "at": a} for s, a in zip(signed(values[part]).tolist(), at[part].tolist())])
        return out

    return map_rows(docs, rows, HITS)


def overlap(words: np.ndarray, first: int, item: np.ndarray, diagonal: int) -> tuple[int, int, int] | None:
    """(start, length, matches) of the overlap that begins first on a diagonal, if there is one.

    `words` are the document's tokens from position `first` on; item token i stands at document token
    i + `diagonal`.
    """
    span, most = allowed(len(item))
    low, high = max(first, diagonal), min(first + len(words), diagonal + len(item))
    if high - low < span:
        return None
    same = words[low - first : high - first] == item[low - diagonal : high - diagonal]
    sums = np.concatenate(([0], np.cumsum(same)))
    counts = sums[span:] - sums[:-span]
    good = np.flatnonzero(counts >= span - most)
    if not len(good):
        return None
    start, end = int(good[0]), int(good[-1]) + span
    return low + start, end - start, int(sums[end] - sums[start])


def leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(k1, k2, doc_id, item_id, start, n_tokens, n_equal): the items that leak into each document, each once.

    `start` is the document's token where the overlap with the most equal tokens begins (the first of these),
    `n_tokens` its length. Equal items count as one, under the smallest id. Null and empty texts have no
    tokens, and items without tokens never leak. Rows with the same id and text
    are one document here; null ids stay null. Empty tables give no rows.
    """
    items = written(_items(benchmark, item_id, item_text), "items")
    item_seeds = written(_item_seeds(items), "item-seeds")
    slots = F.explode(F.array("seed", F.shiftrightunsigned("seed", 32))).alias("slot")
    known = bitmap(item_seeds.select(slots), F.col("slot"), BITS)
    filter_bytes = docs.sparkSession.sparkContext.broadcast(known)
    source = docs.select(
        *row_key(doc_id, text), F.col(doc_id).cast("long").alias("doc_id"), text_bytes(text).alias("text")
    )
    short = items.select(F.size("tokens").alias("n")).where(F.col("n") < LEAST).distinct().collect()
    masks = [*masks_of(LEAST), *[m for row in short for m in masks_of(row.n)]]
    hits = written(_hits(source, filter_bytes, masks), "seed-hits")
    pairs = (
        hits.select("k1", "k2", "first", F.inline("seeds").alias("seed", "place"))
        .join(item_seeds, "seed")
        .select("k1", "k2", "first", "item_key", (F.col("place") - F.col("at")).alias("diagonal"))
        .distinct()
    )
    gathered = pairs.groupBy("k1", "k2", "first", "item_key").agg(F.collect_set("diagonal").alias("diagonals"))
    both = gathered.join(
        hits.select("k1", "k2", "first", "around").dropDuplicates(["k1", "k2", "first"]), ["k1", "k2", "first"]
    ).join(items, "item_key")

    def rows(columns):
        names = ("k1", "k2", "item_id", "start", "n_tokens", "n_equal")
        out = {name: [] for name in names}
        for k1, k2, first, item, diagonals, around, values in zip(
            *(columns[c] for c in ("k1", "k2", "first", "item_id", "diagonals", "around", "tokens"))
        ):
            words, own = np.array(around, np.int64), np.array(values, np.int64)
            for diagonal in diagonals:
                if found := overlap(words, first, own, diagonal):
                    for name, value in zip(names, (k1, k2, item, *found)):
                        out[name].append(value)
        return out

    schema = "k1 long, k2 long, item_id long, start int, n_tokens int, n_equal int"
    best = F.max(F.struct("n_equal", (-F.col("start")).alias("early"), "n_tokens")).alias("best")
    found = map_rows(both, rows, schema).groupBy("k1", "k2", "item_id").agg(best)
    ids = hits.select("k1", "k2", "doc_id").distinct()
    return found.join(ids, ["k1", "k2"]).select(
        "k1", "k2", "doc_id", "item_id", (-F.col("best.early")).alias("start"), "best.n_tokens", "best.n_equal"
    )


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """The documents that no item leaks into, in the columns of `docs`; repeated rows stay or go together."""
    found = written(leaks(docs, benchmark, doc_id, text).select("k1", "k2").distinct(), "leaks")
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    first, second = row_key(doc_id, text)
    named = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2))
    return docs.withColumns({k1: first, k2: second}).join(named, [k1, k2], "left_anti").select(*docs.columns)
