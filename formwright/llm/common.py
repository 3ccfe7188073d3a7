"""What the operators share: written intermediates, row keys, Arrow batches, word hashes, skewed joins."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formwright.session import new_path

#: Bytes that separate words: the blank and U+0009 to U+000D. In UTF-8 they occur in no longer character.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
UPPER_TO_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")

#: Rows of an Arrow batch that are held as Python objects at once.
ROWS_AT_A_TIME = 512

U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared folder, read back.

    It cuts the lineage: what follows starts from files that outlive any executor.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Removes what frames made within have shuffled as soon as each is written or collected, where Spark can (from 4.1).

    Else the files stay until the driver happens to collect its garbage, and the disk holds those of all steps at once.
    """
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def fresh(df: DataFrame, name: str) -> str:
    """`name`, with underscores in front until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def row_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """Two non-null bigints that tell documents apart even if ids are null or repeated.

    Rows that share both have the same text (but for a collision of hashes under one id), so whatever is
    derived from the text holds for each of them.
    """
    return (
        F.coalesce(F.col(doc_id).cast("long"), F.lit(-1)).alias("k1"),
        F.xxhash64(F.col(doc_id).isNull(), F.coalesce(F.col(text), F.lit(""))).alias("k2"),
    )


def map_rows(
    df: DataFrame, rows: Callable[[dict[str, list]], dict[str, list]], schema: str, at_a_time: int = ROWS_AT_A_TIME
) -> DataFrame:
    """Applies a function from columns to columns, a few hundred rows at a time."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, at_a_time):
                yield from as_batches(rows(batch.slice(start, at_a_time).to_pydict()), target)
            give_back()

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def give_back() -> None:
    """Returns freed memory to the system: workers are reused, and would keep what their largest batch took."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def _trim_function():
    try:
        return ctypes.CDLL(None).malloc_trim
    except (AttributeError, OSError):  # another C library
        return None


_TRIM = _trim_function()


def arrow_schema(spark: SparkSession, ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    return to_arrow_schema(_parse_datatype_string(ddl))


def as_batches(columns: dict, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    arrays = [pa.array(columns[f.name], type=f.type) for f in schema]
    if len(arrays[0]):
        yield pa.RecordBatch.from_arrays(arrays, schema=schema)


def text_bytes(name: str = "text") -> Column:
    """The text as UTF-8, empty for null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(b"").cast("binary"))


# ---- hashes -------------------------------------------------------------------------------------


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads 64-bit values over all bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(29))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(32))


class RollingHash:
    """Rabin-Karp hashes modulo 2**64: prefix sums of value times power, shifted back by inverse powers.

    The hash of any range is two subtractions and a product, whatever its length.
    """

    def __init__(self, seed: int):
        with np.errstate(over="ignore"):
            self.bytes = mix(np.arange(1, 257, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))
        self.base = int(mix(np.array([seed + 977], dtype=U64))[0]) | 5
        self._powers = self._table(self.base, 1 << 12)
        self._inverses = self._table(pow(self.base, -1, 1 << 64), 1 << 12)

    @staticmethod
    def _table(base: int, n: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            steps = np.full(n, base, dtype=U64)
            steps[0] = 1
            return np.cumprod(steps, dtype=U64)

    def _reach(self, n: int) -> None:
        if n > len(self._powers):
            size = 1 << n.bit_length()
            self._powers = self._table(self.base, size)
            self._inverses = self._table(pow(self.base, -1, 1 << 64), size)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        self._reach(len(values) + 1)
        sums = np.zeros(len(values) + 1, dtype=U64)
        np.cumsum(values * self._powers[: len(values)], out=sums[1:])
        return sums

    def ranges(self, prefix: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((prefix[end] - prefix[first]) * self._inverses[first] + (end - first).astype(U64))

    def windows(self, values: np.ndarray, width: int) -> np.ndarray:
        """The hashes of all `width` consecutive values."""
        n = len(values) - width + 1
        if n <= 0:
            return np.zeros(0, dtype=U64)
        sums = self.prefix(values)
        return mix((sums[width:] - sums[:n]) * self._inverses[:n] + U64(width))

    def words(self, data: bytes) -> np.ndarray:
        """The hashes of the words of one text."""
        parts = [self._words(part) for part in pieces(data)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _words(self, data: bytes) -> np.ndarray:
        raw = np.frombuffer(data, dtype=np.uint8)
        edges = np.flatnonzero(np.diff(_IS_SPACE[raw], prepend=True, append=True))
        if not len(edges):
            return np.zeros(0, dtype=U64)
        return self.ranges(self.prefix(self.bytes[raw]), edges[::2], edges[1::2])


_IS_SPACE = np.isin(np.arange(256), list(SPACES))


def pieces(data: bytes, size: int = 1 << 20) -> list[bytes]:
    """The text in parts of about `size` bytes, cut at spaces, so that memory does not follow the longest text."""
    if len(data) <= size:
        return [data]
    cuts, start = [], 0
    while len(data) - start > size:
        end = max(data.rfind(bytes([s]), start, start + size) for s in SPACES)
        if end <= start:
            later = [i for i in (data.find(bytes([s]), start + size) for s in SPACES) if i >= 0]
            if not later:
                break
            end = min(later)
        cuts.append(data[start:end])
        start = end
    return [*cuts, data[start:]]


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, dtype=U64).view(np.int64)


# ---- fixed-size filters and skewed joins --------------------------------------------------------


def bitmap(df: DataFrame, key: Column, bits: int) -> bytes:
    """One bit for each value of `key % 2**bits` that occurs.

    Its size is 2**bits / 8 bytes whatever the rows; it is built by grouped aggregation, so at most 2**bits / 64
    words reach the driver.
    """
    slot = F.pmod(key, F.lit(1 << bits))
    words = (
        df.select(slot.alias("slot"))
        .groupBy(F.shiftright("slot", 6).alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, int(slot & 63)))").alias("mask"))
        .toArrow()
    )
    out = np.zeros((1 << bits) // 64, dtype=np.int64)
    out[words["word"].to_numpy()] = words["mask"].to_numpy()
    return out.tobytes()


def in_bitmap(bitmap_bytes: np.ndarray, values: np.ndarray, bits: int) -> np.ndarray:
    """Whether each unsigned value's bit is set; `bitmap_bytes` is the bitmap as unsigned bytes."""
    slot = values & U64((1 << bits) - 1)
    return (bitmap_bytes[(slot >> U64(3)).astype(np.int64)] >> (slot & U64(7)).astype(np.uint8)) & 1 == 1


def hot_and_cold(keyed: DataFrame, count: str, share: int = 500) -> tuple[DataFrame, DataFrame]:
    """The rows whose `count` is more than one in `share` of all counted, at most `share` rows, and the others."""
    total = keyed.agg(F.coalesce(F.sum(count), F.lit(0))).first()[0]
    return keyed.where(F.col(count) > total // share), keyed.where(F.col(count) <= total // share)


def join_counted(
    rows: DataFrame, keyed: DataFrame, key: list[str], count: str, how: str = "left", share: int = 500
) -> DataFrame:
    """`rows` joined (`left`, `inner` or `left_semi`) with `keyed`, one row a key.

    `keyed` tells in `count` how many rows have the key. Keys with more than one in `share` of those counted are
    broadcast: there can be no more than `share` of them. The others are joined by shuffle, where none is
    large. Both inputs are read twice; give written tables.
    """
    hot, cold = hot_and_cold(keyed, count, share)
    hot = F.broadcast(hot)
    if how == "left_semi":
        hot, cold = F.broadcast(hot.select(*key)), cold.select(*key)
    rest = rows.join(hot.select(*key), key, "left_anti").join(cold, key, how)
    return rows.join(hot, key, "inner" if how == "left" else how).unionByName(rest)


def numbered(df: DataFrame, group: list[str], order: list[str], name: str, total: str | None = None) -> DataFrame:
    """`df` with each row's place in its group, from 0, by `order` (null first), and the size of its group.

    All rows are dealt into sorted ranges of (group, order), so a group with most of the rows lies in many of them.
    What is joined back is one row for each group in each range. Rows that are equal in all of `order` are numbered
    as they lie; give columns that tell them apart. Give a written table: ranges are found by a scan of their own.
    """
    r, part = fresh(df, "r"), fresh(df, "part")
    keys = [F.col(c) for c in (*group, *order)]
    sorted_rows = df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn(r, F.monotonically_increasing_id())
    placed = written(sorted_rows.withColumn(part, F.shiftright(r, 33)), "placed")
    spans = placed.groupBy(*group, part).agg(F.min(r).alias("first"), F.count("*").alias("n"))
    whole = Window.partitionBy(*group)
    before = F.sum("n").over(whole.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))
    named = spans.select(
        *[F.col(c).alias(f"of_{c}") for c in group],
        F.col(part).alias("of_part"),
        (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"),
        F.sum("n").over(whole).alias("size"),
    )
    same = F.col(part) == F.col("of_part")
    for c in group:
        same &= F.col(c).eqNullSafe(F.col(f"of_{c}"))
    found = placed.join(named, same).withColumn(name, F.col(r) + F.col("shift"))
    if total:
        found = found.withColumn(total, F.col("size"))
    return found.select(*df.columns, name, *([total] if total else []))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(rank, label, text): the documents of the first `rows` labelled ids by hash; texts as bytes.

    `usable` is a condition on the ids in `labels`. Ids with a label that is neither 0 nor 1, or with
    differing ones, are left out, and so are null texts. The ids are bounded, so they are broadcast and no
    text is shuffled to find them.
    """
    picked = (
        labels.where(usable & F.col(doc_id).isNotNull())
        .groupBy(F.col(doc_id).cast("long").alias("rank_id"))
        .agg(F.min(label).cast("int").alias("label"), F.max(label).cast("int").alias("other"))
        .where("label = other AND label IN (0, 1)")
        .select("rank_id", "label", F.xxhash64("rank_id").alias("rank"))
        .orderBy("rank", "rank_id")
        .limit(rows)
    )
    source = docs.where(F.col(text).isNotNull()).select(
        F.col(doc_id).cast("long").alias("rank_id"), text_bytes(text).alias("text")
    )
    return source.join(F.broadcast(picked), "rank_id").select("rank", "label", "text")
