"""Removal of byte strings that an earlier document has too, by suffix arrays of shards.

A document loses each byte that lies in a string of `WIDTH` bytes which also starts in a document of smaller id.
Suffixes are sorted shard by shard (`induced`: external induced sorting); neighbours with `WIDTH` bytes in common
form a group, and what is not of the group's least document goes. So that equal strings meet in one shard:

- A window's anchor is the `GRAM`-byte string in it with the least hash (the leftmost, if equal). A run is all
  consecutive windows with one anchor. Equal windows have equal anchors, so shards are dealt by anchor.
- Runs of anchors that occur in one text hold no repeated string. Anchors are counted first, and only
  runs whose anchor occurs again are kept.
- Equal runs are counted together before anything is gathered, with their least document, so a passage goes into
  its shard once, however many documents have it. A run that shares its anchor with no other one has nothing in its
  shard to be compared with: its strings occur where it occurs, and it is left out of the shard.

What a shard finds about a run holds for all its occurrences, and is joined back to them. Shards are made of so many
bytes on average; one with a very common anchor may be larger than memory, which the sorter is made for.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwright.llm import induced
from formwright.llm.common import (
    ROWS_AT_A_TIME,
    U64,
    RollingHash,
    arrow_schema,
    as_batches,
    fresh,
    give_back,
    in_bitmap,
    join_counted,
    map_rows,
    mix,
    row_key,
    shuffles_removed,
    signed,
    text_bytes,
    written,
)
from formwright.llm.repeats import may_have

WIDTH = 50
GRAM = 20
#: Filters of anchors take 2**BITS / 8 bytes, 8 MiB, and more for more anchors, up to 32 MiB. Their size never changes results.
BITS, MOST_BITS = 26, 28
#: Anchors with more than one in so many runs are hot: their runs are never dealt by the anchor.
HOT_SHARE = 500
#: Bytes of a shard, on average. Sorting takes about 120 bytes of memory for each of them, in every task of an executor.
SHARD_BYTES = 1 << 20
#: Bytes of texts that are hashed at once; longer texts are cut into overlapping pieces.
PIECE = 1 << 18
#: Windows whose anchors are searched at once: few enough for a processor's cache.
BLOCK = 1 << 16
#: Symbols of a shard's text: the end of all, the end of a run, and bytes from 2 on.
END_OF_ALL, END_OF_RUN, FIRST_BYTE = 0, 1, 2

HASH = RollingHash(61)


# ---- runs ---------------------------------------------------------------------------------------


def anchors_of(raw: np.ndarray, usable: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first, n, at, v) of the runs of windows that start at `usable` places: first window, number, anchor's place and hash."""
    grams = len(raw) - gram + 1
    count = grams - (width - gram)
    if count <= 0 or not len(usable):
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    at = np.concatenate(
        [_anchor_places(raw[i : min(i + BLOCK, count) + width - 1], width, gram) + i for i in range(0, count, BLOCK)]
    )[usable]
    # Windows of two texts never follow each other at the distance of one.
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(usable, prepend=-2) != 1))
    n = np.diff(first, append=len(usable))
    at = at[first]
    # Least hashes are small ones; mixed again, all their bits are as good as any.
    return usable[first], n, at, mix(~_gram_hashes(sliding_window_view(raw, gram)[at].ravel(), gram)[::gram])


def _gram_hashes(raw: np.ndarray, gram: int) -> np.ndarray:
    """The hash of each `gram` consecutive bytes."""
    grams = len(raw) - gram + 1
    words = np.ndarray((len(raw) - 7,), U64, np.ascontiguousarray(raw), strides=(1,)).copy()  # of any eight bytes
    places = (*range(0, gram - 8, 8), gram - 8)
    factors = mix(np.arange(1, len(places) + 1, dtype=U64)) | U64(1)
    return mix(sum(words[k : k + grams] * factor for k, factor in zip(places, factors)))


def _anchor_places(raw: np.ndarray, width: int, gram: int) -> np.ndarray:
    """Of each window its anchor's place. The least hash is found among those of two grams, then of four, and so on.

    A hash has its place in its lower bits, so that equal ones go by place and the least one tells where it is.
    """
    least, places = _gram_hashes(raw, gram), (1 << (BLOCK + width).bit_length()) - 1
    least &= ~U64(places)
    least |= np.arange(len(least), dtype=U64)
    span, known = width - gram + 1, 1
    while known < span:
        step = min(known, span - known)
        least = np.minimum(least[:-step], least[step:])
        known += step
    return (least & U64(places)).astype(np.int64)


def batches_of(texts: list[bytes], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Texts joined up to about `PIECE` bytes: the bytes, the usable window starts, and of each its text and its place there.

    Pieces of a longer text overlap by one byte less than a window, so each window lies in exactly one.
    """
    parts: list[tuple[int, int, bytes]] = []
    size = 0
    for number, text in enumerate(texts):
        for start in range(0, max(len(text) - width + 1, 0), PIECE):
            part = text[start : start + PIECE + width - 1]
            parts.append((number, start, part))
            size += len(part)
            if size >= PIECE:
                yield _joined(parts, width)
                parts, size = [], 0
    if parts:
        yield _joined(parts, width)


def _joined(parts, width):
    raw = np.frombuffer(b"".join(p for _, _, p in parts), np.uint8)
    lengths = np.array([len(p) for _, _, p in parts])
    offsets = np.cumsum(lengths) - lengths
    counts = lengths - (width - 1)
    owner = np.repeat(np.arange(len(parts)), counts)
    within = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    number = np.array([k for k, _, _ in parts])[owner]
    place = within + np.array([s for _, s, _ in parts])[owner]
    return raw, offsets[owner] + within, number, place


def anchors(source: DataFrame, width: int, gram: int) -> DataFrame:
    """(bucket, again, mixed, n): of anchors that occur in two texts, and of those with different runs, 32 bits each, in order.

    Anchors go into 4,096 buckets by their first bits, the next 32 tell them apart. A row of what is shuffled is all that a
    block of texts has for a bucket, 10 bytes a run in place of a row for each. Anchors that are taken for one only make
    two bits more of a filter. Rows with the bucket -1 are the heavy anchors and their numbers, for which see `heavy_anchors`.
    """
    packed_schema = arrow_schema(source.sparkSession, "bucket long, data binary")
    schema = arrow_schema(source.sparkSession, ANCHORS)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size, texts = [], 0, 0
        for batch in batches:
            for start in range(0, batch.num_rows, ROWS_AT_A_TIME):
                some = batch.slice(start, ROWS_AT_A_TIME).column("text").to_pylist()
                for raw, usable, number, _ in batches_of(some, width):
                    first, n, at, v = anchors_of(raw, usable, width, gram)
                    block.append((v, run_hashes(raw, first, n, at, width), texts + number[np.searchsorted(usable, first)]))
                    size += len(v)
                    if size >= BLOCK_RUNS:
                        yield from packed(*map(np.concatenate, zip(*block)), packed_schema)
                        block, size = [], 0
                texts += len(some)
            give_back()
        if size:
            yield from packed(*map(np.concatenate, zip(*block)), packed_schema)

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, parts = None, []
        for batch in batches:
            for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist()):
                if current is not None and bucket != current:
                    yield repeated(current, parts, schema)
                    parts = []
                current = bucket
                parts.append(data)
        if current is not None:
            yield repeated(current, parts, schema)
        give_back()

    dealt = source.select("text").mapInArrow(pack, "bucket long, data binary").repartition("bucket")
    return dealt.sortWithinPartitions("bucket").mapInArrow(counted, ANCHORS)


ANCHORS = "bucket long, again binary, mixed binary, n long"
#: An anchor is known by so many first bits, its bucket, and 32 more.
BUCKET_BITS = 12
#: So many runs are packed at once.
BLOCK_RUNS = 1 << 20
#: What is packed of a run: its anchor within the bucket; its hash, with the number of texts (two are many) in the lowest bits.
RECORD = np.dtype([("v", "<u4"), ("low", "<u4"), ("high", "<u2")])
HEAVY = np.dtype([("v", "<u8"), ("c", "<u8")])


def packed(v: np.ndarray, r: np.ndarray, text: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, data) of a block of runs, equal ones once."""
    order = np.argsort(v)
    v = v[order]
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    sizes = np.diff(heads, append=len(v))
    # Only where an anchor comes again in the block are runs and texts compared.
    several = np.repeat(sizes > 1, sizes)
    alone, again = order[~several], order[several]
    v_of = {"alone": v[~several]}
    again = again[np.lexsort((text[again], r[again], v[several]))]
    w, s, t = v[several], r[again], text[again]
    anchor = np.append(True, w[1:] != w[:-1])[: len(w)]
    kind = np.append(True, (w[1:] != w[:-1]) | (s[1:] != s[:-1]))[: len(w)]
    starts = np.flatnonzero(anchor)
    texts = np.zeros(len(w), U64)
    if len(w):
        texts[starts] = 1 + (np.minimum.reduceat(t, starts) != np.maximum.reduceat(t, starts))
    v_of["again"] = w[kind]
    every = np.concatenate([v_of["alone"], v_of["again"]])
    tail = np.concatenate([r[alone] << U64(2) | U64(1), s[kind] << U64(2) | texts[kind]])
    order = np.argsort(every)
    every, tail = every[order], tail[order]
    records = np.empty(len(every), RECORD)
    records["v"] = every >> U64(64 - BUCKET_BITS - 32)
    records["low"], records["high"] = tail, tail >> U64(32)
    bounds = np.searchsorted(every, np.arange(1, 1 << BUCKET_BITS, dtype=U64) << U64(64 - BUCKET_BITS))
    bounds = np.concatenate([[0], bounds, [len(every)]])
    buckets = np.flatnonzero(np.diff(bounds))
    data = [records[a:b].tobytes() for a, b in zip(bounds[buckets].tolist(), bounds[buckets + 1].tolist())]
    much = sizes > len(v) // (2 * HOT_SHARE)
    heavy = np.empty(int(much.sum()), HEAVY)
    heavy["v"], heavy["c"] = v[heads[much]], sizes[much]
    yield from as_batches({"bucket": [-1, *buckets.tolist()], "data": [heavy.tobytes(), *data]}, schema)


def repeated(bucket: int, parts: list[bytes], schema: pa.Schema) -> pa.RecordBatch:
    """A bucket's row of `anchors`."""
    if bucket < 0:
        heavy = np.frombuffer(b"".join(parts), HEAVY)
        v, which = np.unique(heavy["v"], return_inverse=True)
        c = np.zeros(len(v), np.int64)
        np.add.at(c, which, heavy["c"].astype(np.int64))
        most = np.argsort(-c)[: 2 * HOT_SHARE]
        v, c = v[most], c[most]
        return pa.RecordBatch.from_arrays(
            [pa.array(x, f.type) for x, f in zip(([bucket], [v.tobytes()], [c.tobytes()], [0]), schema)], schema=schema
        )
    records = np.frombuffer(b"".join(parts), RECORD)
    order = np.argsort(records["v"], kind="stable")
    v = records["v"][order]
    run = (records["low"].astype(U64) | records["high"].astype(U64) << U64(32))[order]
    heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
    again = np.add.reduceat(run & U64(3), heads) > 1
    run >>= U64(2)
    mixed = again & (np.minimum.reduceat(run, heads) != np.maximum.reduceat(run, heads))
    found = ([bucket], [v[heads[again]].tobytes()], [v[heads[mixed]].tobytes()], [len(v)])
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(found, schema)], schema=schema)


def filters(known: DataFrame) -> tuple[tuple[bytes, int], tuple[bytes, int], np.ndarray]:
    """Of a written table of `anchors`: the filters of those that occur again and of mixed ones, each with its bits, and the hot anchors.

    A filter has eight bits or more for each anchor as far as `MOST_BITS` allow: one that is full lets every run pass.
    """
    counts = known.where("bucket >= 0").agg(
        *[F.coalesce(F.sum(F.length(c)), F.lit(0)) for c in ("again", "mixed")], F.coalesce(F.sum("n"), F.lit(0))
    ).first()
    made = []
    for name, size in zip(("again", "mixed"), counts):
        bits = min(max((2 * size).bit_length(), BITS), MOST_BITS)
        made.append((anchor_filter(known, name, bits), bits))
    heavy = known.where("bucket < 0").select("again", "mixed").first()
    if heavy is None:
        return *made, np.zeros(0, U64)
    v, c = np.frombuffer(heavy[0], U64), np.frombuffer(heavy[1], np.int64)
    return *made, v[c > counts[2] // HOT_SHARE]


def anchor_filter(known: DataFrame, name: str, bits: int) -> bytes:
    """A bit for each value of an anchor's first `bits` bits; every bucket gives its part of them."""
    each = 1 << (bits - BUCKET_BITS)

    def rows(columns):
        parts = []
        for data in columns[name]:
            marks = np.zeros(each, bool)
            marks[np.frombuffer(data, np.uint32) >> np.uint32(32 - (bits - BUCKET_BITS))] = True
            parts.append(np.packbits(marks, bitorder="little").tobytes())
        return {"bucket": columns["bucket"], "part": parts}

    some = known.where((F.col("bucket") >= 0) & (F.length(name) > 0)).select("bucket", name)
    out = np.zeros((1 << BUCKET_BITS, each // 8), np.uint8)
    for batch in map_rows(some, rows, "bucket long, part binary").toArrow().to_batches():
        for bucket, part in zip(batch.column("bucket").to_pylist(), batch.column("part")):
            out[bucket] = np.frombuffer(part.as_buffer(), np.uint8)
    return out.tobytes()


def run_hashes(raw: np.ndarray, first: np.ndarray, n: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Of each run its bytes' hash, with the anchor's place in it."""
    with np.errstate(over="ignore"):
        return mix(HASH.ranges(HASH.prefix(HASH.bytes[raw]), first, first + n + width - 1) + (at - first).astype(U64))


def runs(
    source: DataFrame, again: tuple[bytes, int], mixed: tuple[bytes, int], hot: np.ndarray, width: int, gram: int
) -> DataFrame:
    """(k1, k2, v, r, a, n, mixed, hot) of the runs whose anchor may occur again: hashes of anchor and run, first window,
    number of windows, whether the anchor may have different runs, and whether it is hot."""
    context = source.sparkSession.sparkContext
    filters_of = {"again": (context.broadcast(again[0]), again[1]), "mixed": (context.broadcast(mixed[0]), mixed[1])}
    names = ("k1", "k2", "v", "r", "a", "n", "mixed", "hot")

    def marked(name: str, v: np.ndarray) -> np.ndarray:
        shared, bits = filters_of[name]
        return in_bitmap(np.frombuffer(shared.value, np.uint8), v >> U64(64 - bits), bits)

    def rows(columns):
        out = {name: [] for name in names}
        keys = [np.array(columns[k], np.int64) for k in ("k1", "k2")]
        for raw, usable, number, place in batches_of(columns["text"], width):
            first, n, at, v = anchors_of(raw, usable, width, gram)
            keep = marked("again", v)
            if not keep.any():
                continue
            first, n, at, v = first[keep], n[keep], at[keep], v[keep]
            row = np.searchsorted(usable, first)
            values = (*[key[number[row]] for key in keys], signed(v), signed(run_hashes(raw, first, n, at, width)), place[row], n)
            for name, value in zip(names, (*values, marked("mixed", v), np.isin(v, hot))):
                out[name].append(value)
        return {name: np.concatenate(parts) if parts else [] for name, parts in out.items()}

    return map_rows(source, rows, "k1 long, k2 long, v long, r long, a int, n int, mixed boolean, hot boolean")


# ---- shards -------------------------------------------------------------------------------------


def earlier_in_shard(
    bodies: np.ndarray, lengths: np.ndarray, least: np.ndarray, greatest: np.ndarray, width: int, limit: int = induced.IN_MEMORY
) -> Iterator[tuple[np.ndarray, ...]]:
    """(run, first, end, m) in blocks: stretches of windows of a run whose strings start in document `m` and in none before.

    `bodies` are the runs' bytes one after the other, `least` and `greatest` the documents they occur in. Only
    stretches with an `m` below the run's greatest document are given: others take nothing from any document.
    """
    total = int(lengths.sum()) + len(lengths)
    starts = np.cumsum(lengths + 1) - (lengths + 1)
    text = induced.stored(np.full(total + 1, END_OF_RUN, np.uint16), 8 * limit)
    run_of = induced.stored(np.zeros(total, np.int32), 8 * limit)
    at = 0
    for some in _run_blocks(lengths):
        spots, owner = _spots(starts, lengths, some)
        text[spots] = bodies[at : at + len(spots)].astype(np.uint16) + FIRST_BYTE
        run_of[spots] = owner
        at += len(spots)
    text[-1] = END_OF_ALL

    # Groups of suffixes are numbered from 1 in their order; a group's least document is kept by its number.
    group_of = induced.stored(np.zeros(total, np.int64), 8 * limit)
    first_doc = induced.stored(np.full(total + 2, np.iinfo(np.int64).max), 8 * limit)
    number = 0
    for place, prefix in induced.sorted_suffixes(text, width, limit):
        group = np.cumsum(prefix < width) + number
        number = int(group[-1])
        runs = run_of[place]
        whole = place - starts[runs] <= lengths[runs] - width
        group_of[place[whole]] = group[whole]
        np.minimum.at(first_doc, group[whole], least[runs[whole]])

    for some in _run_blocks(lengths):
        spots, owner = _spots(starts, lengths - (width - 1), some)
        m = first_doc[group_of[spots]]
        heads = np.flatnonzero((np.diff(m, prepend=0) != 0) | (np.diff(owner, prepend=-1) != 0))
        first = spots[heads] - starts[owner[heads]]
        end = first + np.diff(heads, append=len(spots))
        keep = m[heads] < greatest[owner[heads]]
        yield owner[heads][keep], first[keep], end[keep], m[heads][keep]


def _run_blocks(lengths: np.ndarray, size: int = 1 << 14) -> Iterator[np.ndarray]:
    for start in range(0, len(lengths), size):
        yield np.arange(start, min(start + size, len(lengths)))


def _spots(starts: np.ndarray, lengths: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first `lengths` places of some runs in the shard's text, and the run of each."""
    counts = lengths[some]
    owner = np.repeat(some, counts)
    return starts[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts), owner


RUN = ["v", "r", "m", "g", "c"]
STRETCHES = "v long, r long, c long, first int, end int, m long"


class _Shard:
    """The runs of one shard as they arrive; their bytes go to a scratch file beyond `IN_MEMORY` of them."""

    def __init__(self):
        self.file = tempfile.SpooledTemporaryFile(max_size=8 * induced.IN_MEMORY)
        self.columns: dict[str, list] = {name: [] for name in (*RUN, "length")}

    def add(self, batch: pa.RecordBatch) -> None:
        for body in batch.column("body").to_pylist():
            self.file.write(body)
        for name in RUN:
            self.columns[name].append(batch.column(name).to_numpy(zero_copy_only=False))
        self.columns["length"].append(pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False))

    def stretches(self, width: int, target: pa.Schema) -> Iterator[pa.RecordBatch]:
        of = {name: np.concatenate(parts).astype(np.int64) for name, parts in self.columns.items()}
        self.file.seek(0)
        if getattr(self.file, "_rolled", False):
            bodies = np.memmap(self.file._file, np.uint8, "r")
        else:
            bodies = np.frombuffer(self.file.read(), np.uint8)
        for run, first, end, m in earlier_in_shard(bodies, of["length"], of["m"], of["g"], width):
            found = {name: of[name][run] for name in ("v", "r", "c")} | {"first": first, "end": end, "m": m}
            yield from as_batches(found, target)
        self.file.close()


def bodies_of(texts: DataFrame, width: int) -> DataFrame:
    """(shard, v, r, m, g, c, body) of (text, runs): the bytes of each run."""
    target = arrow_schema(texts.sparkSession, BODIES)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                some = batch.slice(start, 64)
                runs = some.column("runs")
                owner = np.repeat(np.arange(len(runs)), pc.list_value_length(runs).to_numpy(zero_copy_only=False))
                flat = dict(zip(runs.type.value_type.names, runs.flatten().flatten()))
                a, n = (flat[name].to_numpy(zero_copy_only=False).astype(np.int64) for name in ("a", "n"))
                body = _spans(some.column("text"), owner, a, n + (width - 1))
                yield pa.RecordBatch.from_arrays([*(flat[name] for name in ("shard", *RUN)), body], schema=target)
            give_back()

    return texts.mapInArrow(cut, BODIES)


BODIES = "shard long, v long, r long, m long, g long, c long, body binary"


def _spans(texts: pa.Array, owner: np.ndarray, first: np.ndarray, lengths: np.ndarray) -> pa.Array:
    """From `first` on `lengths` bytes of the text of each number in `owner`."""
    texts = texts.cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :]
    raw = np.frombuffer(texts.buffers()[2], np.uint8)
    ends = np.cumsum(lengths)
    places = np.repeat(offsets[owner] + first - (ends - lengths), lengths) + np.arange(int(lengths.sum()))
    bounds = np.append(0, ends).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(bounds), pa.py_buffer(raw[places])])


def stretches(bodies: DataFrame, width: int) -> DataFrame:
    """(v, r, c, first, end, m) of runs (shard, v, r, m, g, c, body): what each shard's suffix array tells."""
    target = arrow_schema(bodies.sparkSession, STRETCHES)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, shard = None, _Shard()
        for batch in batches:
            numbers = batch.column("shard").to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(numbers)) + 1).tolist(), len(numbers)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if current is not None and numbers[start] != current:
                    yield from shard.stretches(width, target)
                    shard = _Shard()
                    give_back()
                current = numbers[start]
                shard.add(batch.slice(start, end - start))
        if current is not None:
            yield from shard.stretches(width, target)
            give_back()

    return bodies.repartition("shard").sortWithinPartitions("shard").mapInArrow(run, STRETCHES)


# ---- documents ----------------------------------------------------------------------------------


def _key(doc_id: str, text: str) -> tuple[Column, Column]:
    """As `row_key`, with half of the text's hash: it only tells rows of one id apart."""
    k1, k2 = row_key(doc_id, text)
    return k1, F.shiftrightunsigned(k2, 32).alias("k2")


def earlier_intervals(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES
) -> DataFrame:
    """(k1, k2, intervals): for documents that lose bytes, the maximal intervals (first, end) of them, in order."""
    with shuffles_removed(docs.sparkSession):
        return written(_earlier_intervals(docs, doc_id, text, width, gram, shard_bytes), "byte-intervals")


def _earlier_intervals(docs: DataFrame, doc_id: str, text: str, width: int, gram: int, shard_bytes: int) -> DataFrame:
    source = docs.where(F.col(doc_id).isNotNull()).select(*_key(doc_id, text), text_bytes(text).alias("text"))
    known = written(anchors(source, width, gram), "anchors")
    found = written(runs(source, *filters(known), width, gram), "byte-runs")
    # A run is told by two hashes of 64 bits, its anchor's and its own. Where an anchor has but one, the least document is all
    # there is to know, and its runs are dealt once. The others, and hot ones, are counted first and looked up after.
    plain, rest = found.where("NOT (mixed OR hot)"), found.where("mixed OR hot")
    least = plain.withColumn("m", F.min("k1").over(Window.partitionBy("v", "r")))
    whole = least.select("k1", "k2", "a", F.lit(0).alias("first"), F.col("n").alias("end"), "m")
    one = F.min(F.struct("k1", "k2", "a", "n")).alias("one")
    kinds = rest.groupBy("v", "r").agg(F.count("*").alias("c"), F.max("k1").alias("g"), F.max("mixed").alias("mixed"), one)
    told = kinds.select("v", "r", "c", "g", F.col("one.k1").alias("m"), "one.k2", "one.a", "one.n", "mixed")
    told = written(told.where("mixed OR m < g"), "byte-run-kinds")
    lone = told.where("NOT mixed").select("v", "r", "c", F.lit(0).alias("first"), F.col("n").alias("end"), "m")
    picked = told.where("mixed").withColumn("k1", F.col("m"))
    size = picked.agg(F.coalesce(F.sum(F.col("n") + (width - 1)), F.lit(0))).first()[0]
    shards = max(1, -(-size // shard_bytes))
    wanted = picked.withColumn("shard", F.pmod("v", F.lit(shards))).groupBy("k1", "k2").agg(
        F.collect_list(F.struct("shard", *RUN, "a", "n")).alias("runs")
    )
    may = may_have(picked)(F.xxhash64("k1", "k2"))
    bodies = bodies_of(source.where(may).join(wanted, ["k1", "k2"]).select("text", "runs"), width)
    taken = written(stretches(bodies, width).unionByName(lone), "stretches")
    hits = join_counted(rest, taken, ["v", "r"], "c", "inner").select(*whole.columns).unionByName(whole).where("m < k1")
    # An interval as one number, first and end, so that a document's are an array of numbers.
    interval = F.shiftleft((F.col("a") + F.col("first")).cast("long"), 32) + (F.col("a") + F.col("end") + (width - 1))
    gathered = hits.groupBy("k1", "k2").agg(F.collect_list(interval).alias("parts"))

    def merged(columns):
        return {"k1": columns["k1"], "k2": columns["k2"], "intervals": [_merged(np.array(p, np.int64)) for p in columns["parts"]]}

    return map_rows(gathered, merged, "k1 long, k2 long, intervals array<struct<first: int, end: int>>")


def _merged(parts: np.ndarray) -> list[dict[str, int]]:
    """Overlapping and adjoining intervals as one, from numbers with the first place above and the end below 32 bits."""
    parts.sort()
    first, end = parts >> 32, np.maximum.accumulate(parts & 0xFFFFFFFF)
    heads = np.flatnonzero(np.append(True, first[1:] > end[:-1]))
    ends = end[np.append(heads[1:] - 1, len(end) - 1)]
    return [{"first": a, "end": b} for a, b in zip(first[heads].tolist(), ends.tolist())]


def with_earlier(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, name: str = "intervals", **how
) -> DataFrame:
    """`docs` with the column `name`: the maximal intervals of bytes that an earlier document has, empty where there are none.

    Rows with equal ids take nothing from each other; null ids are neither before nor after any. Null, empty and
    short texts lose nothing. An existing column of that name is not touched: underscores are put in front. An empty
    table stays empty.
    """
    name = fresh(docs, name)
    found = earlier_intervals(docs, doc_id, text, width, **how)
    k1, k2 = fresh(docs, "k1"), fresh(docs, "k2")
    first, second = _key(doc_id, text)
    keyed = docs.withColumns({k1: first, k2: second})
    named = found.select(F.col("k1").alias(k1), F.col("k2").alias(k2), F.col("intervals").alias(name))
    may = may_have(found)(F.xxhash64(k1, k2))
    none = F.expr("cast(array() AS array<struct<first: int, end: int>>)")
    columns = [*docs.columns, name]
    hit = keyed.where(may).join(named, [k1, k2], "left").withColumn(name, F.coalesce(name, none))
    return hit.select(*columns).unionByName(keyed.where(~may).withColumn(name, none).select(*columns))


def kept_bytes(data: bytes, intervals: list[dict[str, int]]) -> bytes:
    """What lies outside the intervals."""
    out, at = [], 0
    for part in intervals:
        out.append(data[at : part["first"]])
        at = part["end"]
    return b"".join([*out, data[at:]])
