"""Packing of tokenized documents into windows by multiway Karmarkar-Karp differencing.

Every task tokenizes its documents and packs them as it goes. Each document gives as many whole windows as
it has; rests of documents that fit into one window are kept whole. When a batch of them fills about `BATCH_WINDOWS`
windows, they are the numbers to divide: each starts as a partial partition of one number, and
the two partial partitions whose windows differ most are merged again and again, the fullest windows of one
with the emptiest of the other, until one partition into near-equal windows is left. If its fullest window
exceeds the capacity, the partition is made anew with one window more.

What then is free in the windows is topped up with the rests of longer documents, which are cut in any case; only where
there are too few of them, with documents that come next, uncut where one fits.

Nothing is shuffled and no document's ids leave their task, so memory is bounded by one batch and the text
at hand. A task's result depends on its rows and their order alone.
"""

from __future__ import annotations

import heapq
import zlib
from collections import deque
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import arrow_schema, as_batches, give_back

CAPACITY = 2048
END_ID = 1
BATCH_WINDOWS = 48
#: Rests of longer documents held back to top windows up, as a share of a batch; what is more is divided as well.
RESERVE = 0.25
#: Free ids in open windows, as a share of a batch, beyond which the next documents top them up.
MOST_FREE = 0.125
#: Less than this is not topped up, and no document is cut into a smaller piece but in a task's last batch.
LEAST_PIECE = 16
#: Short documents are one number together up to so many ids.
BUNDLE = 128
#: Texts longer than this are tokenized in pieces, cut where no token can lie across.
PIECE_CHARS = 1 << 17
SPECIAL = "<|endoftext|>"

PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
)


class Tokenizer:
    """The ids of a byte-level BPE vocabulary, by the fast library where both agree.

    `json_path` names the vocabulary for `tokenizers`, whose ids hold. `ranks_path`, if given, names the same
    vocabulary as ranks for `tiktoken`; it is used for texts without a special token's string.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        self._json_path = json_path
        self._fast = None
        if ranks_path and pattern:
            import base64

            import tiktoken

            with open(ranks_path, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self._fast = tiktoken.Encoding(
                "packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
            )

    @cached_property
    def _slow(self):
        """Loaded only where a text needs it: a worker keeps what it has loaded."""
        from tokenizers import Tokenizer as Slow

        return Slow.from_file(self._json_path)

    def ids(self, text: str) -> np.ndarray:
        parts = [self._part(part) for part in cut_at_spaces(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)

    def _part(self, text: str) -> np.ndarray:
        if self._fast is None or SPECIAL in text:
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.array(self._fast.encode_ordinary(text), dtype="<u4")


def cut_at_spaces(text: str, size: int = PIECE_CHARS) -> list[str]:
    """The text in pieces of about `size`, each but the first beginning with the blank after a letter or digit.

    Byte-level BPE splits its words there in any case, so the pieces' ids are the whole text's.
    """
    parts, start = [], 0
    while len(text) - start > size:
        cut = start + size
        while cut < len(text) and not (text[cut] == " " and text[cut - 1].isalnum()):
            cut += 1
        if cut >= len(text):
            break
        parts.append(text[start:cut])
        start = cut
    return [*parts, text[start:]]


@lru_cache(maxsize=2)
def public_tokenizer(folder: str | None = None) -> Tokenizer:
    """The 50,257-id byte-level vocabulary; `folder` is where its files are, by default the public package's."""
    import public_tokenizers as public

    where = (lambda name: f"{folder}/{name}") if folder else public.path
    return Tokenizer(
        str(where("byte_bpe_50k.json")), str(where("byte_bpe_50k.tiktoken")), getattr(public, "PATTERN", None)
    )


def difference(sizes: list[int], ways: int) -> list[list[int]]:
    """Divides the numbers into `ways` lists of near-equal sums; gives their indices.

    A partial partition keeps only its non-empty windows' sums, fullest first; the empty ones have sum 0.
    """
    if ways <= 1:
        return [list(range(len(sizes)))]
    heap = [(-size, i, [size], [[i]]) for i, size in enumerate(sizes)]
    heapq.heapify(heap)
    order = len(sizes)
    while len(heap) > 1:
        _, _, a, a_items = heapq.heappop(heap)
        _, _, b, b_items = heapq.heappop(heap)
        # The fullest windows of a meet the emptiest of b: empty ones of b first, then its least full.
        free = ways - len(b)
        sums, items = [], []
        for j in range(max(len(a), ways) if len(a) > free else len(a)):
            own = a[j] if j < len(a) else 0
            held = a_items[j] if j < len(a) else []
            k = len(b) - 1 - (j - free)
            if j >= free and k >= 0:
                own += b[k]
                held = held + b_items[k]
            sums.append(own)
            items.append(held)
        # Windows of b that met none of a.
        met = max(0, min(len(sums), ways) - free)
        for k in range(len(b) - met):
            sums.append(b[k])
            items.append(b_items[k])
        by_size = sorted(range(len(sums)), key=lambda j: -sums[j])
        sums, items = [sums[j] for j in by_size], [items[j] for j in by_size]
        low = sums[-1] if len(sums) == ways else 0
        heapq.heappush(heap, (low - sums[0], order, sums, items))
        order += 1
    return heap[0][3] if heap else []


def windows_of(sizes: list[int], capacity: int) -> list[list[int]]:
    """Near-equal windows of at most `capacity`; as few as differencing finds from the least possible on."""
    ways = -(-sum(sizes) // capacity)
    while True:
        found = difference(sizes, ways)
        if all(sum(sizes[i] for i in window) <= capacity for window in found):
            return [window for window in found if window]
        ways += 1


class Window:
    """A window being filled: (doc_id, start, ids, doc_tokens) one after the other, and the ids still free."""

    def __init__(self, capacity: int, rests: list[tuple] = ()):
        self.rests = list(rests)
        self.free = capacity - sum(len(r[2]) for r in self.rests)

    def put(self, rest: tuple) -> None:
        self.rests.append(rest)
        self.free -= len(rest[2])


def _size(bundle: list[tuple]) -> int:
    return sum(len(rest[2]) for rest in bundle)


class Packer:
    """Packs documents given one after the other; `add` and `close` yield the pieces' rows."""

    def __init__(self, task: int, capacity: int = CAPACITY, batch_windows: int = BATCH_WINDOWS):
        self.capacity = capacity
        self.target = batch_windows * capacity
        self.least = min(LEAST_PIECE, max(capacity // 4, 1))
        self.bundle = min(BUNDLE, capacity // 4)
        self.next_sequence = task << 40
        self.whole: list[list[tuple]] = []  # bundles of documents that fit into one window
        self.whole_ids = 0
        self.fill: deque[tuple] = deque()  # rests of longer documents
        self.fill_ids = 0
        self.open: list[Window] = []

    def add(self, doc_id, ids: np.ndarray) -> Iterator[tuple]:
        whole = len(ids) // self.capacity * self.capacity
        for start in range(0, whole, self.capacity):
            yield from self._emit(Window(self.capacity, [(doc_id, start, ids[start : start + self.capacity], len(ids))]))
        if whole == len(ids):
            return
        # A copy: a slice would hold all of a long document's ids.
        rest = (doc_id, whole, ids[whole:].copy(), len(ids))
        if whole or sum(w.free for w in self.open) > MOST_FREE * self.target:
            yield from self._top_up(rest, self.least)
        else:
            if self.whole and _size(self.whole[-1]) + len(rest[2]) <= self.bundle:
                self.whole[-1].append(rest)
            else:
                self.whole.append([rest])
            self.whole_ids += len(rest[2])
        if self.whole_ids + max(self.fill_ids - RESERVE * self.target, 0) >= self.target:
            yield from self._divide()

    def _divide(self) -> Iterator[tuple]:
        numbers, self.whole, self.whole_ids = self.whole, [], 0
        while self.fill_ids > RESERVE * self.target:
            numbers.append([self._next_fill()])
        for window in windows_of([_size(n) for n in numbers], self.capacity):
            yield from self._opened(Window(self.capacity, [r for i in sorted(window) for r in numbers[i]]), self.least)
        while self.open and self.fill:
            yield from self._top_up(self._next_fill(), self.least)

    def close(self) -> Iterator[tuple]:
        """The last batch: its count rises by one window at most, then the longest documents are cut to top up."""
        while self.open and self.fill:
            yield from self._top_up(self._next_fill(), self.least)
        numbers = []
        for bundle in sorted(self.whole, key=_size, reverse=True):
            place = self._best(_size(bundle))
            if place is None:
                numbers.append(bundle)
            else:
                for rest in bundle:
                    place.put(rest)
        numbers += [[rest] for rest in self.fill]
        self.whole, self.whole_ids, self.fill, self.fill_ids = [], 0, deque(), 0
        numbers.sort(key=_size)
        cut: list[tuple] = []
        least = -(-sum(map(_size, numbers)) // self.capacity)
        ways = least
        while numbers:
            found = difference([_size(n) for n in numbers], ways)
            if max(sum(_size(numbers[i]) for i in window) for window in found) <= self.capacity:
                break
            if ways == least:
                ways += 1
            else:
                cut += numbers.pop()
        if numbers:
            filled = [Window(self.capacity, [r for i in sorted(window) for r in numbers[i]]) for window in found]
            self.open += filled + [Window(self.capacity) for _ in range(ways - len(filled))]
        for rest in cut:
            yield from self._top_up(rest, 1)
        # Windows that the others have room for are dissolved, so a task has at most about one more than it must.
        while sum(w.free for w in self.open) >= 2 * self.capacity:
            emptiest = max(self.open, key=lambda w: w.free)
            self.open.remove(emptiest)
            for rest in emptiest.rests:
                yield from self._top_up(rest, 1)
        for window in self.open:
            yield from self._emit(window)
        self.open = []

    def _next_fill(self) -> tuple:
        rest = self.fill.popleft()
        self.fill_ids -= len(rest[2])
        return rest

    def _best(self, size: int) -> Window | None:
        """The open window with the least free ids that still holds `size`."""
        return min((w for w in self.open if w.free >= size), key=lambda w: w.free, default=None)

    def _top_up(self, rest: tuple, least: int) -> Iterator[tuple]:
        """Puts a rest into open windows, cut only if none holds it; what no window has room for is held back."""
        doc_id, start, ids, total = rest
        while len(ids) and self.open:
            place = self._best(len(ids)) or max(self.open, key=lambda w: w.free)
            n = min(place.free, len(ids))
            if 0 < len(ids) - n < least:
                n = max(len(ids) - least, 1)
            place.put((doc_id, start, ids[:n], total))
            start, ids = start + n, ids[n:]
            self.open.remove(place)
            yield from self._opened(place, least)
        if len(ids):
            self.fill.append((doc_id, start, ids, total))
            self.fill_ids += len(ids)

    def _opened(self, window: Window, least: int) -> Iterator[tuple]:
        """Keeps a window open if it is worth topping up."""
        if window.free >= least:
            self.open.append(window)
        else:
            yield from self._emit(window)

    def _emit(self, window: Window) -> Iterator[tuple]:
        if not window.rests:
            return
        number, offset = self.next_sequence, 0
        self.next_sequence += 1
        for doc_id, start, ids, total in window.rests:
            yield doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, number, offset
            offset += len(ids)


def pack(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    tokenizer_folder: str | None = None,
) -> DataFrame:
    """Rows `PIECES`: where each run of a document's ids lies.

    A document is its text's ids and `end_id`; a null or empty text has `end_id` alone. Rows are packed as
    they are: repeated rows and ids each take their place, null ids stay null. An empty table gives no rows.
    Very long texts give whole windows at once; only their last ids wait to be packed.
    `sequence_id` holds the task in its upper bits, so tasks need not know of each other; each task leaves at
    most one batch that is not full.
    """
    schema = arrow_schema(docs.sparkSession, PIECES)

    def run(batches):
        tokenizer = public_tokenizer(tokenizer_folder)
        packer = Packer(TaskContext.get().partitionId(), capacity)
        rows: list[tuple] = []
        for batch in batches:
            for key, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(tokenizer.ids(content.as_py()), np.array([end_id], dtype="<u4"))
                rows.extend(packer.add(key, ids))
                if len(rows) >= 20_000:
                    yield from _batch(rows, schema)
                    rows = []
            give_back()
        rows.extend(packer.close())
        yield from _batch(rows, schema)

    source = docs.select(F.col(doc_id).cast("long"), F.coalesce(F.col(text), F.lit("")))
    return source.mapInArrow(run, PIECES)


def _batch(rows: list[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    if rows:
        yield from as_batches(dict(zip(schema.names, zip(*rows))), schema)
