"""Suffix order and common prefixes of a sequence of symbols by external induced sorting.

Suffixes are of type S if they are smaller than the one that starts a place later, else of type L; an S suffix after
an L suffix is a seed. From the order of the seeds one ascending scan induces the order of the L suffixes, and one
descending scan that of the S suffixes: whoever is scanned sends the suffix before it to the queue of that suffix's
symbol. Suffixes reach a queue in their final order, so the queues by symbol are one priority queue of (symbol, rank):
the smallest (or greatest) symbol is taken next, and within it first in is first out. Queues hold tuples of place and
common prefix in blocks, in memory up to a limit and beyond it in a scratch file of the task.

The common prefix of two suffixes sent to one queue in turn is one more than the least of those scanned between
them. Common prefixes are counted up to a cap, and beyond the cap the order does not matter.

The seeds' own order comes from the same procedure: seeds are induced once in any order, which sorts the pieces
between them; equal pieces get equal names, and the sequence of names, at most half as long, is sorted by recursion.
It ends where all names differ, or where the names fit into memory: there ranks are doubled instead.
"""

from __future__ import annotations

import heapq
import tempfile
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np

from formwright.llm.common import U64, RollingHash, mix

#: Tuples that the queues of one scan hold in memory, and symbols up to which names are sorted there.
IN_MEMORY = 1 << 22
#: Tuples scanned at a time.
BLOCK = 1 << 16

_HASH = RollingHash(41)


def stored(values: np.ndarray, limit: int) -> np.ndarray:
    """The values themselves, or beyond `limit` of them a map of a scratch file."""
    if len(values) <= limit:
        return values
    with tempfile.TemporaryFile() as file:
        out = np.memmap(file, values.dtype, "w+", shape=values.shape)
    out[:] = values
    return out


class Queues:
    """First-in first-out queues of (place, common prefix) by symbol, in blocks; see the module for the limit."""

    def __init__(self, limit: int, descending: bool = False):
        self.limit = limit
        self.sign = -1 if descending else 1
        self.blocks: dict[int, list] = {}
        self.symbols: list[int] = []
        self.held = 0
        self.file = None

    def push(self, symbol: int, place: np.ndarray, prefix: np.ndarray) -> None:
        queue = self.blocks.get(symbol)
        if queue is None:
            queue = self.blocks[symbol] = []
            heapq.heappush(self.symbols, self.sign * symbol)
        queue.append((place, prefix))
        self.held += len(place)
        if self.held > self.limit:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for queue in self.blocks.values():
            for k, block in enumerate(queue):
                if isinstance(block[0], np.ndarray):
                    at = self.file.tell()
                    self.file.write(np.ascontiguousarray(block[0], np.int64).tobytes())
                    self.file.write(np.ascontiguousarray(block[1], np.int16).tobytes())
                    queue[k] = (at, len(block[0]))
        self.held = 0

    def _load(self, block: tuple) -> tuple[np.ndarray, np.ndarray]:
        if isinstance(block[0], np.ndarray):
            self.held -= len(block[0])
            return block
        at, n = block
        self.file.seek(at)
        return np.frombuffer(self.file.read(8 * n), np.int64), np.frombuffer(self.file.read(2 * n), np.int16)

    def first_symbol(self) -> int | None:
        return self.sign * self.symbols[0] if self.symbols else None

    def drain(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks of a symbol's queue, those that come in meanwhile too, joined to larger ones where they lie ready."""
        queue = self.blocks.get(symbol)
        if queue is None:
            return
        while queue:
            taken = [self._load(queue.pop(0))]
            size = len(taken[0][0])
            while queue and size < BLOCK:
                taken.append(self._load(queue.pop(0)))
                size += len(taken[-1][0])
            place, prefix = taken[0] if len(taken) == 1 else (np.concatenate(x) for x in zip(*taken))
            for start in range(0, len(place), BLOCK):
                yield place[start : start + BLOCK], prefix[start : start + BLOCK]
        del self.blocks[symbol]
        if self.symbols and self.symbols[0] == self.sign * symbol:
            heapq.heappop(self.symbols)

    def backwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The blocks of a symbol's queue from the last to the first, each turned round; the queue stays."""
        for block in reversed(self.blocks.get(symbol, [])):
            kept = self.held
            place, prefix = self._load(block)
            self.held = kept
            yield place[::-1], prefix[::-1]

    def forwards(self, symbol: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for block in self.blocks.get(symbol, []):
            kept = self.held
            yield self._load(block)
            self.held = kept


class _Scan:
    """One scan: sends the suffixes before the scanned ones to their queues, with their common prefixes."""

    def __init__(self, text: np.ndarray, wanted: np.ndarray, queues: Queues, cap: int):
        self.text, self.wanted, self.queues, self.cap = text, wanted, queues, cap
        self.seen: dict[int, tuple[int, int]] = {}  # symbol: (block of its last push, least prefix after it there)
        self.number = 0
        self.at: list[int] = []  # blocks, and the least prefix from each of them on
        self.least: list[int] = []

    def _between(self, symbol: int) -> int:
        number, tail = self.seen[symbol]
        k = bisect_left(self.at, number + 1)
        return min(tail, self.least[k]) if k < len(self.least) else tail

    def scan(self, place: np.ndarray, prefix: np.ndarray) -> None:
        before = place - 1
        index = np.flatnonzero((place > 0) & self.wanted[before])
        before = before[index]
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        index, before, symbols = index[order], before[order], symbols[order]
        if len(index):
            heads = np.flatnonzero(np.diff(symbols, prepend=-1))
            start = np.empty_like(index)
            start[1:] = index[:-1] + 1
            start[heads] = 0
            pairs = np.empty(2 * len(index), np.int64)
            pairs[::2], pairs[1::2] = start, index + 1
            padded = np.append(prefix, np.int16(self.cap))
            least = np.minimum(np.minimum.reduceat(padded, pairs)[::2] + 1, self.cap).astype(np.int16)
            ends = np.append(heads[1:], len(index))
            pushed = {}
            for head, end, symbol in zip(heads.tolist(), ends.tolist(), symbols[heads].tolist()):
                if symbol in self.seen:
                    least[head] = min(least[head], self._between(symbol) + 1, self.cap)
                else:
                    least[head] = 0
                last = int(index[end - 1]) + 1
                pushed[symbol] = (self.number, int(prefix[last:].min()) if last < len(prefix) else self.cap)
                self.queues.push(symbol, before[head:end], least[head:end])
            self.seen.update(pushed)
        smallest = int(prefix.min())
        while self.least and self.least[-1] >= smallest:
            self.least.pop()
            self.at.pop()
        # The stack's entry stands for all blocks after the one below it.
        self.at.append(self.number)
        self.least.append(smallest)
        self.number += 1


def common_prefixes(text: np.ndarray, first: np.ndarray, second: np.ndarray, cap: int) -> np.ndarray:
    """How many symbols, up to `cap`, the suffixes at `first` and `second` have in common, pair by pair."""
    out = np.zeros(len(first), np.int16)
    rest = np.arange(len(first))
    step = 1
    if text.dtype == np.uint16 and len(text) > 3:
        # Four symbols at a time, as long as there are four.
        step = 4
        packed = text[:-3].astype(U64)
        for k in (1, 2, 3):
            packed |= text[k : len(text) - 3 + k].astype(U64) << U64(16 * k)
        for k in range(0, cap - 3, 4):
            a, b = first[rest] + k, second[rest] + k
            inside = np.maximum(a, b) < len(packed)
            same = np.zeros(len(rest), bool)
            same[inside] = packed[a[inside]] == packed[b[inside]]
            rest = rest[same]
            out[rest] += 4
            if not len(rest):
                break
        rest = np.arange(len(first))
    for _ in range(cap if step == 1 else 4):
        a, b = first[rest] + out[rest], second[rest] + out[rest]
        inside = (a < len(text)) & (b < len(text)) & (out[rest] < cap)
        rest, a, b = rest[inside], a[inside], b[inside]
        rest = rest[text[a] == text[b]]
        out[rest] += 1
        if not len(rest):
            break
    return out


def _pair(text: np.ndarray, a: int, b: int, cap: int) -> int:
    x, y = text[a : a + cap], text[b : b + cap]
    n = min(len(x), len(y))
    differ = np.flatnonzero(x[:n] != y[:n])
    return int(differ[0]) if len(differ) else n


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray, cap: int, limit: int):
    """All suffixes as blocks of (place, common prefix with the one before), ascending, from the ordered seeds."""
    start = Queues(limit)
    symbols = text[seeds]
    heads = np.flatnonzero(np.diff(symbols, prepend=-1))
    for head, end in zip(heads.tolist(), np.append(heads[1:], len(seeds)).tolist()):
        first = prefixes[head:end].copy()
        first[0] = 0
        start.push(int(symbols[head]), seeds[head:end], first)

    left, lefts = Queues(limit), Queues(limit)
    scan = _Scan(text, ~is_s, left, cap)
    while True:
        nearest = [s for s in (left.first_symbol(), start.first_symbol()) if s is not None]
        if not nearest:
            break
        symbol, last = min(nearest), None
        for place, prefix in left.drain(symbol):
            lefts.push(symbol, place, prefix)
            scan.scan(place, prefix)
            last = int(place[-1])
        for place, prefix in start.drain(symbol):
            if last is not None:
                prefix = prefix.copy()
                prefix[0] = _pair(text, last, int(place[0]), cap)
                last = None
            scan.scan(place, prefix)

    right, rights = Queues(limit, descending=True), Queues(limit)
    scan = _Scan(text, is_s, right, cap)
    remaining = sorted(lefts.blocks)
    while True:
        waiting = [s for s in (right.first_symbol(), remaining[-1] if remaining else None) if s is not None]
        if not waiting:
            break
        symbol, last = max(waiting), None
        for place, prefix in right.drain(symbol):
            rights.push(symbol, place, prefix)
            scan.scan(place, prefix)
            last = int(place[-1])
        if remaining and remaining[-1] == symbol:
            remaining.pop()
            upper = 0 if last is None else _pair(text, last, _last_of(lefts, symbol), cap)
            for place, prefix in lefts.backwards(symbol):
                shifted = np.concatenate([[upper], prefix[:-1]]).astype(np.int16)
                upper = int(prefix[-1])
                scan.scan(place, shifted)

    for symbol in sorted({*lefts.blocks, *rights.blocks}):
        last = None
        for place, prefix in lefts.forwards(symbol):
            yield place, prefix
            last = int(place[-1])
        seam = None
        for place, prefix in rights.backwards(symbol):
            # Turned round, a suffix's prefix is that of the one before it in this order.
            if seam is None:
                seam = 0 if last is None else _pair(text, last, int(place[0]), cap)
            yield place, np.concatenate([[seam], prefix[:-1]]).astype(np.int16)
            seam = int(prefix[-1])


def _last_of(queues: Queues, symbol: int) -> int:
    return int(next(queues.backwards(symbol))[0][0])


def types_of(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; the last counts as such."""
    n = len(text)
    differs = np.append(text[:-1] != text[1:], True)
    following = np.minimum.accumulate(np.where(differs, np.arange(n), n)[::-1])[::-1]
    less = np.append(text[:-1] < text[1:], True)
    return less[following]


def _names(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, limit: int) -> tuple[np.ndarray, int]:
    """The names of the pieces from each seed to the next, in text order, and how many there are."""
    by_symbol = seeds[np.argsort(text[seeds], kind="stable")]
    is_seed = np.zeros(len(text), bool)
    is_seed[seeds] = True
    found = [place[is_seed[place]] for place, _ in induce(text, is_s, by_symbol, np.zeros(len(seeds), np.int16), 1, limit)]
    ranked = np.concatenate([seeds[-1:], *found])  # the last seed, the end of the text, is sent by none
    end = np.append(seeds[1:] + 1, len(text))
    with np.errstate(over="ignore"):
        sums = _HASH.prefix(mix(text.astype(U64) + U64(1)))
        piece = _HASH.ranges(sums, seeds, end)
    number = np.searchsorted(seeds, ranked)
    names = np.empty(len(seeds), np.int64)
    names[number] = np.cumsum(np.diff(piece[number], prepend=piece[number[0]]) != 0)
    return names, int(names.max()) + 1


def _doubled(names: np.ndarray, reach_wanted: int) -> np.ndarray:
    """The order of the names' suffixes, by at least so many names."""
    n, rank, reach = len(names), names, 1
    while True:
        following = np.zeros(n, np.int64)
        following[: max(n - reach, 0)] = rank[reach:] + 1
        pair = rank * (n + 1) + following
        order = np.argsort(pair)
        pair = pair[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(False, pair[1:] != pair[:-1]))
        rank, reach = new, 2 * reach
        if reach >= reach_wanted or rank[order[-1]] == n - 1:
            return order


def sorted_suffixes(text: np.ndarray, cap: int, limit: int = IN_MEMORY) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (place, common prefix with the suffix before, at most `cap`) of all suffixes in ascending order.

    Symbols are whole numbers; the last one is smaller than all others and occurs once. Suffixes that agree in `cap`
    symbols stand in any order. The last suffix, the sentinel's, is left out. At most `limit` tuples of a queue,
    and names of a recursion, are in memory.
    """
    text = stored(text, 8 * limit)
    is_s = stored(types_of(text), 8 * limit)
    seeds = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(text) < 2:
        return
    names, many = _names(text, is_s, seeds, limit)
    if many == len(names):
        order = np.argsort(names)
    elif len(names) <= limit:
        order = _doubled(names, (cap + 1) // 2)  # a name stands for two symbols at least
    else:
        order = np.concatenate([[len(names) - 1], *(place for place, _ in sorted_suffixes(names, cap, limit))])
    ranked = seeds[order]
    prefixes = np.zeros(len(ranked), np.int16)
    prefixes[1:] = common_prefixes(text, ranked[:-1], ranked[1:], cap)
    yield from induce(text, is_s, ranked, prefixes, cap, limit)
