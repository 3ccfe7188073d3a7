"""Arrays of one large JSON object, read by several tasks.

`{"texts": [...], "labels": [...]}` is one value to a JSON reader and so one row in one task. Here the file is cut
into blocks of bytes:

1. Every block is summarized on its own, once as if it began outside a string and once as if inside: how the depth
   changes, where the last name's colon stands, and how many commas follow the last opened bracket, by depth relative
   to the block's start.
2. The summaries of a file, a few hundred bytes each, are run through in order and give the state every block starts in.
3. Every block is read again from its known start and gives the elements whose separator lies in it; the last of them
   is read on beyond the block's end.

So no task holds more than a block, or one element where that is longer.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK_BYTES = 8 << 20
#: A name must end within so many bytes before its colon.
LONGEST_NAME = 1 << 16
ROWS_AT_ONCE, BYTES_AT_ONCE = 4096, 4 << 20

_IN_STRING = rb'[^"\\]*+(?:\\.[^"\\]*+)*+'
#: A whole string, one that the buffer's end cuts, or a sign of structure.
_TOKEN = re.compile(rb'"' + _IN_STRING + rb'(?:"|\\?\Z)|[\[\]{},:]', re.S)
_REST = re.compile(_IN_STRING + rb'(?:"|\\?\Z)', re.S)

ELEMENTS = "path string, name string, pos long, value string"


class Start(NamedTuple):
    """Where a block begins: inside a string or not, how deep, after which name's colon, in which container's which element."""

    inside: bool = False
    depth: int = 0
    colon: int = -1
    is_array: bool = False
    index: int = 0


def summary(data: bytes, offset: int, inside: bool, escaped: bool) -> dict:
    """What `data`, found at `offset`, does to a state; levels are relative to the depth at its start."""
    at, ends_inside = 0, False
    if inside:
        rest = _REST.match(data, 1 if escaped and data else 0)
        at, ends_inside = rest.end(), not _closed(rest[0])
    depth, colons, levels = 0, {}, {}
    for token in _TOKEN.finditer(data, at) if not ends_inside else ():
        sign = token[0]
        if sign in b"[{":
            depth += 1
            levels[depth] = [sign == b"[", 0]
        elif sign in b"]}":
            depth -= 1
        elif sign == b",":
            levels.setdefault(depth, [None, 0])[1] += 1
        elif sign == b":":
            colons[depth] = offset + token.start()
        elif len(sign) < 2 or not _closed(sign[1:]):
            ends_inside = True
    # A block starts at no less than depth 0, and only names at depth 1 and elements at depth 2 are asked for.
    return {
        "inside": ends_inside,
        "depth": depth,
        "colons": {k: v for k, v in colons.items() if k <= 1},
        "levels": {k: v for k, v in levels.items() if k <= 2},
    }


def _closed(rest: bytes) -> bool:
    """Whether a string's part, from within it on, holds its closing quote: it can only be its last byte."""
    if not rest.endswith(b'"'):
        return False
    body = rest[:-1]
    return (len(body) - len(body.rstrip(b"\\"))) % 2 == 0


def after(start: Start, change: dict) -> Start:
    """The state behind a block that begins at `start` and has the summary `change` for it."""
    colon = change["colons"].get(1 - start.depth, start.colon)
    is_array, index = start.is_array, start.index
    if (level := change["levels"].get(2 - start.depth)) is not None:
        opened, commas = level
        is_array, index = (is_array, index + commas) if opened is None else (opened, commas)
    return Start(change["inside"], start.depth + change["depth"], colon, is_array, index)


class Bytes:
    """Ranges of a file on any file system that Arrow knows by the path's address."""

    def __init__(self, path: str):
        from pyarrow import fs

        if "://" in path:
            system, place = fs.FileSystem.from_uri(path)
        else:
            system, place = fs.LocalFileSystem(), path.removeprefix("file:")
        self._file = system.open_input_file(place)
        self.size = self._file.size()

    def read(self, start: int, end: int) -> bytes:
        return self._file.read_at(max(min(end, self.size) - start, 0), start)

    def escaped(self, at: int) -> bool:
        """Whether an odd number of backslashes stands before `at`."""
        n, end = 0, at
        while end:
            part = self.read(max(end - 4096, 0), end)
            run = len(part) - len(part.rstrip(b"\\"))
            n, end = n + run, end - len(part)
            if run < len(part):
                break
        return n % 2 == 1

    def name(self, colon: int) -> str:
        """The string before a colon."""
        part = self.read(max(colon - LONGEST_NAME, 0), colon).rstrip()
        end = len(part) - 1
        begin = part.rfind(b'"', 0, end)
        while begin > 0 and (begin - len(part[:begin].rstrip(b"\\"))) % 2:
            begin = part.rfind(b'"', 0, begin)
        if begin < 0:
            raise ValueError(f"no name within {LONGEST_NAME} bytes before byte {colon}")
        return json.loads(part[begin : end + 1])

    def close(self) -> None:
        self._file.close()


def elements(file: Bytes, begin: int, end: int, start: Start, names: dict[int, str] | None = None) -> Iterator[tuple]:
    """(name, pos, JSON text) of the elements of arrays directly in the object whose separator lies in the block."""
    names = {} if names is None else names
    end = min(end, file.size)
    data, base, step = file.read(begin, end), begin, max(end - begin, 64)
    depth, colon, is_array, index = start.depth, start.colon, start.is_array, start.index
    at, opened, pending = 0, None, start.inside
    first = 1 if pending and file.escaped(begin) else 0

    def grow() -> bool:
        """More of the file behind the buffer, each time twice as much; what lies before the open element goes."""
        nonlocal data, base, at, opened, step
        more = file.read(base + len(data), base + len(data) + step)
        step *= 2
        drop = at if opened is None else opened
        data, base, at = data[drop:] + more, base + drop, at - drop
        opened = None if opened is None else 0
        return bool(more)

    if pending:
        rest = _REST.match(data, first)
        if not _closed(rest[0]):
            return  # the whole block lies in one string
        at = rest.end()
    while True:
        token = _TOKEN.search(data, at)
        if token is None or (token[0][:1] == b'"' and (len(token[0]) < 2 or not _closed(token[0][1:]))):
            if opened is None:
                return
            at = len(data) if token is None else token.start()
            if not grow():
                return
            continue
        sign, place = token[0], base + token.start()
        if place >= end and opened is None:
            return
        at = token.end()
        ends = depth == 2 and sign in (b",", b"]")
        if ends and opened is not None:
            value = data[opened : token.start()].strip()
            if value:
                if colon not in names:
                    names[colon] = file.name(colon)
                yield names[colon], index, value.decode()
            opened = None
            if place >= end:
                return
        if sign in (b"[", b"{"):
            depth += 1
            if depth == 2:
                is_array, index = sign == b"[", 0
                opened = at if is_array else None
        elif sign in (b"]", b"}"):
            depth -= 1
        elif sign == b"," and depth == 2:
            index += 1
            opened = at if is_array else None
        elif sign == b":" and depth == 1:
            colon = place


def _per_file(batches: Iterable[pa.RecordBatch], read) -> Iterator[tuple]:
    """`read(file, row)` for each row, files opened one at a time."""
    path, file = None, None
    for batch in batches:
        for row in batch.to_pylist():
            if row["path"] != path:
                if file:
                    file.close()
                path, file = row["path"], Bytes(row["path"])
            yield row, read(file, row)
    if file:
        file.close()


def _summaries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def read(file: Bytes, row: dict) -> tuple[str, str]:
        data = file.read(row["begin"], row["end"])
        escaped = file.escaped(row["begin"])
        return tuple(json.dumps(summary(data, row["begin"], inside, escaped)) for inside in (False, True))

    for row, (outside, inside) in _per_file(batches, read):
        yield pa.RecordBatch.from_pylist([row | {"outside": outside, "within": inside}])


def _starts(table: pa.Table) -> pa.Table:
    """The state each block of one file starts in."""
    table = table.sort_by("begin")
    state, out = Start(), []
    for outside, within in zip(table["outside"].to_pylist(), table["within"].to_pylist()):
        out.append(json.dumps(state))
        change = json.loads(within if state.inside else outside)
        for part in ("colons", "levels"):
            change[part] = {int(k): v for k, v in change[part].items()}
        state = after(state, change)
    return table.select(["path", "begin", "end"]).append_column("start", pa.array(out, pa.string()))


def _elements(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = pa.schema([("path", pa.string()), ("name", pa.string()), ("pos", pa.int64()), ("value", pa.string())])

    def read(file: Bytes, row: dict) -> Iterator[tuple]:
        return elements(file, row["begin"], row["end"], Start(*json.loads(row["start"])))

    rows, size = [], 0
    for row, found in _per_file(batches, read):
        for name, pos, value in found:
            rows.append({"path": row["path"], "name": name, "pos": pos, "value": value})
            size += len(value)
            if len(rows) >= ROWS_AT_ONCE or size >= BYTES_AT_ONCE:
                yield pa.RecordBatch.from_pylist(rows, fields)
                rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, fields)


def read_arrays(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, name, pos, value): the elements, as JSON text, of the arrays directly in the object of each file.

    Other values of the object are passed over, empty arrays and empty files give no rows. Files must hold valid JSON.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block_bytes).cast("long")))
    blocks = files.select("path", begins.alias("begin")).withColumn("end", F.col("begin") + block_bytes)
    parts = max(min(blocks.count(), 10_000), 1)

    def spread(df: DataFrame) -> DataFrame:
        return df.repartition(parts, "path", "begin").sortWithinPartitions("path", "begin")

    block = "path string, begin long, end long"
    summaries = spread(blocks).mapInArrow(_summaries, f"{block}, outside string, within string")
    starts = summaries.groupBy("path").applyInArrow(_starts, f"{block}, start string")
    return spread(starts).mapInArrow(_elements, ELEMENTS)


def paired(arrays: DataFrame, first: str, second: str, element: str) -> DataFrame:
    """(path, pos, first, second): two arrays side by side, read as type `element`; positions only one has give NULL."""

    def side(name: str) -> Column:
        text = F.max(F.when(F.col("name") == name, F.col("value")))
        return F.from_json(F.concat(F.lit("["), text, F.lit("]")), f"array<{element}>")[0].alias(name)

    wanted = arrays.where(F.col("name").isin(first, second))
    return wanted.groupBy("path", "pos").agg(side(first), side(second))
