"""The prefix trie of conversations, its subtree totals by time-forward processing.

A node is a distinct sequence of first turns. Its id is two 64-bit exclusive sums over hashes of (depth, turn), so
ids of all prefixes come from sums over blocks of turns, however long a conversation is; nodes are then a grouped
count of rows. What a node needs of its subtree (children, leaves, saved bytes) goes upwards as messages:

- A node's weight, the turns of its members from there on, bounds its subtree. Subtrees of at most `SHARD` turns are
  light; each whole one is a shard. Heavy nodes, which are few at any depth, are cut into bands of `BAND` levels, and
  each connected part of a band is a shard.
- Within a shard Spark sorts the nodes by reverse level (externally) and they are passed through once; a node takes
  the messages addressed to it from a priority queue and sends its totals to its parent. The queue spills to a
  scratch file of the task, so a shard may be larger than memory.
- Totals of light shards are summed by parent. The shard roots of the bands form a tree themselves, in which the same
  pass goes across the shards; then each band is passed once more, with the totals of the shards below it.

Spill files are private to one attempt of a task and are gone when it ends; a task that is run again makes its own.
"""

from __future__ import annotations

import hashlib
import heapq
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwright.llm.common import arrow_schema, as_batches, join_counted, numbered, written

SHARD = 1 << 16
BAND = 1 << 10
#: Messages that a queue holds in memory.
IN_MEMORY = 1 << 18
#: Ids joined into one text before texts are hashed in order.
IDS_AT_A_TIME = 4096
#: Turns whose hashes are summed in one window.
BLOCK_BITS = 10

KEY = ["depth", "p1", "p2"]
SHARD_KEY = ["top", "s1", "s2"]
PARENT = ["above", "q1", "q2"]
TOTALS = ["n_children", "n_leaves", "saved_tokens"]


# ---- turns --------------------------------------------------------------------------------------


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, j, n, h1, h2, n_bytes): the turns in order from 0, and how many their conversation has.

    Turns ascend by `turn` (null first), equal ones by a digest of role and text. A null role or text counts as empty.
    Rows without a conv_id belong to no conversation and are left out; repeated rows are turns of their own.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        F.md5(F.concat(role, F.lit("\0"), text)).alias("tie"),
        F.xxhash64(role, text).alias("h1"),
        F.xxhash64(text, F.lit("2"), role).alias("h2"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    placed = numbered(written(rows, "turns"), ["conv_id"], ["turn", "tie"], "j", "n")
    return written(placed.select("conv_id", "j", "n", "h1", "h2", "n_bytes"), "numbered-turns")


def rebuilt(turns: DataFrame, base: Column, head: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of another one: (conv_id, depth, length, h1, h2, n_bytes), and all (conv_id, length).

    Of conversation `base` (a column over conv_id) the first `head` turns, at most `most`, or all if it has fewer,
    none if it does not exist; then the conversation's own turns after its first `head`.
    """
    own = turns.groupBy("conv_id").agg(F.max("n").alias("n"))
    named = own.select("conv_id", "n", base.alias("base"), head.cast("long").alias("head"))
    lengths = own.select(F.col("conv_id").alias("base"), F.col("n").alias("base_n"))
    taken = F.least("head", F.coalesce("base_n", F.lit(0)))
    plan = named.join(lengths, "base", "left").select(
        "conv_id", "base", "head", "n", taken.alias("taken"), (taken + F.greatest(F.col("n") - F.col("head"), F.lit(0))).alias("length")
    )
    plan = written(plan, "rebuilt-plan")
    columns = ["conv_id", "depth", "length", "h1", "h2", "n_bytes"]
    kept = join_counted(turns.drop("n"), plan, ["conv_id"], "n", "inner").where("j >= head")
    first = turns.where(F.col("j") < most).drop("n").withColumnRenamed("conv_id", "base").join(plan, "base").where("j < head")
    rows = kept.withColumn("depth", F.expr("j - head + taken + 1")).select(*columns).unionByName(
        first.withColumn("depth", F.col("j") + 1).select(*columns)
    )
    return written(rows, "rebuilt"), plan.select("conv_id", "length")


def with_prefixes(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, depth, length, h1, h2, n_bytes) with the ids (p1, p2) of the prefix that ends there, and its parent's (q1, q2)."""
    hashed = rows.select(
        "conv_id",
        "depth",
        "length",
        "n_bytes",
        F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block"),
        F.xxhash64(F.lit(1), "depth", "h1").alias("e1"),
        F.xxhash64(F.lit(2), "depth", "h2").alias("e2"),
    )
    here = Window.partitionBy("conv_id", "block").orderBy("depth")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = hashed.groupBy("conv_id", "block").agg(F.bit_xor("e1").alias("x1"), F.bit_xor("e2").alias("x2"))
    earlier = sums.select("conv_id", "block", *[F.coalesce(F.bit_xor(f"x{i}").over(before), F.lit(0)).alias(f"b{i}") for i in (1, 2)])
    within = hashed.withColumns({f"w{i}": F.bit_xor(f"e{i}").over(here) for i in (1, 2)})
    whole = within.join(earlier, ["conv_id", "block"])
    ids = whole.withColumns({f"p{i}": F.col(f"w{i}").bitwiseXOR(F.col(f"b{i}")) for i in (1, 2)})
    return ids.select(
        "conv_id", "depth", "length", "n_bytes", "p1", "p2",
        *[F.col(f"p{i}").bitwiseXOR(F.col(f"e{i}")).alias(f"q{i}") for i in (1, 2)],
    )


# ---- one pass over sorted nodes -----------------------------------------------------------------


class SpillingQueue:
    """A priority queue of equally long tuples of whole numbers; beyond `limit` of them sorted runs go to a scratch file."""

    def __init__(self, limit: int = IN_MEMORY):
        self.limit = limit
        self._heap: list[tuple] = []
        self._runs: list[tuple] = []  # (head, number, rest) of each run
        self._number = 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self._heap, item)
        if len(self._heap) > self.limit:
            self._spill(iter(sorted(self._heap)), len(self._heap))
            self._heap = []
            if len(self._runs) > 64:
                self._merge()

    def _spill(self, items: Iterator[tuple], count: int) -> None:
        file = tempfile.TemporaryFile()
        width = 0
        for start in range(0, count, 4096):
            block = np.array([next(items) for _ in range(min(4096, count - start))], np.int64)
            width = block.shape[1]
            file.write(block.tobytes())
        file.seek(0)
        self._add(self._read(file, width))

    def _add(self, run: Iterator[tuple]) -> None:
        head = next(run, None)
        if head is not None:
            self._number += 1
            heapq.heappush(self._runs, (head, self._number, run))

    @staticmethod
    def _read(file, width: int) -> Iterator[tuple]:
        with file:
            while data := file.read(4096 * width * 8):
                yield from map(tuple, np.frombuffer(data, np.int64).reshape(-1, width).tolist())

    def _merge(self) -> None:
        """All runs as one."""
        runs, self._runs = self._runs, []

        def items():
            while runs:
                head, number, run = runs[0]
                yield head
                following = next(run, None)
                if following is None:
                    heapq.heappop(runs)
                else:
                    heapq.heapreplace(runs, (following, number, run))

        file = tempfile.TemporaryFile()
        width, block = 0, []
        for item in items():
            width = len(item)
            block.append(item)
            if len(block) == 4096:
                file.write(np.array(block, np.int64).tobytes())
                block = []
        if block:
            file.write(np.array(block, np.int64).tobytes())
        file.seek(0)
        self._add(self._read(file, width))

    def take(self, key: tuple) -> Iterator[tuple]:
        """Removes and gives the items that begin with `key`; no smaller one may be left."""
        n = len(key)
        while self._heap and self._heap[0][:n] == key:
            yield heapq.heappop(self._heap)
        while self._runs and self._runs[0][0][:n] == key:
            head, number, run = self._runs[0]
            following = next(run, None)
            if following is None:
                heapq.heappop(self._runs)
            else:
                heapq.heapreplace(self._runs, (following, number, run))
            yield head

    def __len__(self) -> int:
        return len(self._heap) + len(self._runs)


def time_forward(rows: Iterable[tuple], childless_is_leaf: bool, limit: int = IN_MEMORY) -> Iterator[tuple]:
    """(depth, p1, p2, children, leaves, saved) of rows sorted by shard, reverse level and id.

    Rows are (shard, depth, p1, p2, above, q1, q2, children, leaves, saved); the last three are the node's own and
    what came from outside the shard. Messages to nodes outside the shard are dropped with the shard's queue.
    """
    queue, current = SpillingQueue(limit), None
    for shard, depth, p1, p2, above, q1, q2, children, leaves, saved in rows:
        if shard != current:
            queue, current = SpillingQueue(limit), shard
        for *_, below_leaves, below_saved in queue.take((-depth, p1, p2)):
            children += 1
            leaves += below_leaves
            saved += below_saved
        if childless_is_leaf and not children:
            leaves = 1
        if (depth, p1, p2) != shard:  # the shard's root reports to another shard
            queue.push((-above, q1, q2, leaves, saved))
        yield depth, p1, p2, children, leaves, saved


def _forward(nodes: DataFrame, childless_is_leaf: bool, across: bool = False) -> DataFrame:
    """Subtree totals (KEY, TOTALS) of nodes with SHARD_KEY, KEY, PARENT and TOTALS, shard by shard.

    With `across` all nodes are one shard.
    """
    names = [*SHARD_KEY, *KEY, *PARENT, *TOTALS]
    dealt = nodes.select(*names)
    dealt = dealt.coalesce(1) if across else dealt.repartition(*SHARD_KEY)
    order = [] if across else SHARD_KEY
    schema = ", ".join(f"{c} long" for c in (*KEY, *TOTALS))
    target = arrow_schema(nodes.sparkSession, schema)
    limit = IN_MEMORY

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            for batch in batches:
                for row in zip(*[batch.column(c).to_pylist() for c in names]):
                    yield None if across else row[:3], *row[3:]

        block = []
        for row in time_forward(rows(), childless_is_leaf, limit):
            block.append(row)
            if len(block) == 8192:
                yield from as_batches(dict(zip((*KEY, *TOTALS), zip(*block))), target)
                block = []
        if block:
            yield from as_batches(dict(zip((*KEY, *TOTALS), zip(*block))), target)

    return dealt.sortWithinPartitions(*order, F.desc("depth"), "p1", "p2").mapInArrow(run, schema)


def _messages(roots: DataFrame) -> DataFrame:
    """What shard roots (PARENT, n_leaves, saved_tokens) tell their parents, as KEY and the sums."""
    return roots.groupBy(*[F.col(c).alias(k) for c, k in zip(PARENT, KEY)]).agg(
        F.count("*").alias("more_children"), F.sum("n_leaves").alias("more_leaves"), F.sum("saved_tokens").alias("more_saved")
    )


def _told(nodes: DataFrame, messages: DataFrame, *names: str) -> DataFrame:
    """`nodes` with the messages' sums of `names` (children, leaves, saved) added to theirs."""
    found = nodes.join(messages, KEY, "left")
    of = {"children": "n_children", "leaves": "n_leaves", "saved": "saved_tokens"}
    return found.withColumns({of[n]: F.col(of[n]) + F.coalesce(f"more_{n}", F.lit(0)) for n in names}).select(*nodes.columns)


# ---- the trie -----------------------------------------------------------------------------------


def _nodes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(KEY, PARENT, conv_id, n_convs, n_bytes, weight) of all nodes, the root included."""
    counted = rows.groupBy(*KEY).agg(
        F.min("q1").alias("q1"),
        F.min("q2").alias("q2"),
        F.min("conv_id").alias("conv_id"),
        F.count("*").alias("n_convs"),
        F.min("n_bytes").alias("n_bytes"),
        F.sum(F.col("length") - F.col("depth") + 1).alias("weight"),
    )
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.sum(F.col("length") + 1).alias("weight"))
    root = root.where("n_convs > 0").select(
        *[zero.alias(c) for c in (*KEY, "q1", "q2")], "conv_id", "n_convs", zero.alias("n_bytes"), "weight"
    )
    return counted.unionByName(root).withColumn("above", F.col("depth") - 1)


def _placed(nodes: DataFrame, rows: DataFrame, shard: int, band: int) -> DataFrame:
    """`nodes` with `heavy` and SHARD_KEY, the depth and the id of the shard's root."""
    heavy = written(nodes.where((F.col("weight") > shard) & (F.col("depth") > 0)).select(*KEY, "n_convs"), "heavy")
    deepest = join_counted(rows, heavy, KEY, "n_convs", "left_semi").groupBy("conv_id").agg(F.max("depth").alias("deepest"))
    owners = nodes.groupBy("conv_id").agg(F.count("*").alias("owned")).join(deepest, "conv_id", "left")
    found = join_counted(nodes, written(owners, "owners"), ["conv_id"], "owned", "inner").drop("owned")
    is_heavy = (F.col("weight") > shard) | (F.col("depth") == 0)
    top = F.when(is_heavy, F.col("depth") - F.col("depth") % band).otherwise(F.coalesce("deepest", F.lit(0)) + 1)
    shaped = found.withColumns({"heavy": is_heavy, "top": top}).drop("deepest")
    return _with_root(shaped, rows, "top", "s1", "s2")


def _with_root(nodes: DataFrame, rows: DataFrame, top: str, first: str, second: str) -> DataFrame:
    """`nodes` with the id of their ancestor of depth `top`: their least member passes through it."""
    at = rows.select("conv_id", F.col("depth").alias(top), F.col("p1").alias(first), F.col("p2").alias(second))
    found = nodes.join(at, ["conv_id", top], "left")
    return found.withColumns({c: F.coalesce(c, F.lit(0).cast("long")) for c in (first, second)})


def totals(nodes: DataFrame, rows: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """(KEY, n_children, n_leaves, saved_tokens) of written nodes, see the module."""
    own = nodes.withColumn("saved_tokens", (F.col("n_convs") - 1) * F.col("n_bytes"))
    own = own.withColumns({"n_children": F.lit(0).cast("long"), "n_leaves": F.lit(0).cast("long")})
    placed = written(_placed(own, rows, shard, band).select(*SHARD_KEY, *KEY, *PARENT, *TOTALS, "heavy", "conv_id"), "placed-nodes")
    light, heavy = placed.where("NOT heavy"), placed.where("heavy")

    low = written(_forward(light, True), "light-totals")
    tops = light.where("depth = top").select(*KEY, *PARENT).join(low, KEY)
    heavy = _told(heavy, _messages(tops), "children", "leaves", "saved")
    ports = heavy.where("depth = top AND depth > 0")
    heavy = written(_told(heavy, _messages(ports), "children"), "heavy-nodes")

    part = _forward(heavy, True)
    roots = heavy.where("depth = top").select(*KEY, *PARENT, "conv_id").join(part, KEY)
    outer = F.greatest(F.col("above") - F.pmod(F.col("above"), F.lit(band)), F.lit(-1))
    outer = F.when(F.col("depth") == 0, F.lit(-1)).otherwise(outer).cast("long")
    linked = written(_with_root(roots.withColumn("outer", outer), rows, "outer", "o1", "o2"), "shard-roots")
    tree = linked.select(
        *[F.lit(0).cast("long").alias(c) for c in SHARD_KEY], *KEY,
        F.col("outer").alias("above"), F.col("o1").alias("q1"), F.col("o2").alias("q2"), *TOTALS,
    )
    whole = written(_forward(tree, False, across=True), "shard-totals")
    below = linked.where("depth > 0").select(*KEY, *PARENT).join(whole, KEY)
    high = _forward(_told(heavy, _messages(below), "leaves", "saved"), True)
    return low.unionByName(high)


def end_digests(ends: DataFrame) -> DataFrame:
    """(KEY, ends_sha256) of rows (KEY, conv_id): SHA-256 of each node's ids, ascending, as decimals joined by commas.

    Ids are sorted over ranges of all rows and joined into texts there; only these texts, each of many ids, meet in
    the node's task, which hashes them one after the other.
    """
    spark = ends.sparkSession
    text_schema = "depth long, p1 long, p2 long, first long, ids string"
    texts_target = arrow_schema(spark, text_schema)
    digest_schema = "depth long, p1 long, p2 long, ends_sha256 string"
    digests_target = arrow_schema(spark, digest_schema)

    def texts(batches):
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            key, ids = None, []
            for *at, conv_id in zip(*[batch.column(c).to_pylist() for c in (*KEY, "conv_id")]):
                if at != key or len(ids) == IDS_AT_A_TIME:
                    if ids:
                        add(out, key, ids)
                    key, ids = at, []
                ids.append(conv_id)
            if ids:
                add(out, key, ids)
            yield from as_batches(dict(zip((*KEY, "first", "ids"), out)), texts_target)

    def add(out, key, ids):
        for column, value in zip(out, (*key, ids[0], ",".join(map(str, ids)))):
            column.append(value)

    def digests(batches):
        key, state = None, None
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for *at, ids in zip(*[batch.column(c).to_pylist() for c in (*KEY, "ids")]):
                if at != key:
                    if state:
                        close(out, key, state)
                    key, state = at, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield from as_batches(dict(zip((*KEY, "ends_sha256"), out)), digests_target)
        if state:
            out = [[], [], [], []]
            close(out, key, state)
            yield from as_batches(dict(zip((*KEY, "ends_sha256"), out)), digests_target)

    def close(out, key, state):
        for column, value in zip(out, (*key, state.hexdigest())):
            column.append(value)

    names = [*KEY, "conv_id"]
    joined = ends.repartitionByRange(*names).sortWithinPartitions(*names).mapInArrow(texts, text_schema)
    return joined.repartition(*KEY).sortWithinPartitions(*KEY, "first").mapInArrow(digests, digest_schema)


def trie(rows: DataFrame, convs: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256), a row a node.

    `rows` (conv_id, depth, length, h1, h2, n_bytes) are the turns, `convs` (conv_id, length) all conversations,
    those without turns too; both are written tables. A node is named by its least member and its depth. Without
    conversations there is no root and no row.
    """
    rows = written(with_prefixes(rows), "prefixes")
    nodes = written(_nodes(rows, convs), "nodes")
    found = written(totals(nodes, rows, shard, band), "totals")
    ends = rows.where("depth = length").select(*KEY, "conv_id").unionByName(
        convs.where("length = 0").select(*[F.lit(0).cast("long").alias(c) for c in KEY], "conv_id")
    )
    whole = nodes.join(found, KEY).join(end_digests(written(ends, "ends")), KEY, "left")
    whole = written(whole.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest()))), "trie")
    parents = whole.where("n_children > 0").select(
        *[F.col(k).alias(c) for k, c in zip(KEY, PARENT)], F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("of_parent")
    )
    named = join_counted(whole, parents, PARENT, "of_parent")
    return named.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
