"""A Merkle manifest of a dataset, its trees stored in van Emde Boas layout.

Each group of rows (a language) has a binary tree over its leaves, and the groups' roots have one more tree above
them. A tree is cut into blocks: aligned subtrees of at most `HEIGHT` levels above their bottom row. The roots of
a tier of blocks are the bottom row of the next tier, so construction recurses over block roots until one node is
left, and paths are read downwards the same way. Tiers are few: each divides the nodes by 2**HEIGHT.

Within a block the nodes lie in one binary value in van Emde Boas order: the upper half of the levels first, then
each subtree of the lower half, all of them laid out in the same way. `addresses` computes the places by that
recursion, for building and for finding siblings alike; nothing is searched and no pointers are kept.

Places of leaves are counted over sorted ranges of all rows (`numbered`), so no group is sorted in one task. A
block has at most 2**HEIGHT rows, whatever the size of its group.

Fixed values: SHA-256 over lowercase hexadecimal digests, as text.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import map_rows, numbered, written

HEIGHT = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Bytes of a digest as stored.
WIDTH = 32
#: Blocks whose rows are held as Python objects at once.
BLOCKS_AT_A_TIME = 4


# ---- layout -------------------------------------------------------------------------------------


def _address(level: int, place: int, levels: int) -> int:
    """Where node `place` of row `level` (0 is the root) lies in a tree of `levels` rows."""
    start = 0
    while levels > 1:
        upper = levels // 2
        lower = levels - upper
        if level < upper:
            levels = upper
            continue
        level -= upper
        subtree, place = place >> level, place & ((1 << level) - 1)
        start += (1 << upper) - 1 + subtree * ((1 << lower) - 1)
        levels = lower
    return start


@lru_cache(maxsize=64)
def addresses(levels: int) -> tuple[np.ndarray, ...]:
    """For each row of a tree of `levels` rows, root first, the places of its nodes in the layout."""
    return tuple(
        np.array([_address(level, place, levels) for place in range(1 << level)], np.int64) for level in range(levels)
    )


class Block:
    """An aligned subtree: `height` levels above a bottom row whose first `count` nodes exist."""

    def __init__(self, height: int, count: int, nodes: bytes | bytearray | None = None):
        self.height = height
        self.count = count
        self.rows = addresses(height + 1)
        self.nodes = bytearray(WIDTH * ((2 << height) - 1)) if nodes is None else nodes

    @classmethod
    def build(cls, height: int, bottom: list[str]) -> Block:
        block = cls(height, len(bottom))
        row = bottom
        for level in range(height, -1, -1):
            for address, digest in zip(block.rows[level].tolist(), row):
                block.nodes[address * WIDTH : (address + 1) * WIDTH] = bytes.fromhex(digest)
            if level:
                row = [digest_of("".join(row[i : i + 2])) for i in range(0, len(row), 2)]
        return block

    def node(self, level: int, place: int) -> str:
        at = int(self.rows[level][place]) * WIDTH
        return bytes(self.nodes[at : at + WIDTH]).hex()

    def root(self) -> str:
        return self.node(0, 0)

    def steps(self, place: int) -> str:
        """The way up from a node of the bottom row: `<` or `>` and the sibling on that side, `.` for none."""
        out = []
        count = self.count
        for level in range(self.height, 0, -1):
            sibling = place ^ 1
            if sibling >= count:
                out.append(".")
            else:
                out.append(("<" if sibling < place else ">") + self.node(level, sibling))
            place >>= 1
            count = (count + 1) >> 1
        return "".join(out)


def digest_of(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def siblings(steps: str) -> str:
    """The siblings of a way up, in order, without sides."""
    return steps.replace("<", "").replace(">", "").replace(".", "")


def folded(leaf: str, steps: str) -> str:
    """The root that a leaf and its way up give."""
    at = 0
    while at < len(steps):
        side, other = steps[at], steps[at + 1 : at + 65]
        leaf = digest_of(leaf if side == "." else other + leaf if side == "<" else leaf + other)
        at += 1 if side == "." else 65
    return leaf


# ---- leaves -------------------------------------------------------------------------------------


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values in order: `-` for null, else the length in UTF-8 bytes, `:`, and the value."""
    parts = [
        F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
        for v in (value.cast("string") for value in values)
    ]
    return F.sha2(F.concat(*parts), 256)


# ---- trees --------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Forest:
    """One tree a group: the tiers' tables (g, block, n_below, height, n, nodes, root, rows), and the roots (g, root)."""

    tiers: list[DataFrame]
    roots: DataFrame
    height: int


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    """(g, block, n_below, height, n, nodes, root, rows) of `nodes` (g, i, n_below, node, ...).

    `n_below` is how many nodes the group has in this tier; it says how far the tree goes on above.
    """
    others = [c for c in nodes.columns if c not in ("g", "n_below")]
    gathered = nodes.groupBy("g", F.shiftright("i", height).alias("block"), "n_below").agg(
        F.sort_array(F.collect_list(F.struct("i", *[c for c in others if c != "i"]))).alias("rows")
    )
    levels = F.when(F.col("n_below") > 1, F.length(F.bin(F.col("n_below") - 1))).otherwise(0)
    shaped = gathered.withColumn("height", F.least(levels, F.lit(height)))
    digests = F.transform("rows", lambda r: r["node"])
    keys = shaped.select("g", "block", "n_below", "height", "rows", digests.alias("bottom"))
    rows_type = shaped.schema["rows"].dataType.simpleString()

    def rows(columns):
        out = {k: columns[k] for k in ("g", "block", "n_below", "height", "rows")}
        built = [Block.build(h, bottom) for h, bottom in zip(columns["height"], columns["bottom"])]
        out["n"] = [b.count for b in built]
        out["nodes"] = [bytes(b.nodes) for b in built]
        out["root"] = [b.root() for b in built]
        return out

    schema = f"g string, block long, n_below long, height int, n int, nodes binary, root string, rows {rows_type}"
    return map_rows(keys, rows, schema, at_a_time=BLOCKS_AT_A_TIME)


def forest(nodes: DataFrame, height: int = HEIGHT) -> Forest:
    """The trees over `nodes` (g, i, n_below, node, ...): `i` counts a group's nodes from 0, `n_below` is their number."""
    tiers, done = [], []
    while True:
        tier = written(_blocks(nodes, height), "merkle-tier")
        tiers.append(tier)
        done.append(tier.where(F.col("n_below") <= 1 << height).select("g", "root"))
        higher = tier.where(F.col("n_below") > 1 << height)
        if higher.isEmpty():
            break
        nodes = higher.select(
            "g",
            F.col("block").alias("i"),
            F.expr(f"(n_below + {(1 << height) - 1}) div {1 << height}").alias("n_below"),
            F.col("root").alias("node"),
        )
    roots = done[0]
    for more in done[1:]:
        roots = roots.unionByName(more)
    return Forest(tiers, roots, height)


def _paths(tier: DataFrame, above: DataFrame, full: int) -> DataFrame:
    """(g, i, up, subroot, root): the ways from the nodes of a tier's bottom row to the top.

    `above` has (g, block, up, subroot, root) for the tier's blocks, `full` is the height of a whole one.
    """

    def rows(columns):
        out = {name: [] for name in ("g", "i", "up", "subroot", "root")}
        for g, block, height, n, nodes, up, subroot, root in zip(*[columns[c] for c in names]):
            tree = Block(height, n, nodes)
            out["g"] += [g] * n
            out["i"] += range(block << full, (block << full) + n)
            out["up"] += [tree.steps(place) + up for place in range(n)]
            out["subroot"] += [subroot] * n
            out["root"] += [root] * n
        return out

    names = ("g", "block", "height", "n", "nodes", "up", "subroot", "root")
    joined = tier.drop("root", "rows", "n_below").join(above, ["g", "block"]).select(*names)
    schema = "g string, i long, up string, subroot string, root string"
    return map_rows(joined, rows, schema, at_a_time=BLOCKS_AT_A_TIME)


def _down(trees: Forest, above: DataFrame) -> DataFrame:
    """From what is above the highest blocks of each group (g, up, subroot, root) to what is above the lowest ones.

    A group's highest block is its only one in that tier; groups have different numbers of tiers.
    """
    known = None
    for tier in reversed(trees.tiers):
        lone = tier.where(F.col("n_below") <= 1 << trees.height)
        tops = lone.select("g", "block").join(above, "g")
        known = tops if known is None else tops.unionByName(known)
        known = written(known.select("g", "block", "up", "subroot", "root"), "merkle-above")
        if tier is not trees.tiers[0]:
            known = _paths(tier, known, trees.height).withColumnRenamed("i", "block")
    return known


def proofs(
    docs: DataFrame,
    fields: tuple[str, ...] = FIELDS,
    group: str = "lang",
    order: str = "doc_id",
    changed: dict[str, Column] | None = None,
    height: int = HEIGHT,
) -> DataFrame:
    """(order, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of `docs`.

    Leaves are digests of `fields`, a group's leaves ascend by `order` (null first, equal ones by their digest), and
    groups ascend by name (null first, else bytewise). `changed` gives other values for some fields: the root is then
    folded from that leaf and the siblings of the original, and `verified` tells whether it is still the root.
    Repeated rows are leaves of their own; null and empty texts have different leaves. Further columns are not read.
    An empty table has no rows, and so no root.
    """
    before = [F.col(c) for c in fields]
    after = [(changed or {}).get(c, F.col(c)) for c in fields]
    g = F.when(F.col(group).isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), F.col(group).cast("string")))
    leaf, other = leaf_digest(*before), leaf_digest(*after)
    leaves = written(docs.select(g.alias("g"), F.col(order).alias("id"), leaf.alias("node"), other.alias("other")), "leaves")
    found = forest(numbered(leaves, ["g"], ["id", "node"], "i", "n_below"), height)
    subroots = written(found.roots, "subroots")
    top = forest(
        numbered(subroots.select(F.lit("").alias("g"), F.col("g").alias("name"), F.col("root").alias("node")), ["g"], ["name"], "i", "n_below"),
        height,
    )
    root = top.roots.select("g", F.lit("").alias("up"), F.col("root").alias("subroot"), "root")
    above_groups = _paths(top.tiers[0], _down(top, root), height)
    named = top.tiers[0].select("g", F.inline("rows")).select("g", "i", F.col("name"), F.col("node").alias("own"))
    above = named.join(above_groups, ["g", "i"]).select(
        F.col("name").alias("g"), "up", F.col("own").alias("subroot"), "root"
    )
    lowest = found.tiers[0].drop("root").join(_down(found, above), ["g", "block"])

    def rows(columns):
        out = {c: [] for c in ("id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")}
        for height, n, nodes, leaves, up, subroot, root in zip(*[columns[c] for c in names]):
            tree = Block(height, n, nodes)
            for place, leaf in enumerate(leaves):
                steps = tree.steps(place) + up
                again = folded(leaf["other"], steps)
                out["id"].append(leaf["id"])
                out["leaf"].append(leaf["node"])
                out["proof_sha256"].append(digest_of(siblings(steps)))
                out["folded_root"].append(again)
                out["verified"].append(again == root)
            out["subroot"] += [subroot] * n
            out["root"] += [root] * n
        return out

    names = ("height", "n", "nodes", "rows", "up", "subroot", "root")
    kind = docs.schema[order].dataType.simpleString()
    result = map_rows(
        lowest.select(*names),
        rows,
        f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean",
        at_a_time=BLOCKS_AT_A_TIME,
    )
    return result.withColumnRenamed("id", order)


def manifest(docs: DataFrame, path: str, **how) -> None:
    """Writes the proofs of `docs` to the new folder `path`, see `proofs`."""
    proofs(docs, **how).write.parquet(path)
