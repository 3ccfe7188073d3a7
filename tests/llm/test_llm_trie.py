"""The conversation trie against a plain one, at shard sizes that cut it in every way."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from formwright.llm import trie


def plain(rows):
    """Nodes as dictionaries over whole prefixes."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{role}\0{text}".encode()).hexdigest()
            own[conv].append((turn is not None, turn or 0, tie, (role, text)))
    own = {c: [t[-1] for t in sorted(turns)] for c, turns in own.items()}
    members, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 9
        base = c - int(abs(c) % 5) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
        ends[tuple(turns)].append(c)
    children = defaultdict(list)
    for p in members:
        if p:
            children[p[:-1]].append(p)
    leaves, saved = defaultdict(int), defaultdict(int)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] += not children[p]
        saved[p] += (len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0
        if p:
            leaves[p[:-1]] += leaves[p]
            saved[p[:-1]] += saved[p]
    return sorted(
        repr((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(children[p]), leaves[p], saved[p],
              hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
        for p, m in members.items()
    )


def run(df, **how):
    checksum = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    turns = trie.turns_of(df)
    rows, convs = trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, F.pmod(checksum, F.lit(9)), most=8)
    return trie.trie(rows, convs, **how)


SCHEMA = "conv_id long, turn int, role string, text string, depth string, n string, h1 int"


def conversations():
    rng = random.Random(4)
    texts = ["a", "bé", "", None, "c" * 50_000]
    rows = [(c, t, rng.choice(["user", "assistant", None]), rng.choice(texts)) for c in range(-6, 60) for t in range(rng.randrange(14))]
    # One long conversation, a very common first turn, ties, null turns, repeated rows, no id.
    rows += [(500, t, "user", f"x{t % 7}") for t in range(300)] + [(501, t, "user", f"x{t % 7}") for t in range(300)]
    rows += [(c, 0, "system", "same") for c in range(1000, 1080)] + [(c, 1, "user", str(c % 9)) for c in range(1000, 1080)]
    rows += [(7000, None, "user", "n"), (7000, 1, "user", "b"), (7000, 1, "user", "a"), (7000, 1, "user", "a"), (None, 1, "user", "z")]
    return rows


@pytest.mark.parametrize("shard, band", [(1 << 16, 1 << 10), (40, 16), (1, 1), (7, 5)])
def test_against_plain_trie(spark, shard, band):
    rows = conversations()
    df = spark.createDataFrame([(*r, "d", "n", 1) for r in rows], SCHEMA)
    found = run(df, shard=shard, band=band)
    assert sorted(repr(tuple(r)) for r in found.collect()) == plain(rows)


def test_no_conversations(spark):
    assert run(spark.createDataFrame([], SCHEMA)).count() == 0
    assert run(spark.createDataFrame([(None, 1, "user", "a", "", "", 1)], SCHEMA)).count() == 0


def test_queue_spills_and_keeps_its_order():
    rng = random.Random(2)
    items = [(rng.randrange(50), rng.randrange(5), k) for k in range(5000)]
    queue = trie.SpillingQueue(limit=20)
    for item in items:
        queue.push(item)
    for key in sorted({i[:2] for i in items}):
        assert sorted(queue.take(key)) == sorted(i for i in items if i[:2] == key)
    assert len(queue) == 0


def test_time_forward_spills():
    """A comb of 2,000 nodes through a queue that holds four messages."""
    rows = [((0, 0, 0), d, x, 0, d - 1, 0, 0, 0, 0, 1) for d in range(1000, 0, -1) for x in (0, 1)]
    rows.append(((0, 0, 0), 0, 0, 0, -1, 0, 0, 0, 0, 1))
    got = list(trie.time_forward(rows, True, limit=4))
    assert got == list(trie.time_forward(rows, True)) and got[-1] == (0, 0, 0, 2, 1001, 2001)


def test_ids_in_order_over_many_texts(spark, monkeypatch):
    monkeypatch.setattr(trie, "IDS_AT_A_TIME", 7)
    ends = spark.range(3000).select(F.lit(1).cast("long").alias("depth"), (F.col("id") % 2).alias("p1"), F.lit(0).cast("long").alias("p2"), F.col("id").alias("conv_id"))
    got = {r.p1: r.ends_sha256 for r in trie.end_digests(ends.repartition(5)).collect()}
    assert got == {k: hashlib.sha256(",".join(str(i) for i in range(k, 3000, 2)).encode()).hexdigest() for k in (0, 1)}
