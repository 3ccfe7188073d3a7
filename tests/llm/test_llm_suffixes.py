"""External induced sorting against plain sorting, and removal of bytes against a plain search."""

import tracemalloc

import numpy as np
import pytest

from formwright.llm import induced, suffixes


def plain_order(text, cap):
    order = sorted(range(len(text) - 1), key=lambda i: text[i : i + cap])
    return order, [0] + [common(text[a : a + cap], text[b : b + cap]) for a, b in zip(order, order[1:])]


def common(x, y):
    n = 0
    while n < min(len(x), len(y)) and x[n] == y[n]:
        n += 1
    return n


def texts():
    rng = np.random.default_rng(3)
    yield [5]
    yield [1, 1, 1, 1, 1, 1]
    yield [3, 2, 1]
    yield [1, 2, 3]
    yield list(rng.integers(1, 3, 400))
    yield list(rng.integers(1, 5, 3000))
    yield list(rng.integers(1, 2000, 3000))
    part = list(rng.integers(1, 5, 300))
    yield part + part + [9] + part[50:] + part
    yield [2, 1] * 500
    yield [1] * 90 + [2] + [1] * 90 + [3, 1]
    yield list(b"the cat and the hat sat on the mat; the cat and the hat ran. " * 20)


@pytest.mark.parametrize("limit", [1 << 22, 40, 3])
@pytest.mark.parametrize("cap", [50, 7])
def test_suffix_order_and_common_prefixes(limit, cap, monkeypatch):
    monkeypatch.setattr(induced, "BLOCK", 16 if limit < 100 else 1 << 16)
    for text in texts():
        text = [int(x) for x in text] + [0]
        blocks = list(induced.sorted_suffixes(np.array(text, np.int64), cap, limit))
        place = np.concatenate([p for p, _ in blocks]).tolist()
        prefix = np.concatenate([c for _, c in blocks]).tolist()
        order, expected = plain_order(text, cap)
        assert sorted(place) == list(range(len(text) - 1))
        assert [text[i : i + cap] for i in place] == [text[i : i + cap] for i in order]
        assert prefix == expected


SCHEMA = "doc_id long, text string, k1 string, k2 int, intervals int, v long"


def plain_intervals(rows, width):
    first = {}
    for doc, text in rows:
        data = (text or "").encode()
        if doc is not None:
            for i in range(len(data) - width + 1):
                w = data[i : i + width]
                first[w] = min(first.get(w, doc), doc)
    out = []
    for doc, text in rows:
        data = (text or "").encode()
        gone = [False] * len(data)
        if doc is not None:
            for i in range(len(data) - width + 1):
                if first[data[i : i + width]] < doc:
                    gone[i : i + width] = [True] * width
        edges = np.flatnonzero(np.diff([False, *gone, False])).tolist()
        out.append((doc, text, list(zip(edges[::2], edges[1::2]))))
    return sorted(map(repr, out))


def documents():
    rng = np.random.default_rng(6)
    words = ["tax", "wages", "été", "漢字", "form", "the", "a", "withheld", "12", "x"]

    def prose(n):
        return " ".join(rng.choice(words, n))

    passage, copy = prose(40), prose(120)
    rows = [(k, f"{prose(15)} {passage} {prose(15)}") for k in range(40)]
    rows += [(100 + k, copy) for k in range(20)] + [(200 + k, copy[: 30 * k] + "#" + copy[30 * k :]) for k in range(12)]
    rows += [(300, None), (301, ""), (302, "short"), (None, copy), (None, copy), (100, copy), (7, prose(60)), (7, passage)]
    rows += [(400, "x" * 3000), (401, "x" * 200), (402, "x" * 49), (403, "x" * 50), (404, prose(9000)), (-5, passage)]
    return rows


@pytest.mark.parametrize("shard_bytes", [1 << 22, 2000])
def test_intervals_against_plain_search(spark, monkeypatch, shard_bytes):
    rows = documents()
    df = spark.createDataFrame([(*r, "k", 1, 2, 3) for r in rows], SCHEMA)
    monkeypatch.setattr(suffixes, "PIECE", 700)
    found = suffixes.with_earlier(df, shard_bytes=shard_bytes)
    assert found.columns == [*df.columns, "_intervals"]
    got = sorted(repr((r.doc_id, r.text, [(p["first"], p["end"]) for p in r["_intervals"]])) for r in found.collect())
    assert got == plain_intervals(rows, suffixes.WIDTH)


@pytest.mark.parametrize("limit", [induced.IN_MEMORY, 200, 20])
def test_shards_larger_than_memory(limit):
    rng = np.random.default_rng(1)
    bodies = [bytes(rng.integers(97, 99, n).astype(np.uint8)) for n in rng.integers(8, 40, 60)]
    bodies += bodies[:20] + [b"ab" * 20]
    docs = rng.integers(0, 30, len(bodies))
    lengths = np.array([len(b) for b in bodies])
    blocks = suffixes.earlier_in_shard(np.frombuffer(b"".join(bodies), np.uint8), lengths, docs, docs, 8, limit)
    got = {(int(run), i): int(m) for block in blocks for run, first, end, m in zip(*block) for i in range(first, end)}
    first = {}
    for body, doc in zip(bodies, docs.tolist()):
        for i in range(len(body) - 7):
            first[body[i : i + 8]] = min(first.get(body[i : i + 8], doc), doc)
    expected = {
        (k, i): first[body[i : i + 8]]
        for k, body in enumerate(bodies) for i in range(len(body) - 7) if first[body[i : i + 8]] < docs[k]
    }
    assert got == expected


def test_memory_of_a_shard():
    """A shard of average size is sorted in each task of an executor, beside its heap."""
    rng = np.random.default_rng(4)
    words = rng.integers(97, 123, (3000, 6)).astype(np.uint8)
    data = words[rng.integers(0, 3000, suffixes.SHARD_BYTES // 6)].ravel()
    lengths = np.full(len(data) // 80, 80)
    docs = rng.integers(0, 5000, len(lengths))
    tracemalloc.start()
    for _ in suffixes.earlier_in_shard(data[: 80 * len(lengths)], lengths, docs, docs + 1, suffixes.WIDTH):
        pass
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 200 << 20


def test_no_documents(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert suffixes.with_earlier(none).count() == 0
    lone = spark.createDataFrame([(1, None, "k", 1, 2, 3), (None, "y" * 200, "k", 1, 2, 3)], SCHEMA)
    assert [r["_intervals"] for r in suffixes.with_earlier(lone).collect()] == [[], []]


def test_kept_bytes():
    assert suffixes.kept_bytes(b"0123456789", [{"first": 0, "end": 2}, {"first": 5, "end": 9}]) == b"2349"
    assert suffixes.kept_bytes(b"", []) == b""


def repeating_texts(spark, n):
    rng = np.random.default_rng(8)
    once = [bytes(rng.integers(97, 123, 400).astype(np.uint8)).decode() for _ in range(n)]
    return spark.createDataFrame([(t,) for t in [*once, *once[::2]]], "text string").select(suffixes.text_bytes("text").alias("text"))


def test_filter_of_anchors_grows_with_them(spark, monkeypatch):
    """One that is full lets the runs of every text pass, so that all are shuffled and kept."""
    monkeypatch.setattr(suffixes, "BITS", 15)
    source = repeating_texts(spark, 1500)
    known = suffixes.written(suffixes.anchors(source, 50, 20), "anchors")
    (again, bits), mixed, hot = suffixes.filters(known)
    assert len(again) == 1 << bits >> 3
    assert np.unpackbits(np.frombuffer(again, np.uint8)).mean() < 1 / 4
    keyed = source.selectExpr("1L AS k1", "1L AS k2", "text")
    every = suffixes.runs(keyed, (b"\xff" * len(again), bits), mixed, hot, 50, 20).count()
    assert 2 / 3 * every <= suffixes.runs(keyed, (again, bits), mixed, hot, 50, 20).count() < 0.8 * every


def test_shuffled_files_are_removed_when_a_table_is_written(spark):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = manager.getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    before = shuffled()
    suffixes.earlier_intervals(spark.createDataFrame([(k, "y" * 60 + str(k % 3) * 60) for k in range(50)], "doc_id long, text string"))
    left = [name for name in shuffled() - before if name.startswith("shuffle_")]
    assert not left
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "false") == "false"
