"""Model calls with a time limit, and files written and read one by one."""

import threading
import time

import pytest
from pyspark.sql import functions as F

from formwright.plans import catalog
from formwright.sources import calls, hooks, manifest, sinks


def test_plain_calls_keep_their_order():
    caller = calls.Caller(lambda x: 10 // x)
    assert caller.all([(2,), None, (0,), (5,)]) == ([5, None, None, 2], [None, None, "integer division or modulo by zero", None])


def test_slow_calls_become_errors_and_the_others_return():
    def work(x):
        time.sleep(1.5 if x % 7 == 0 else 0.01)
        if x == 3:
            raise ValueError("bad")
        return x * 2

    start = time.monotonic()
    results, errors = calls.Caller(work, limit=0.3, at_once=4).all([(x,) for x in range(21)])
    assert time.monotonic() - start < 1.4
    assert [x for x, e in enumerate(errors) if e == "timed out after 0.3 s"] == [0, 7, 14] and errors[3] == "bad"
    assert [r for r in results if r is not None] == [x * 2 for x in range(21) if x % 7 and x != 3]


def test_calls_run_at_once_but_no_more_than_asked_for():
    now, most, lock = [0], [0], threading.Lock()

    def work(x):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.02)
        with lock:
            now[0] -= 1
        return x

    assert calls.Caller(work, at_once=5).all([(x,) for x in range(20)])[0] == list(range(20))
    assert most[0] == 5


def test_a_dead_model_is_not_called_for_ever(monkeypatch):
    monkeypatch.setattr(calls, "MOST_HANGING", 3)
    free = threading.Event()
    caller = calls.Caller(lambda x: free.wait(20), limit=0.05, at_once=1)
    results, errors = caller.all([(x,) for x in range(10)])
    assert errors[:3] == ["timed out after 0.05 s"] * 3 and set(errors[3:]) == {"not called: 3 earlier calls do not end"}
    free.set()
    time.sleep(0.3)
    # The late answers are not taken for those of later calls, and the model is called again.
    assert calls.Caller(lambda x: x, limit=1).all([(1,)]) == ([1], [None])
    assert caller.all([("a",), ("b",)])[1][1] is None


def test_calls_that_answer_cost_no_thread_each(monkeypatch):
    started, make = [0], threading.Thread

    def counted(*args, **kwargs):
        started[0] += 1
        return make(*args, **kwargs)

    monkeypatch.setattr(threading, "Thread", counted)
    results, errors = calls.Caller(lambda x: x + 1, limit=5.0, at_once=4).all([(x,) for x in range(2000)])
    assert results == list(range(1, 2001)) and not any(errors)
    assert started[0] <= 4


def test_the_next_batches_do_not_wait_for_slow_calls():
    def work(x):
        time.sleep(0.8 if x % 10 == 9 else 0)
        return x

    start = time.monotonic()
    caller = calls.Caller(work, limit=0.5, at_once=4)
    found = list(caller.batches([(x,) if x != 4 else None for x in range(first, first + 10)] for first in range(0, 80, 10)))
    assert time.monotonic() - start < 1.6  # eight calls of 0.5 s, four at once
    assert [r for results, _ in found for r in results] == [None if x % 10 == 9 or x == 4 else x for x in range(80)]
    assert [e for _, errors in found for e in errors] == ["timed out after 0.5 s" if x % 10 == 9 else None for x in range(80)]


@pytest.mark.parametrize("limit, at_once", [(0, 1), (-1, 1), (None, 0)])
def test_limits_that_make_no_sense(limit, at_once):
    with pytest.raises(ValueError):
        calls.Caller(len, limit, at_once)


def test_slow_documents_are_failures(spark):
    def make():
        def find(text):
            time.sleep(8 if text == "slow" else 0)
            return [{"entity_group": "SSN", "word": text, "score": 1.0}]

        return find

    docs = spark.createDataFrame([(k, "slow" if k == 5 else f"t{k}") for k in range(20)], "doc_id int, text string").repartition(2)
    found = hooks.model_entities(docs.withColumn("path", F.lit("p")), make, limit=2.0, at_once=3)
    rows = {r.doc_id: r for r in found.collect()}
    assert rows[5].error == "timed out after 2 s" and rows[5].entities is None
    assert all(rows[k].entities[0]["word"] == f"t{k}" for k in range(20) if k != 5)


def test_files_are_written_whole_and_read_as_images(spark, tmp_path):
    folder = str(tmp_path / "scans")
    rows = [("a.png", b"\x00\xff"), ("b.jpg", b"j"), ("c.jpeg", b"x" * 100_000), ("d.txt", b"no image"), ("e.PNG.bak", b"no")]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    assert tuple(sinks.write_files(files, folder).first()) == (5, 100_013)
    assert tuple(sinks.write_files(files, f"file://{folder}").first()) == (5, 100_013)  # again, by its address
    images = manifest.read_images(spark, folder)
    got = {r.path.rsplit("/", 1)[1]: bytes(r.content) for r in images.collect()}
    assert got == {"a.png": b"\x00\xff", "b.jpg": b"j", "c.jpeg": b"x" * 100_000}
    assert sorted(p.name for p in (tmp_path / "scans").iterdir() if not p.name.startswith(".")) == [n for n, _ in sorted(rows)]


def test_the_manifest_does_not_read_contents(spark, sf_dir):
    plan = catalog.image_files(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan.split("ReadSchema")[-1]


def test_calls_that_are_waited_for_are_made_in_few_long_tasks(spark):
    most = hooks.LONG_TASKS * spark.sparkContext.defaultParallelism
    docs = spark.range(3 * most).selectExpr("id AS doc_id", "string(id) AS text").repartition(3 * most)
    make = lambda: lambda text: []
    several = hooks.model_entities(docs, make, limit=4.0, at_once=4)
    assert several.rdd.getNumPartitions() == most
    assert several.count() == 3 * most
    assert hooks.model_entities(docs, make).rdd.getNumPartitions() == 3 * most
