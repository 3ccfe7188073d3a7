"""Arrays of one JSON object read in blocks, against a reader of whole files."""

import json
import random

import pytest
from pyspark.sql import functions as F

from formwright.sources import json_objects as jo
from formwright.sources import training

ODD = ['plain', '', 'a "quoted" word', 'back\\slash', 'ends in \\', '[{,:}]', 'line\nbreak\ttab', 'Zoë 漢字 😀', '\\"', '"', '\\\\"']


def odd_objects():
    rng = random.Random(5)
    yield {"texts": ODD, "labels": [str(i) for i in range(len(ODD))]}
    yield {"na\"me: [": ["x"], "texts": [], "version": 3, "meta": {"texts": ["no"], "deep": {"a": [1, [2]]}}, "labels": [1, None, {"a": ["b,"]}]}
    yield {}
    for _ in range(20):
        yield {f"k{j}": [rng.choice([rng.choice(ODD) * rng.randint(0, 4), [rng.choice(ODD)], 7, {"z": rng.choice(ODD)}])
                         for _ in range(rng.randint(0, 9))] for j in range(rng.randint(0, 3))}


def in_blocks(path, size):
    file = jo.Bytes(path)
    state, found = jo.Start(), []
    for begin in range(0, file.size, size):
        end = min(begin + size, file.size)
        found += jo.elements(file, begin, end, state)
        change = jo.summary(file.read(begin, end), begin, state.inside, file.escaped(begin))
        state = jo.after(state, change)
    assert state.depth == 0 and not state.inside
    file.close()
    return [(name, pos, json.loads(value)) for name, pos, value in found]


@pytest.mark.parametrize("size", [1, 2, 3, 7, 16, 61, 1000])
def test_blocks_of_any_size_give_all_elements(tmp_path, size):
    for i, (whole, form) in enumerate((o, f) for o in odd_objects() for f in ({}, {"indent": 2}, {"ensure_ascii": False})):
        file = tmp_path / f"{i}.json"
        file.write_text(json.dumps(whole, **form), encoding="utf-8")
        expected = [(k, n, v) for k, values in whole.items() if isinstance(values, list) for n, v in enumerate(values)]
        assert in_blocks(str(file), size) == expected


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    texts = [f"{ODD[i % len(ODD)]} {i} " + "word " * (i % 50) for i in range(40_000)]
    whole = {"texts": texts, "labels": [str(i % 8) for i in range(39_999)]}
    file = tmp_path / "large.json"
    file.write_text(json.dumps(whole))
    arrays = jo.read_arrays(spark, str(file), 1 << 18)
    assert arrays.select(F.spark_partition_id().alias("p")).distinct().count() > 4
    read = training.read_labelled_objects(spark, str(file), 1 << 18).drop("path")
    plain = training.read_labelled_texts(spark, str(file)).select(F.col("sample_id").cast("long"), "text", "label")
    assert read.count() == 40_000
    assert read.exceptAll(plain).count() == 0


def test_sequences(spark, tmp_path):
    file = tmp_path / "sequences.json"
    file.write_text(json.dumps({"texts": [["a", "b,"], [], ["]"]], "labels": [["O", "B-SSN"], [], ["O"]]}))
    rows = training.read_sequence_objects(spark, str(file), 5).orderBy("seq_id").collect()
    assert [(r.tokens, r.tags) for r in rows] == [(["a", "b,"], ["O", "B-SSN"]), ([], []), (["]"], ["O"])]


def test_empty_files_and_objects_give_no_rows(spark, tmp_path):
    (tmp_path / "a.json").write_text("")
    (tmp_path / "b.json").write_text("{}")
    assert jo.read_arrays(spark, str(tmp_path)).count() == 0
