"""Manifests, hooks, training data, splits, sinks."""

import json

import pytest
from pyspark.sql import functions as F

from formwright import DocumentEngine
from formwright.operators.text_assembly import with_text
from formwright.sources import hooks, manifest, sinks, synthetic, training
from formwright.vocabulary import DOCUMENT_TYPES


def test_path_list_drops_blank_lines(spark, tmp_path):
    file = tmp_path / "list.txt"
    file.write_text("a.jpg\n\n  b.png \n\t\nc d.jpeg\n")
    assert [r.path for r in manifest.read_path_list(spark, str(file)).collect()] == [
        "a.jpg", "b.png", "c d.jpeg"
    ]


def make_images(folder):
    folder.mkdir()
    for name in ("a.jpg", "b.png", "c.jpeg", "bad.jpg"):
        (folder / name).write_bytes(b"SSN 518-52-8063" if name != "bad.jpg" else b"bad")
    (folder / "d.txt").write_bytes(b"no image")
    (folder / "sub").mkdir()
    (folder / "sub" / "e.jpg").write_bytes(b"deeper")


def reader():
    def read(content):
        if content == b"bad":
            raise ValueError("unreadable")
        return [{"text": content.decode(), "confidence": 0.8, "bbox": [[0, 0], [1, 0], [1, 1], [0, 1]]}]

    return read


def test_images_are_read_and_failures_kept_apart(spark, tmp_path):
    folder = tmp_path / "images"
    make_images(folder)
    images = manifest.read_images(spark, str(folder))
    names = {r.path.rsplit("/", 1)[1] for r in images.select("path").collect()}
    assert names == {"a.jpg", "b.png", "c.jpeg", "bad.jpg"}

    keyed = images.select(F.xxhash64("path").alias("doc_id"), "path", "content")
    read = hooks.ocr_lines(keyed, reader)
    failed = hooks.failures(read).collect()
    assert [(r.path.rsplit("/", 1)[1], r.error, r.status) for r in failed] == [
        ("bad.jpg", "unreadable", "failed")
    ]
    docs = with_text(hooks.succeeded(read))
    results = DocumentEngine(as_of="2026-01-01").process(docs).collect()
    assert len(results) == 3
    for r in results:
        assert r.extracted_fields[0].value == "518-52-8063"
        assert r.extracted_fields[0].source_confidence == 0.8


def test_text_reader(spark):
    images = spark.createDataFrame([(1, "p", bytearray(b"ab\n\nc"))], "doc_id int, path string, content binary")
    got = with_text(hooks.ocr_text(images, lambda: lambda content: bytes(content).decode())).first()
    assert (got.text, got.error) == ("ab c", None)


def test_entity_hook_keeps_earlier_errors(spark):
    docs = spark.createDataFrame(
        [(1, "p", "Ann x", None), (2, "q", "boom", None), (3, "r", None, "unreadable")],
        "doc_id int, path string, text string, error string",
    )

    def model():
        def find(text):
            if text == "boom":
                raise RuntimeError("model failed")
            return [{"entity_group": "PERSON", "word": "Ann", "score": 0.9, "start": 0, "end": 3}]

        return find

    got = {r.doc_id: r for r in hooks.model_entities(docs, model).collect()}
    assert got[1].entities[0].word == "Ann" and got[1].error is None
    assert (got[2].entities, got[2].error) == (None, "model failed")
    assert (got[3].entities, got[3].error) == (None, "unreadable")


def test_provider_choice():
    providers = {"remote": reader, "local": reader}
    order = ("remote", "local")
    assert hooks.choose_provider(providers, order, {"remote": "key"})[0] == "remote"
    assert hooks.choose_provider(providers, order, {})[0] == "local"
    with pytest.raises(ValueError):
        hooks.choose_provider(providers, ("other",), {})


def test_missing_inputs(spark):
    wanted = spark.createDataFrame([("a",), ("b",)], "path string")
    found = spark.createDataFrame([("a",), ("a",)], "path string")
    got = manifest.missing_inputs(wanted, found).collect()
    assert [(r.path, r.error, r.status) for r in got] == [("b", "Image file not found: b", "failed")]


def test_labelled_texts_and_checks(spark, tmp_path):
    file = tmp_path / "train.json"
    file.write_text(json.dumps({"texts": ["a", "b", "c", "d"], "labels": [0, 8, 2.5]}, indent=2))
    samples = training.read_labelled_texts(spark, str(file))
    bad = {r.sample_id: r.problem for r in training.label_violations(samples).collect()}
    assert bad == {
        1: "labels must be 0-7",
        2: "labels must be integers",
        3: "texts and labels must have same length",
    }
    good = training.checked_labels(samples.filter("sample_id = 0")).collect()
    assert [(r.text, r.label_id) for r in good] == [("a", 0)]
    with pytest.raises(Exception, match="unusable training sample"):
        training.checked_labels(samples).collect()


def test_sequences(spark, tmp_path):
    file = tmp_path / "ner.json"
    file.write_text(json.dumps({"texts": [["a", "b"], ["c"]], "labels": [["O", "B-SSN"], ["O"]]}))
    got = training.read_sequences(spark, str(file)).collect()
    assert [(r.seq_id, r.tokens, r.tags) for r in got] == [(0, ["a", "b"], ["O", "B-SSN"]), (1, ["c"], ["O"])]
    file.write_text(json.dumps({"texts": [["a"], ["c"]], "labels": [["O"]]}))
    with pytest.raises(Exception, match="same length"):
        training.read_sequences(spark, str(file)).collect()


def test_synthetic_texts_are_balanced(spark):
    got = synthetic.create_synthetic_texts(spark, 1003).groupBy("label_id").count().collect()
    assert {r.label_id: r["count"] for r in got} == {i: 125 for i in range(len(DOCUMENT_TYPES))}


def test_synthetic_sequences_are_parallel(spark):
    df = synthetic.create_synthetic_sequences(spark, 400)
    assert df.filter("size(tokens) <> size(tags)").count() == 0
    front = df.filter("seq_id = 4").first()
    assert (front.tokens[:2], front.tags[:2]) == (["Document", ":"], ["O", "O"])


@pytest.mark.parametrize("n", [1, 4, 5, 999])
def test_split_is_exact_under_a_hot_label(spark, n):
    df = spark.range(n).select("id", F.when(F.col("id") % 3 == 0, F.col("id") % 7).otherwise(99).alias("label"))
    got = training.split(df, "id", "label").collect()
    assert len(got) == n
    for label in {r.label for r in got}:
        rows = sorted(
            (((r.id % 2147483647) * 48271) % 2147483647, r.id, r.is_train) for r in got if r.label == label
        )
        quota = len(rows) * 4 // 5
        assert [r[2] for r in rows] == [True] * quota + [False] * (len(rows) - quota)
    assert training.split(df, "id").filter("is_train").count() == n * 4 // 5


def test_result_sinks(spark, tmp_path):
    docs = spark.createDataFrame([(1, "SSN 518-52-8063", 0.9)], "doc_id int, text string, ocr_confidence double")
    sinks.write_results(DocumentEngine().process(docs), str(tmp_path / "out"))
    assert (tmp_path / "out" / "document_type=Unknown").is_dir()
    back = spark.read.json(str(tmp_path / "out")).first()
    assert back.extracted_fields[0].value == "518-52-8063"

    details = spark.createDataFrame([(0, 'say "hi", ok')], "sample_id int, text string")
    sinks.write_classification_details(details, str(tmp_path / "details"))
    read = spark.read.csv(str(tmp_path / "details"), header=True, escape='"').first()
    assert read.text == 'say "hi", ok'


def test_split_of_large_int_ids_and_text_keys(spark):
    ids = spark.range(40_000, 50_000).select(F.col("id").cast("int").alias("id"))
    assert training.split(ids, "id").filter("is_train").count() == 8_000
    names = ids.select(F.concat(F.lit("n"), F.col("id")).alias("name"))
    assert training.split(names, "name").filter("is_train").count() == 8_000


def test_line_delimited_training_sets(spark, tmp_path):
    texts, tags = tmp_path / "t.json", tmp_path / "s.json"
    texts.write_text('{"sample_id": 1, "text": "a", "label": 3}\n{"sample_id": 2, "text": "b"}\n')
    got = training.read_labelled_lines(spark, str(texts))
    assert [tuple(r) for r in got.collect()] == [(1, "a", "3"), (2, "b", None)]
    assert training.label_violations(got).count() == 1
    tags.write_text('{"seq_id": 1, "tokens": ["a"], "tags": ["O"]}\n')
    assert training.read_sequence_lines(spark, str(tags)).first().tags == ["O"]
    tags.write_text('{"seq_id": 1, "tokens": ["a"], "tags": []}\n')
    with pytest.raises(Exception, match="same length"):
        training.read_sequence_lines(spark, str(tags)).collect()


def test_hooks_leave_other_columns_alone(spark):
    rows = [(1, "a", 9007199254740993), (2, "b", None), (3, None, 5)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, big bigint")
    found = hooks.model_entities(docs, lambda: lambda text: [{"entity_group": "X", "word": text.upper(), "score": 1}])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "MapInPandas" not in plan
    got = {r.doc_id: (r.big, r.error is None) for r in found.collect()}
    assert got == {1: (9007199254740993, True), 2: (None, True), 3: (5, False)}


def test_provider_that_cannot_be_made_falls_back():
    def broken(key):
        raise RuntimeError(f"no service for {key}")

    providers = {"remote": broken, "local": lambda: "reader"}
    name, made, failed = hooks.make_first_provider(providers, ("remote", "local"), {"remote": "k"})
    assert (name, made, failed) == ("local", "reader", {"remote": "no service for k"})
