"""Classifier, token spans, and evaluation measures."""

import hashlib
import math

import pytest
from pyspark.sql import functions as F

from formwright.functions.candidates import CANDIDATES
from formwright.operators import evaluate as ev
from formwright.operators import tokens as tok
from formwright.operators.classify import SLOTS, KeywordClassifier, probability_map, type_name
from formwright.sources.synthetic import create_synthetic_texts
from formwright.vocabulary import BIO_TAGS, DOCUMENT_TYPES, FIELD_TYPES


@pytest.fixture(scope="module")
def model(spark):
    return KeywordClassifier.fit(create_synthetic_texts(spark, 800))


TEXTS = [
    "Wage and Tax Statement 2023", "Form 1099-R Distributions From Pensions", "Qualified dividends",
    "Monthly bank statement", "zzz unknown words", "", None, "tax " * 2000 + "Restaurant receipt meal",
]


def test_classes(spark, model):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id int, text string")
    for limit in (None, 3):
        a = {
            r.doc_id: (r.document_type, round(r.classification_confidence, 9))
            for r in model.classify(docs, limit).collect()
        }
        assert len(a) == len(TEXTS)
        assert a[0][0] == "W-2" and a[1][0] == "1099-R" and a[3][0] == "Bank Statement"
        assert a[6] == ("Unknown", 0.0)
        assert a[4] == a[5] == ("W-2", 0.125)  # equal priors: the first class


def test_rows_of_one_id_are_classified_apart(spark, model):
    docs = spark.createDataFrame([(1, TEXTS[1]), (1, TEXTS[3])], "doc_id int, text string")
    assert [r.document_type for r in model.classify(docs).collect()] == ["1099-R", "Bank Statement"]


def slot(token):
    return int(hashlib.md5(token.encode()).hexdigest()[:4], 16) % SLOTS


def test_large_vocabularies_stay_in_the_row(spark):
    """30,000 tokens in 16,384 slots: one lookup, no join, no exchange."""
    samples = spark.range(3000).selectExpr(
        "array_join(transform(sequence(1, 10), i -> concat('t', id * 10 + i)), ' ') AS text", "int(id % 8) AS label_id"
    )
    large = KeywordClassifier.fit(samples)
    assert 10_000 < large.vocabulary_size <= SLOTS
    docs = samples.selectExpr("1 AS doc_id", "text")
    plan = large.classify(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Exchange" not in plan and "Broadcast" not in plan
    got = large.classify(samples.selectExpr("label_id", "text")).filter("document_type <> 'Unknown'")
    right = got.filter(F.col("document_type") == type_name(F.col("label_id"))).count()
    assert right > 2700


def test_probabilities_sum_to_one(spark, model):
    docs = spark.createDataFrame([(0, TEXTS[1])], "doc_id int, text string")
    got = model.with_probabilities(docs).select(probability_map(F.col("probabilities"))).first()[0]
    assert set(got) == set(DOCUMENT_TYPES)
    assert sum(got.values()) == pytest.approx(1)


def test_model_against_a_loop(spark):
    samples = [("a b b", 0), ("b c", 1), ("C, c!", 1)]
    small = KeywordClassifier.fit(spark.createDataFrame(samples, "text string, label_id int"))
    got = {(r.slot, r.label_id): r.weight for r in small.weight_rows().collect()}
    assert len(got) == 3 * len(DOCUMENT_TYPES)
    assert got[slot("b"), 0] == pytest.approx(math.log(3 / 6))
    assert got[slot("c"), 1] == pytest.approx(math.log(4 / 7))
    assert got[slot("c"), 0] == pytest.approx(math.log(1 / 6))
    assert small.priors[1] == pytest.approx(math.log(3 / 11))


def test_save_and_load(spark, model, tmp_path):
    model.save(str(tmp_path / "model"))
    loaded = KeywordClassifier.load(spark, str(tmp_path / "model"))
    assert loaded.info() == model.info()
    assert sorted(loaded.weight_rows().collect()) == sorted(model.weight_rows().collect())
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        loaded.save(str(tmp_path / "model"))


def test_bio_spans(spark):
    tags = "O B-SSN I-SSN I-DATE I-DATE B-DATE O I-EMAIL B-EMAIL I-SSN".split()
    tokens = [f"t{i}" for i in range(len(tags))]
    scores = [i / 10 for i in range(len(tags))]
    df = spark.createDataFrame([(1, tokens, tags, scores), (2, ["x"], ["O"], [0.5]), (3, [], [], [])],
                               "seq_id int, tokens array<string>, tags array<string>, scores array<double>")
    rows = tok.span_rows(df).collect()
    assert [(r.field_name, r.value, round(r.score, 6), r.start, r.end) for r in rows] == [
        ("SSN", "t1 t2", 0.15, 1, 3),
        ("DATE", "t3 t4", 0.35, 3, 5),
        ("DATE", "t5", 0.5, 5, 6),
        ("EMAIL", "t7", 0.7, 7, 8),
        ("EMAIL", "t8", 0.8, 8, 9),
        ("SSN", "t9", 0.9, 9, 10),
    ]


def test_encoded_tags(spark):
    assert len(BIO_TAGS) == 33 and BIO_TAGS[:3] == ("O", "B-SSN", "I-SSN")
    df = spark.createDataFrame([(["a", "b", "c"], ["B-SSN", "B-XYZ"])], "t array<string>, g array<string>")
    assert df.select(tok.encoded_tags(F.col("t"), F.col("g"))).first()[0] == [1, 0, -100]


def test_unknown_predictions_and_absent_classes(spark):
    rows = [("W-2", "W-2"), ("W-2", "Unknown"), ("1040", "W-2"), ("1040", "1040")]
    confusion = ev.confusion_counts(spark.createDataFrame(rows, "true_label string, pred_label string"))
    m = ev.classification_metrics(confusion).first()
    assert (m.accuracy, m.total_samples) == (0.5, 4)
    assert m.precision == pytest.approx((0.5 * 2 + 1.0 * 2) / 4)
    classes = {r.label: r for r in ev.per_class_metrics(confusion).collect()}
    assert set(classes) == set(DOCUMENT_TYPES)
    assert (classes["Receipt"].precision, classes["Receipt"].support) == (0.0, 0)
    assert ev.confusion_matrix(confusion).count() == 64
    report = {r.label: r for r in ev.classification_report(confusion).collect()}
    assert len(report) == 11
    assert report["accuracy"].f1 == 0.5 and report["macro avg"].recall == pytest.approx(1.0 / 8)


def test_entity_measures(spark):
    key = "doc_id int, field_name string, value string, start int, end int"
    predicted = spark.createDataFrame(
        [(1, "SSN", "a", 0, 1), (1, "SSN", "a", 0, 1), (2, "DATE", "b", 0, 1), (3, "SSN", "c", 0, 1)], key
    )
    truth = spark.createDataFrame([(1, "SSN", "a", 0, 1), (2, "DATE", "b", 0, 2), (3, "SSN", "c", 0, 1),
                                   (3, "DATE", "d", 4, 5)], key)
    matches = ev.match_entities(predicted, truth)
    assert matches.count() == 5
    total = ev.ner_metrics(matches).first()
    assert (total.true_positives, total.false_positives, total.false_negatives) == (2, 1, 2)
    assert total.precision == pytest.approx(2 / 3) and total.recall == pytest.approx(0.5)
    types = {r.field_name: r for r in ev.ner_per_type(matches).collect()}
    assert set(types) == set(FIELD_TYPES) and types["SSN"].f1 == 1.0 and types["EMAIL"].f1 == 0.0
    docs = spark.createDataFrame([(i,) for i in (1, 2, 3, 4)], "doc_id int")
    shares = ev.ner_doc_match(docs, matches).first()
    assert shares.exact_match_accuracy == 0.5  # 1, and 4 without entities
    assert shares.partial_match_accuracy == 0.5
    assert ev.true_positives(matches).count() == 2


def test_matches_within_the_row_equal_those_of_tables(spark):
    fields = "array<struct<field_name: string, value: string, start: int, end: int>>"
    rows = [
        (1, [("SSN", "a", 0, 1), ("SSN", "a", 0, 1), ("DATE", "b", None, None)], [("SSN", "a", 0, 1), ("DATE", "b", 0, 1)]),
        (2, [("DATE", "b", 0, 1)], [("DATE", "b", 0, 2)]), (3, [], [("SSN", "c", 0, 1)]), (4, None, None), (5, [("EMAIL", "x", 3, 4)], None),
    ]
    docs = spark.createDataFrame(rows, f"doc_id int, ranked {fields}, true_entities {fields}")
    by_table = ev.match_entities(ev.entity_rows(docs, "ranked"), ev.entity_rows(docs, "true_entities"))
    found = ev.with_matches(docs)
    in_row = ev.matched_rows(found).select(*by_table.columns)
    assert sorted(in_row.collect()) == sorted(by_table.collect())
    sizes = ev.match_sizes(found)
    assert ev.ner_metrics_of_sizes(sizes).first() == ev.ner_metrics(by_table).first()
    assert ev.ner_doc_match_of_sizes(sizes).first() == ev.ner_doc_match(docs.select("doc_id"), by_table).first()


def test_missing_offsets_default(spark):
    df = spark.createDataFrame([(1, [(0, "SSN", "abc", 0.9, None, None, False)])], f"doc_id int, e {CANDIDATES}")
    assert ev.entity_rows(df, "e").first()[2:] == ("abc", 0, 3)


def test_run_metrics_and_business_value(spark):
    rows = [(12.0, None, 0.5, 5, 1), (4.0, 1, 0.7, 35, 9)]
    df = spark.createDataFrame(
        rows,
        "processing_time_seconds double, user_corrections int, average_confidence double, n_fields int, n_high int",
    )
    metrics = ev.run_metrics(df)
    m = metrics.first()
    assert (m.average_time, m.time_std, m.correction_rate, m.field_accuracy) == (8.0, 4.0, 0.5, 0.25)
    b = ev.business_value(metrics).first()
    assert b.business_value_score == pytest.approx((0.2 + 0.6 + 1.0 + 0.5) / 4)
    empty = ev.business_value(ev.run_metrics(df.limit(0))).first()
    assert empty.confidence_score is None and empty.business_value_score == 0.0


def test_summary_status_bands(spark):
    def row(name, value):
        return spark.createDataFrame([(value,)], f"{name} double")

    got = {
        r.component: (r.status, r.component_count)
        for r in ev.evaluation_summary(
            row("accuracy", 0.85), row("f1", 0.85), row("business_value_score", 0.6)
        ).collect()
    }
    assert got == {
        "classification": ("warning", 1), "ner": ("good", 1), "run": ("error", 1), "overall": ("warning", 3)
    }
    assert ev.evaluation_summary(ner=row("f1", 0.9)).count() == 2
