"""The discriminative classifier on held-out texts, and on texts and labels that cannot be used."""

from pyspark.sql import functions as F

from formwright.operators import classify as cls
from formwright.operators.logistic import LogisticClassifier
from formwright.plans import corpus as c
from formwright.sources import synthetic, training


def test_held_out_accuracy_and_saved_models(spark, sf_dir, tmp_path):
    samples = synthetic.synthetic_texts(c.orders(spark, sf_dir), "o_orderkey")
    parts = training.split(samples, "sample_id", "label_id").cache()
    odd = spark.createDataFrame([(None, 1), ("text", None), ("text", 9), ("", 2)], "text string, label_id int")
    train = parts.filter("is_train").select("text", "label_id").unionByName(odd)
    model = LogisticClassifier.fit(train, str(tmp_path / "model"), steps=5)
    model.save(str(tmp_path / "saved"))
    loaded = LogisticClassifier.load(spark, str(tmp_path / "saved"))
    held = cls.with_document_type(loaded.with_probabilities(parts.filter("NOT is_train")))
    right = held.agg(F.avg((F.col("document_type") == cls.type_name(F.col("label_id"))).cast("int"))).first()[0]
    assert right > 0.95
    rows = loaded.with_probabilities(spark.createDataFrame([(None,), ("",), ("unseen",)], "text string")).collect()
    assert rows[0].probabilities is None
    assert all(abs(sum(r.probabilities) - 1) < 1e-9 for r in rows[1:])
