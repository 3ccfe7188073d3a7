"""The whole evaluation over the derived corpus."""

from pyspark.sql import functions as F

from formwright.plans import catalog, evaluation
from formwright.plans import corpus as c


def test_evaluate_all(spark, sf_dir, tmp_path):
    docs = c.run_documents(c.documents(spark, sf_dir))
    engine = catalog.engine(spark, sf_dir)
    results = evaluation.evaluate_all(
        engine,
        docs.withColumn("true_label", F.col("true_type")),
        docs.select("doc_id", "text", "entities", "true_entities"),
        docs,
    )
    summary = {r.component: r.score for r in results["summary"].collect()}
    assert set(summary) == {"classification", "ner", "run", "overall"}
    assert round(summary["ner"], 6) == catalog.ner_metrics(spark, sf_dir).first().f1
    assert round(summary["run"], 6) == catalog.business_value(spark, sf_dir).first().business_value_score
    evaluation.save(results, str(tmp_path / "out"))
    assert {p.name for p in (tmp_path / "out").iterdir()} == set(results)
    details = spark.read.csv(str(tmp_path / "out" / "classification_details"), header=True)
    assert details.count() == 1500
