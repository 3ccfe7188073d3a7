"""Evaluation end to end: run the engine over labelled samples and measure it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formwright.functions.scoring import confidence_summary
from formwright.operators import evaluate as ev
from formwright.plans.documents import DocumentEngine
from formwright.session import new_path
from formwright.sources import sinks


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the shared folder, so that several measures read it once each."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


#: What cells are counted by, and merged by.
CELL_KEYS = ("true_label", "pred_label")


def cells_of(engine: DocumentEngine, docs: DataFrame) -> DataFrame:
    """The whole evaluation as mergeable cells: a row for each pair of true and predicted label, from one pass.

    `docs` has true_label, pred_label, true_entities, error, processing_time_seconds, user_corrections, and what the
    engine scores. Counts, sums and squares of cells add up; `min_` and `max_` columns are least and greatest
    values. The text of the assembled lines is the document's text, so one extraction serves entities and runs.
    """
    found = ev.with_matches(engine.score(docs))
    good = F.col("error").isNull()
    mean = confidence_summary(F.col("fields"))["average_confidence"]
    rows = found.select(
        *CELL_KEYS,
        F.size("found").alias("tp"),
        F.size("wrong").alias("fp"),
        F.size("missed").alias("fn"),
        F.when(good, F.col("processing_time_seconds")).alias("seconds"),
        F.when(good, mean).alias("confidence"),
        F.when(good, F.size("fields")).alias("n_fields"),
        F.when(good, F.coalesce("user_corrections", F.lit(0))).alias("corrections"),
        good.cast("int").alias("good"),
    )
    sums = ("tp", "fp", "fn", "seconds", "confidence", "n_fields", "corrections", "good")
    return rows.groupBy(*CELL_KEYS).agg(
        F.count("*").alias("n"),
        *[F.sum(name).alias(name) for name in sums],
        F.sum(F.col("seconds") * F.col("seconds")).alias("seconds_squared"),
        F.min("seconds").alias("min_seconds"),
        F.max("seconds").alias("max_seconds"),
    )


def run_metrics_of_cells(cells: DataFrame) -> DataFrame:
    """One row: the measures of whole runs from cells."""
    sums = ("seconds", "seconds_squared", "confidence", "n_fields", "corrections", "good")
    run = cells.agg(
        *[F.sum(name).alias(name) for name in sums],
        F.min("min_seconds").alias("min_time"),
        F.max("max_seconds").alias("max_time"),
    )
    mean = ev.ratio(F.col("seconds"), F.col("good"))
    spread = ev.ratio(F.col("seconds_squared"), F.col("good")) - mean * mean
    return run.select(
        mean.alias("average_time"),
        F.sqrt(F.greatest(spread, F.lit(0.0))).alias("time_std"),
        "min_time",
        "max_time",
        ev.ratio(F.col("confidence"), F.col("good")).alias("average_confidence"),
        F.col("n_fields").alias("total_fields_extracted"),
        ev.ratio(F.col("corrections"), F.col("good")).alias("correction_rate"),
        F.coalesce("good", F.lit(0)).alias("total_documents"),
    )


def summary_of_cells(cells: DataFrame) -> DataFrame:
    """The evaluation's summary from cells, of one pass or merged from many."""
    return ev.evaluation_summary(
        ev.classification_metrics(cells.select(*CELL_KEYS, "n")),
        ev.ner_metrics_of_sizes(cells),
        ev.business_value(run_metrics_of_cells(cells)),
    )


def evaluate_classification(engine: DocumentEngine, samples: DataFrame) -> dict[str, DataFrame]:
    """`samples`: doc_id, text, true_label and, if measured, processing_time."""
    if "processing_time" not in samples.columns:
        samples = samples.withColumn("processing_time", F.lit(None).cast("double"))
    predictions = written(
        engine.classify(samples).select(
            "doc_id",
            "text",
            "true_label",
            F.col("document_type").alias("pred_label"),
            F.col("classification_confidence").alias("confidence"),
            "processing_time",
        ),
        "predictions",
    )
    confusion = ev.confusion_counts(predictions)
    return {
        "classification": ev.classification_metrics(confusion),
        "per_class": ev.per_class_metrics(confusion),
        "confusion_matrix": ev.confusion_matrix(confusion),
        "distributions": ev.prediction_distributions(predictions),
        "classification_details": ev.classification_details(predictions),
    }


def evaluate_ner(engine: DocumentEngine, samples: DataFrame) -> dict[str, DataFrame]:
    """`samples`: doc_id, text, `true_entities` (field_name, value, start, end), maybe `entities`.

    Entities are matched within their document's row; only counts are shuffled.
    """
    extracted = written(
        engine.extract(samples).select("doc_id", "text", "ranked", "true_entities"), "extracted"
    )
    matched = ev.with_matches(extracted)
    sizes = written(ev.match_sizes(matched), "match-sizes")
    return {
        "ner": ev.ner_metrics_of_sizes(sizes),
        "ner_per_type": ev.ner_per_type(ev.matched_rows(matched)),
        "ner_doc_match": ev.ner_doc_match_of_sizes(sizes),
        "ner_confidence": ev.ner_confidence(extracted),
        "ner_details": ev.ner_details(extracted),
    }


def evaluate_runs(engine: DocumentEngine, docs: DataFrame) -> dict[str, DataFrame]:
    """`docs`: documents with processing_time_seconds and user_corrections; failed ones left out."""
    if "error" in docs.columns:
        docs = docs.filter(F.col("error").isNull())
    metrics = ev.run_metrics(written(engine.run_results(docs), "runs"))
    return {"run": metrics, "business_value": ev.business_value(metrics)}


def evaluate_all(
    engine: DocumentEngine,
    classification: DataFrame | None = None,
    ner: DataFrame | None = None,
    runs: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """The measures of every kind of sample given, and their `summary`."""
    results: dict[str, DataFrame] = {}
    if classification is not None:
        results |= evaluate_classification(engine, classification)
    if ner is not None:
        results |= evaluate_ner(engine, ner)
    if runs is not None:
        results |= evaluate_runs(engine, runs)
    results["summary"] = ev.evaluation_summary(
        results.get("classification"), results.get("ner"), results.get("business_value")
    )
    return results


def save(results: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """Details as they are partitioned, the small tables as one JSON file each."""
    for name, df in results.items():
        if name == "classification_details":
            sinks.write_classification_details(df, f"{folder}/{name}", mode)
        elif name == "ner_details":
            sinks.write_ner_details(df, f"{folder}/{name}", mode)
        else:
            sinks.write_metrics(df, f"{folder}/{name}", mode)
