"""Evaluation: classification, entities, whole runs, and their summary.

The data is aggregated once into small tables (a confusion table, matched entities per field, one row
of sums); every measure is then computed from those.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.functions.arrays import let, rows_of
from formwright.functions.candidates import given_source
from formwright.functions.text import preview
from formwright.operators import entities as ent
from formwright.vocabulary import DOCUMENT_TYPES, FIELD_TYPES, IGNORED_LABEL

ENTITY_KEY = ("doc_id", "field_name", "value", "start", "end")


def ratio(part: Column, whole: Column) -> Column:
    """`part / whole`, 0 where the whole is 0 (or missing)."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def harmonic(precision: Column, recall: Column) -> Column:
    return ratio(precision * recall * 2, precision + recall)


def distribution(values: Column, name: str) -> list[Column]:
    """Mean, population deviation, least and greatest value."""
    return [
        F.avg(values).alias(f"average_{name}"),
        F.stddev_pop(values).alias(f"{name}_std"),
        F.min(values).alias(f"min_{name}"),
        F.max(values).alias(f"max_{name}"),
    ]


def names_frame(df: DataFrame, names: Iterable[str], column: str) -> DataFrame:
    """A closed vocabulary as a small table."""
    return df.sparkSession.createDataFrame([(name,) for name in names], f"{column} string")


# ---- classification -----------------------------------------------------------------------------


def confusion_counts(predictions: DataFrame) -> DataFrame:
    """(true_label, pred_label, n); at most one row per pair of labels."""
    return predictions.groupBy("true_label", "pred_label").agg(F.count("*").alias("n"))


def confusion_matrix(
    confusion: DataFrame, labels: Iterable[str] = DOCUMENT_TYPES
) -> DataFrame:
    """The full grid of true and predicted labels, 0 where nothing was counted."""
    labels = list(labels)
    grid = confusion.sparkSession.createDataFrame(
        [(t, p) for t in labels for p in labels], "true_label string, pred_label string"
    )
    return F.broadcast(grid).join(confusion, ["true_label", "pred_label"], "left").select(
        "true_label", "pred_label", F.coalesce("n", F.lit(0)).alias("n")
    )


def per_class_metrics(
    confusion: DataFrame, labels: Iterable[str] | None = DOCUMENT_TYPES
) -> DataFrame:
    """Precision, recall, F1 and support per label.

    With `labels` every one of them is listed, also without data; otherwise the labels that occur.
    """
    marks = confusion.select(
        F.explode(
            F.array(
                F.struct(F.col("true_label").alias("label"), F.lit(1).alias("as_true")),
                F.struct(F.col("pred_label").alias("label"), F.lit(0).alias("as_true")),
            )
        ).alias("m"),
        F.when(F.col("true_label") == F.col("pred_label"), F.col("n")).otherwise(0).alias("hit"),
        "n",
    ).select("m.label", "m.as_true", "hit", "n")
    sums = marks.groupBy("label").agg(
        F.sum(F.when(F.col("as_true") == 1, F.col("hit"))).alias("tp"),
        F.sum(F.when(F.col("as_true") == 1, F.col("n"))).alias("n_true"),
        F.sum(F.when(F.col("as_true") == 0, F.col("n"))).alias("n_pred"),
    )
    if labels is not None:
        sums = F.broadcast(names_frame(confusion, labels, "label")).join(sums, "label", "left")
    precision, recall = ratio(F.col("tp"), F.col("n_pred")), ratio(F.col("tp"), F.col("n_true"))
    return sums.select(
        "label",
        precision.alias("precision"),
        recall.alias("recall"),
        harmonic(precision, recall).alias("f1"),
        F.coalesce("n_true", F.lit(0)).alias("support"),
    )


def _weighted(name: str) -> Column:
    return ratio(F.sum(F.col(name) * F.col("support")), F.sum("support")).alias(name)


def classification_metrics(confusion: DataFrame) -> DataFrame:
    """One row: accuracy, support-weighted precision, recall and F1, and the sample count."""
    weighted = per_class_metrics(confusion, labels=None).agg(
        *[_weighted(name) for name in ("precision", "recall", "f1")],
        # Weighted recall is the share of samples whose label was found, which is the accuracy.
        F.sum("support").alias("total_samples"),
    )
    return weighted.select(
        F.col("recall").alias("accuracy"), "precision", "recall", "f1", "total_samples"
    )


def classification_report(confusion: DataFrame) -> DataFrame:
    """Per-class rows with accuracy, macro and weighted averages.

    The averages are the subtotal of a rollup over the classes, so the data is gone through once.
    """
    measures = ("precision", "recall", "f1")
    totals = (
        per_class_metrics(confusion)
        .rollup("label")
        .agg(
            *[F.avg(name).alias(name) for name in measures],
            *[_weighted(name).alias(f"weighted_{name}") for name in measures],
            F.sum("support").alias("support"),
        )
    )

    def row(label: Column, precision: Column, recall: Column, f1: Column) -> Column:
        return F.struct(
            label.alias("label"),
            precision.alias("precision"),
            recall.alias("recall"),
            f1.alias("f1"),
            F.col("support").alias("support"),
        )

    plain = [F.col(name) for name in measures]
    weighted = [F.col(f"weighted_{name}") for name in measures]
    nothing = F.lit(None).cast("double")
    averages = F.array(
        row(F.lit("accuracy"), nothing, nothing, F.col("weighted_recall")),
        row(F.lit("macro avg"), *plain),
        row(F.lit("weighted avg"), *weighted),
    )
    of_class = F.array(row(F.col("label"), *plain))
    return rows_of(totals, F.when(F.col("label").isNull(), averages).otherwise(of_class))


def prediction_distributions(predictions: DataFrame) -> DataFrame:
    """One row: distributions of confidence and processing time."""
    return predictions.agg(
        *distribution(F.col("confidence"), "confidence"),
        *distribution(F.col("processing_time"), "time"),
    )


def classification_details(predictions: DataFrame) -> DataFrame:
    """One row per sample; the document's own id is the sample id, so no global order is needed."""
    return predictions.select(
        F.col("doc_id").alias("sample_id"),
        preview(F.col("text")).alias("text"),
        "true_label",
        F.col("pred_label").alias("predicted_label"),
        "confidence",
        (F.col("pred_label") == F.col("true_label")).alias("correct"),
    )


def token_metrics(tokens: DataFrame) -> DataFrame:
    """Accuracy and weighted scores over tokens (true_id, pred_id), ignored labels left out."""
    counted = tokens.filter(F.col("true_id") != IGNORED_LABEL).select(
        F.col("true_id").cast("string").alias("true_label"),
        F.col("pred_id").cast("string").alias("pred_label"),
    )
    return classification_metrics(confusion_counts(counted))


# ---- entities -----------------------------------------------------------------------------------


def entity_keys(array: str) -> Column:
    """What entities of an array of fields are matched by; missing offsets defaulted."""
    return F.transform(
        F.col(array),
        lambda f: F.struct(
            f["field_name"].alias("field_name"),
            f["value"].alias("value"),
            F.coalesce(f["start"], F.lit(0)).cast("int").alias("start"),
            F.coalesce(f["end"], F.length(f["value"])).cast("int").alias("end"),
        ),
    )


def entity_rows(docs: DataFrame, array: str) -> DataFrame:
    """(doc_id, field_name, value, start, end) of an array of fields; missing offsets defaulted."""
    return rows_of(docs, entity_keys(array), "doc_id")


def with_matches(docs: DataFrame, predicted: str = "ranked", truth: str = "true_entities") -> DataFrame:
    """Adds `found`, `wrong` and `missed`: the distinct entities of both sides, of one, of the other.

    Both are arrays of the same row, so nothing is shuffled. Documents without either array have none.
    """
    none = F.expr("cast(array() AS array<struct<field_name: string, value: string, start: int, end: int>>)")
    sides = docs.withColumns(
        {"_predicted": F.coalesce(entity_keys(predicted), none), "_true": F.coalesce(entity_keys(truth), none)}
    )
    return sides.withColumns(
        {
            "found": F.array_intersect("_predicted", "_true"),
            "wrong": F.array_except("_predicted", "_true"),
            "missed": F.array_except("_true", "_predicted"),
        }
    ).drop("_predicted", "_true")


def matched_rows(docs: DataFrame) -> DataFrame:
    """The entities of documents `with_matches` as rows, as `match_entities` gives them for two tables."""

    def flagged(name: str, in_pred: int, in_true: int) -> Column:
        return F.transform(
            name,
            lambda e: F.struct(
                *[e[k].alias(k) for k in ENTITY_KEY[1:]],
                F.lit(in_pred).alias("in_pred"),
                F.lit(in_true).alias("in_true"),
            ),
        )

    both = F.concat(flagged("found", 1, 1), flagged("wrong", 1, 0), flagged("missed", 0, 1))
    return rows_of(docs, both, "doc_id")


TRUTH, DOCUMENT = -2, -3


def matches_of_texts(docs: DataFrame, entities: str = "entities", truth: str = "true_entities", min_confidence: float = 0.3) -> DataFrame:
    """`match_entities` of the candidates in texts and the true entities of the same rows, and a row for each document.

    That row has no flags set. Candidates are grouped by document, so documents that were dealt by their id are not
    shuffled again. `_row` tells documents with one id apart.
    """
    none = F.expr("cast(array() AS array<struct<field_name: string, value: string, start: int, end: int>>)")
    true = F.transform(
        F.coalesce(entity_keys(truth), none),
        lambda e: given_source(TRUTH, e["field_name"], e["value"], e["start"], e["end"]),
    )
    nothing = F.lit(None).cast("string")
    others = F.concat(true, F.array(given_source(DOCUMENT, nothing, nothing, F.lit(None), F.lit(None))))
    keep = ("_row", "doc_id")
    numbered = docs.withColumn("_row", F.monotonically_increasing_id())
    rows = ent.candidate_table(numbered, *keep, entities=entities, others=others)
    # True entities are told apart by their places too, those of a text by their values alone.
    given = F.col("source") <= TRUTH
    sided = rows.withColumns(
        {
            "side": F.when(given, F.col("source")).otherwise(F.lit(0)),
            "true_start": F.when(given, F.col("given_start")),
            "true_end": F.when(given, F.col("given_end")),
        }
    )
    key = (*keep, "field_name", "value", "side", "true_start", "true_end")
    first = ent.first_of_equals(sided, *key, min_confidence=min_confidence)
    predicted = F.col("side") == 0
    start = F.when(predicted, F.coalesce("start", F.lit(0))).otherwise(F.col("true_start"))
    end = F.when(predicted, F.coalesce("end", F.length("value"))).otherwise(F.col("true_end"))
    kept = first.where(~predicted | ~F.col("rejected"))
    placed = kept.select(*keep, "field_name", "value", start.alias("start"), end.alias("end"), "side")
    return placed.groupBy(*keep, *ENTITY_KEY[1:]).agg(
        F.max((F.col("side") == 0).cast("int")).alias("in_pred"),
        F.max((F.col("side") == TRUTH).cast("int")).alias("in_true"),
    )


def distinct_entities(candidates: DataFrame, *keep: str, min_confidence: float = 0.3) -> DataFrame:
    """The rows that `entity_rows` gives for a document's ranked fields, from a `candidate_table`."""
    first = ent.first_of_equals(candidates, *keep, "field_name", "value", min_confidence=min_confidence)
    start, end = F.coalesce("start", F.lit(0)), F.coalesce("end", F.length("value"))
    return first.where("NOT rejected").select(*keep, "field_name", "value", start.alias("start"), end.alias("end"))


def matches_only(matches: DataFrame) -> DataFrame:
    """The entities among `matches_of_texts`."""
    return matches.where("in_pred = 1 OR in_true = 1").select(*ENTITY_KEY, "in_pred", "in_true")


def sizes_of_matches(matches: DataFrame) -> DataFrame:
    """`match_sizes` from `matches_of_texts`."""
    return matches.groupBy("_row", "doc_id").agg(*_match_counts()).drop("_row")


def match_sizes(docs: DataFrame) -> DataFrame:
    """Per document `with_matches` how many entities were found, wrong and missed."""
    return docs.select(
        "doc_id",
        F.size("found").cast("long").alias("tp"),
        F.size("wrong").cast("long").alias("fp"),
        F.size("missed").cast("long").alias("fn"),
    )


def match_entities(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Every distinct entity of either side with flags `in_pred` and `in_true`.

    A grouping of the union in place of a full outer join: one shuffle, copies merged before it, and
    no row meets another.
    """
    sides = predicted.select(
        *ENTITY_KEY, F.lit(1).alias("in_pred"), F.lit(0).alias("in_true")
    ).unionAll(
        truth.select(*ENTITY_KEY, F.lit(0).alias("in_pred"), F.lit(1).alias("in_true"))
    )
    return sides.groupBy(*ENTITY_KEY).agg(
        F.max("in_pred").alias("in_pred"), F.max("in_true").alias("in_true")
    )


def true_positives(matches: DataFrame) -> DataFrame:
    return matches.filter("in_pred = 1 and in_true = 1").select(*ENTITY_KEY)


def false_positives(matches: DataFrame) -> DataFrame:
    return matches.filter("in_pred = 1 and in_true = 0").select(*ENTITY_KEY)


def false_negatives(matches: DataFrame) -> DataFrame:
    return matches.filter("in_pred = 0 and in_true = 1").select(*ENTITY_KEY)


def _match_counts() -> list[Column]:
    return [
        F.sum(F.col("in_pred") * F.col("in_true")).alias("tp"),
        F.sum(F.col("in_pred") * (1 - F.col("in_true"))).alias("fp"),
        F.sum((1 - F.col("in_pred")) * F.col("in_true")).alias("fn"),
    ]


def _match_scores(counts: DataFrame, *keep: str) -> DataFrame:
    tp, fp, fn = (F.coalesce(F.col(c), F.lit(0)) for c in ("tp", "fp", "fn"))
    precision, recall = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return counts.select(
        *keep,
        precision.alias("precision"),
        recall.alias("recall"),
        harmonic(precision, recall).alias("f1"),
        tp.alias("true_positives"),
        fp.alias("false_positives"),
        fn.alias("false_negatives"),
    )


def ner_metrics(matches: DataFrame) -> DataFrame:
    """One row: micro precision, recall and F1 with the counts behind them."""
    return _match_scores(matches.agg(*_match_counts()))


def ner_metrics_of_sizes(sizes: DataFrame) -> DataFrame:
    """The same from `match_sizes`, or sums of them."""
    return _match_scores(sizes.agg(*[F.sum(n).alias(n) for n in ("tp", "fp", "fn")]))


def ner_doc_match_of_sizes(sizes: DataFrame) -> DataFrame:
    """`ner_doc_match` from `match_sizes`, which has a row for every document."""
    return _doc_match(sizes)


def ner_per_type(matches: DataFrame) -> DataFrame:
    """The same per field type; all types are listed."""
    counts = matches.groupBy("field_name").agg(*_match_counts())
    types = F.broadcast(names_frame(matches, FIELD_TYPES, "field_name"))
    return _match_scores(types.join(counts, "field_name", "left"), "field_name")


def ner_doc_match(docs: DataFrame, matches: DataFrame) -> DataFrame:
    """One row: shares of documents matched exactly, and with at least one entity found.

    Exact means the same set of entities, in any order. `docs` (doc_id) also brings in documents
    without entities on either side, which match exactly.
    """
    marks = matches.select("doc_id", "in_pred", "in_true").unionAll(
        docs.select("doc_id", F.lit(0).alias("in_pred"), F.lit(0).alias("in_true"))
    )
    return _doc_match(marks.groupBy("doc_id").agg(*_match_counts()))


def _doc_match(per_doc: DataFrame) -> DataFrame:
    return per_doc.agg(
        F.avg(((F.col("fp") == 0) & (F.col("fn") == 0)).cast("int")).alias("exact_match_accuracy"),
        F.avg((F.col("tp") > 0).cast("int")).alias("partial_match_accuracy"),
        F.count("*").alias("total_documents"),
    )


def ner_confidence(docs: DataFrame, ranked: str = "ranked") -> DataFrame:
    """One row: distribution of the documents' mean entity confidence (0 without entities)."""
    return docs.select(mean_entity_confidence(F.col(ranked)).alias("c")).agg(
        *distribution(F.col("c"), "confidence")
    )


def mean_entity_confidence(ranked: Column) -> Column:
    def mean(r: Column) -> Column:
        sums = F.aggregate(r, F.lit(0.0), lambda acc, f: acc + f["confidence"])
        return F.when(F.size(r) > 0, sums / F.size(r)).otherwise(F.lit(0.0))

    return let(ranked, mean)


def ner_details(docs: DataFrame, predicted: str = "ranked", truth: str = "true_entities") -> DataFrame:
    """One row per sample with its true and predicted entities, nested."""
    return docs.select(
        F.col("doc_id").alias("sample_id"),
        preview(F.col("text")).alias("text"),
        F.col(truth).alias("true_entities"),
        F.col(predicted).alias("predicted_entities"),
    )


# ---- whole runs ---------------------------------------------------------------------------------


def run_metrics(results: DataFrame) -> DataFrame:
    """One row of metrics over processed documents.

    `results` has processing_time_seconds, user_corrections (may be NULL), average_confidence,
    n_fields and n_high (fields above 0.8).
    """
    sums = results.agg(
        *distribution(F.col("processing_time_seconds"), "time"),
        F.avg("average_confidence").alias("average_confidence"),
        F.stddev_pop("average_confidence").alias("confidence_std"),
        F.sum("n_fields").alias("total_fields_extracted"),
        F.sum("n_high").alias("high_confidence_fields"),
        F.sum(F.coalesce("user_corrections", F.lit(0))).alias("total_corrections"),
        F.count("*").alias("total_documents"),
    )
    return sums.withColumns(
        {
            "field_accuracy": ratio(F.col("high_confidence_fields"), F.col("total_fields_extracted")),
            "correction_rate": ratio(F.col("total_corrections"), F.col("total_documents")),
        }
    )


def business_value(metrics: DataFrame) -> DataFrame:
    """One row: mean of the speed, confidence, field and correction scores that can be computed.

    The mean is 0 for a run without documents.
    """
    one = F.lit(1.0)
    fields = ratio(F.col("total_fields_extracted"), F.col("total_documents") * 10)
    scored = metrics.select(
        F.greatest(F.lit(0.0), one - F.col("average_time") / 10).alias("speed_score"),
        F.col("average_confidence").alias("confidence_score"),
        F.least(one, fields).alias("field_score"),
        F.greatest(F.lit(0.0), one - F.col("correction_rate")).alias("correction_score"),
        "total_documents",
    )
    factors = F.array_compact(F.array(*scored.columns[:-1]))
    mean = F.aggregate(factors, F.lit(0.0), lambda acc, x: acc + x) / F.size(factors)
    return scored.withColumn(
        "business_value_score",
        F.when((F.size(factors) > 0) & (F.col("total_documents") > 0), mean).otherwise(F.lit(0.0)),
    ).drop("total_documents")


# ---- summary ------------------------------------------------------------------------------------

# The scores above which a component is good, and above which it is a warning.
STATUS_BANDS = {
    "classification": (0.9, 0.7),
    "ner": (0.8, 0.6),
    "run": (0.8, 0.6),
    "overall": (0.8, 0.6),
}


def status_band(component: Column, score: Column) -> Column:
    band = F.lit("error")
    for name, (good, warning) in STATUS_BANDS.items():
        band = F.when(
            component == name,
            F.when(score > good, "good").when(score > warning, "warning").otherwise("error"),
        ).otherwise(band)
    return band


def evaluation_summary(
    classification: DataFrame | None = None,
    ner: DataFrame | None = None,
    run: DataFrame | None = None,
) -> DataFrame:
    """One row per evaluated component and one for their mean, with a status each."""
    parts = [
        df.select(F.lit(name).alias("component"), F.col(column).alias("score"))
        for name, df, column in (
            ("classification", classification, "accuracy"),
            ("ner", ner, "f1"),
            ("run", run, "business_value_score"),
        )
        if df is not None
    ]
    if not parts:
        raise ValueError("nothing to summarize")
    components = parts[0]
    for part in parts[1:]:
        components = components.unionAll(part)
    # Subtotals by grouping sets: the components are evaluated once for both kinds of row.
    return (
        components.rollup("component")
        .agg(F.avg("score").alias("score"), F.count("*").cast("int").alias("component_count"))
        .withColumn("component", F.coalesce("component", F.lit("overall")))
        .withColumn("status", status_band(F.col("component"), F.col("score")))
    )
