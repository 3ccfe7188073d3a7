"""Composite confidence, per-document summaries, and the rules that read scored fields.

`fields` is the array a document's scored fields are kept in (see `SCORED_FIELDS`).
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from formwright import vocabulary as v
from formwright.functions.arrays import let, total
from formwright.functions.validators import Validator, field_score

SCORED_FIELDS = (
    "array<struct<type_ord:int,field_name:string,field_rank:int,value:string,confidence:double,"
    "source_confidence:double,model_confidence:double,validation_score:double,"
    "start_position:int,end_position:int>>"
)


def normalized_weights(weights: Mapping[str, float] | None = None) -> dict[str, float]:
    """Defaults if empty; divided by their sum if that is more than 0.01 from 1."""
    chosen = dict(weights or v.DEFAULT_WEIGHTS)
    whole = sum(chosen.values())
    if abs(whole - 1.0) > 0.01:
        chosen = {name: weight / whole for name, weight in chosen.items()}
    return chosen


def composite_confidence(
    source: Column, model: Column, validation: Column, weights: Mapping[str, float] | Column | None = None
) -> Column:
    """`weights` as a column is a struct that is normalized already, such as `operators.weights` gives."""
    w = weights if isinstance(weights, Column) else normalized_weights(weights)
    weighted = source * w["ocr"] + model * w["ner"] + validation * w["validation"]
    return F.least(weighted, F.lit(1.0))


def scored_fields(
    ranked: Column,
    source_confidence: Column,
    weights: Mapping[str, float] | Column | None = None,
    validators: Mapping[str, Validator] | None = None,
) -> Column:
    """Validation score and composite confidence for each ranked candidate."""

    def scored(f: Column) -> Column:
        return let(field_score(f["field_name"], f["value"], validators), lambda s: result(f, s))

    def result(f: Column, validation: Column) -> Column:
        composite = composite_confidence(source_confidence, f["confidence"], validation, weights)
        return F.struct(
            f["type_ord"].alias("type_ord"),
            f["field_name"].alias("field_name"),
            f["field_rank"].alias("field_rank"),
            f["value"].alias("value"),
            composite.alias("confidence"),
            source_confidence.alias("source_confidence"),
            f["confidence"].alias("model_confidence"),
            validation.alias("validation_score"),
            f["start"].alias("start_position"),
            f["end"].alias("end_position"),
        )

    return F.transform(ranked, scored)


def _count_where(values: Column, test) -> Column:
    return F.size(F.filter(values, test))


def confidence_summary(fields: Column) -> Column:
    """Count, mean, bands (0.8 and up, 0.5 and up, below) and population deviation."""

    def summary(c: Column) -> Column:
        n = F.size(c)
        mean = F.when(n > 0, total(c, F.lit(0.0)) / n).otherwise(F.lit(0.0))
        return let(mean, lambda m: banded(c, n, m))

    def banded(c: Column, n: Column, mean: Column) -> Column:
        squares = F.transform(c, lambda x: (x - mean) * (x - mean))
        return F.struct(
            n.alias("total_results"),
            mean.alias("average_confidence"),
            _count_where(c, lambda x: x >= 0.8).alias("high_confidence_count"),
            _count_where(c, lambda x: (x >= 0.5) & (x < 0.8)).alias("medium_confidence_count"),
            _count_where(c, lambda x: x < 0.5).alias("low_confidence_count"),
            F.when(n > 0, F.sqrt(total(squares, F.lit(0.0)) / n)).alias("confidence_std"),
        )

    return let(F.transform(fields, lambda f: f["confidence"]), summary)


def extraction_summary(ranked: Column) -> Column:
    """Entities, confident entities (above 0.7), their share, and field types found."""

    def summary(r: Column) -> Column:
        high = _count_where(r, lambda f: f["confidence"] > 0.7)
        return F.struct(
            F.size(r).alias("total_entities"),
            high.alias("high_confidence_entities"),
            (high / F.greatest(F.size(r), F.lit(1))).alias("confidence_ratio"),
            _count_where(r, lambda f: f["field_rank"] == 1).alias("fields_found"),
        )

    return let(ranked, summary)


def best_values(ranked: Column) -> Column:
    """For every field type the top-ranked value, NULL and 0 where there is none."""

    def best(heads: Column) -> Column:
        at = F.transform(heads, lambda f: f["type_ord"])
        return let(
            at, lambda ords: F.array(*[pick(heads, ords, i) for i in range(len(v.FIELD_TYPES))])
        )

    def pick(heads: Column, ords: Column, i: int) -> Column:
        head = F.get(heads, F.array_position(ords, i).cast("int") - 1)
        return F.struct(
            F.lit(v.FIELD_TYPES[i]).alias("field_name"),
            head["value"].alias("value"),
            F.coalesce(head["confidence"], F.lit(0.0)).alias("confidence"),
        )

    return let(F.filter(ranked, lambda f: f["field_rank"] == 1), best)


def structured_values(fields: Column, threshold: float = 0.5) -> Column:
    """One value per field found: that of its last (lowest-ranked) row.

    The value is NULL where the confidence of that row is not above the threshold.
    """

    def is_last(rows: Column, row: Column, i: Column) -> Column:
        following = F.get(rows, i + 1)
        return following.isNull() | (following["field_name"] != row["field_name"])

    def last_rows(rows: Column) -> Column:
        return F.transform(
            F.filter(rows, lambda row, i: is_last(rows, row, i)),
            lambda f: F.struct(
                f["field_name"].alias("field_name"),
                F.when(f["confidence"] > threshold, f["value"]).alias("value"),
            ),
        )

    return let(fields, last_rows)


def missing_critical(fields: Column, threshold: float = 0.5) -> Column:
    """Critical field names without a row above the threshold, in their fixed order."""
    critical = F.array(*[F.lit(name) for name in v.CRITICAL_FIELDS])

    def absent(accepted: Column) -> Column:
        return F.filter(critical, lambda name: ~F.array_contains(accepted, name))

    accepted_names = F.transform(
        F.filter(fields, lambda f: f["confidence"] > threshold), lambda f: f["field_name"]
    )
    return let(accepted_names, absent)


def document_check(
    fields: Column,
    average_confidence: Column,
    document_type: Column,
    expected_type: Column,
    seconds: Column,
) -> Column:
    """Issues and warnings of one document; it is valid if there is no issue."""
    issues = F.filter(
        F.array(F.when(average_confidence < 0.5, F.lit("Low overall confidence score"))),
        lambda text: text.isNotNull(),
    )
    missing = missing_critical(fields)
    warnings = F.filter(
        F.array(
            F.when(
                (expected_type != "") & (expected_type != document_type),
                F.format_string("Expected %s, got %s", expected_type, document_type),
            ),
            let(
                missing,
                lambda names: F.when(
                    F.size(names) > 0,
                    F.concat(F.lit("Missing critical fields: "), F.array_join(names, ", ")),
                ),
            ),
            F.when(
                seconds > v.SLOW_SECONDS, F.format_string("Slow processing time: %.2fs", seconds)
            ),
        ),
        lambda text: text.isNotNull(),
    )
    return F.struct(
        (F.size(issues) == 0).alias("is_valid"),
        issues.alias("issues"),
        warnings.alias("warnings"),
        average_confidence.alias("confidence_score"),
    )
