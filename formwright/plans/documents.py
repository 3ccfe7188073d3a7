"""Documents end to end: classify, extract, validate, score, summarize, check."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions.scoring import (
    best_values,
    confidence_summary,
    document_check,
    extraction_summary,
    missing_critical,
    normalized_weights,
    scored_fields,
    structured_values,
)
from formwright.functions.arrays import rows_of, values_of
from formwright.functions.validators import Validator, default_validators
from formwright.operators.classify import KeywordClassifier
from formwright.operators.entities import with_ranked_fields
from formwright.vocabulary import UNKNOWN_TYPE


@dataclass(frozen=True)
class DocumentEngine:
    """What a document is processed with.

    Documents are rows (doc_id, text, ocr_confidence) with, where there are any, `entities` of a
    field model, and the metadata columns path, processing_time_seconds, timestamp, ocr_processor.
    All methods work within the row: a corpus is processed in one pass, without a shuffle, and the
    same expressions serve batches and streams. `weights` may name a column of the documents (see
    `operators.weights`).
    """

    classifier: KeywordClassifier | None = None
    weights: Mapping[str, float] | str | None = None
    validators: Mapping[str, Validator] | None = None
    as_of: str | None = None
    min_confidence: float = 0.3

    def _rules(self) -> Mapping[str, Validator]:
        if self.validators is not None:
            return self.validators
        return default_validators(None if self.as_of is None else F.lit(self.as_of).cast("date"))

    # Built once per engine: these expressions have many parts, each a call to the JVM.
    @cached_property
    def _fields(self) -> Column:
        weights = F.col(self.weights) if isinstance(self.weights, str) else self.weights
        return scored_fields(F.col("ranked"), F.col("ocr_confidence"), weights, self._rules())

    @cached_property
    def _summary(self) -> Column:
        return confidence_summary(F.col("fields"))

    def extract(self, docs: DataFrame, places: bool = True) -> DataFrame:
        """Adds `ranked`, the distinct field candidates in type order and by rank; without `places`, start and end may be NULL."""
        entities = "entities" if "entities" in docs.columns else None
        return with_ranked_fields(docs, entities, self.min_confidence, places)

    def score(self, docs: DataFrame, places: bool = True) -> DataFrame:
        """Adds `ranked` and `fields`, the same with validation and composite confidence."""
        return self.extract(docs, places).withColumn("fields", self._fields)

    def classify(self, docs: DataFrame) -> DataFrame:
        """Adds `document_type` and `classification_confidence`."""
        if self.classifier is None:
            return docs.withColumns(
                {"document_type": F.lit(UNKNOWN_TYPE), "classification_confidence": F.lit(0.0)}
            )
        return self.classifier.classify(docs)

    def process(self, docs: DataFrame) -> DataFrame:
        """One result row per document, with its fields, metadata and confidence summary."""
        present = set(docs.columns)

        def metadata(name: str, column: str, type_name: str) -> Column:
            value = F.col(column) if column in present else F.lit(None)
            return value.cast(type_name).alias(name)

        fields = F.transform(
            "fields",
            lambda f: F.struct(
                *[
                    f[name].alias(name)
                    for name in (
                        "field_name",
                        "value",
                        "confidence",
                        "source_confidence",
                        "model_confidence",
                        "validation_score",
                        "start_position",
                        "end_position",
                    )
                ]
            ),
        )
        return self.classify(self.score(docs)).select(
            "doc_id",
            "document_type",
            "classification_confidence",
            fields.alias("extracted_fields"),
            F.col("text").alias("raw_text"),
            F.struct(
                F.col("ocr_confidence"),
                metadata("processing_time_seconds", "processing_time_seconds", "double"),
                metadata("timestamp", "timestamp", "timestamp"),
                metadata("ocr_processor", "ocr_processor", "string"),
                metadata("image_path", "path", "string"),
            ).alias("processing_metadata"),
            self._summary.alias("confidence_summary"),
        )

    def field_rows(self, docs: DataFrame, *keep: str, places: bool = True) -> DataFrame:
        """One row per scored field."""
        return rows_of(self.score(docs, places), "fields", "doc_id", *keep)

    def summaries(self, docs: DataFrame) -> DataFrame:
        """One row per document: the confidence summary as columns."""
        return self.score(docs, places=False).select("doc_id", self._summary.alias("s")).select("doc_id", "s.*")

    def extraction_summaries(self, docs: DataFrame) -> DataFrame:
        """One row per document: counts of entities and field types."""
        return self.extract(docs, places=False).select(
            "doc_id", extraction_summary(F.col("ranked")).alias("s")
        ).select("doc_id", "s.*")

    def best_values(self, docs: DataFrame) -> DataFrame:
        """One row per document and field type with the top-ranked value."""
        return rows_of(self.extract(docs, places=False), best_values(F.col("ranked")), "doc_id")

    def structured_data(self, docs: DataFrame) -> DataFrame:
        """One row per document and field found: the accepted value or NULL."""
        return rows_of(self.score(docs, places=False), structured_values(F.col("fields")), "doc_id")

    def missing_critical(self, docs: DataFrame) -> DataFrame:
        """One row per document and critical field it lacks."""
        return values_of(
            self.score(docs, places=False), missing_critical(F.col("fields")), "field_name", "doc_id"
        )

    def validate(self, docs: DataFrame) -> DataFrame:
        """One row per document: validity, issues, warnings, mean confidence.

        `expected_type` and `processing_time_seconds` are used where `docs` has them.
        """
        summary = self._summary["average_confidence"]
        scored = self.classify(self.score(docs, places=False).withColumn("_mean", summary))
        expected = F.col("expected_type") if "expected_type" in docs.columns else F.lit(None)
        seconds = (
            F.col("processing_time_seconds")
            if "processing_time_seconds" in docs.columns
            else F.lit(None)
        )
        check = document_check(
            F.col("fields"),
            F.col("_mean"),
            F.col("document_type"),
            expected.cast("string"),
            seconds.cast("double"),
        )
        return scored.select("doc_id", check.alias("c")).select("doc_id", "c.*")

    def review_queue(self, docs: DataFrame, k: int) -> DataFrame:
        """The k documents of lowest mean confidence among those below 0.5.

        Means equal to nine decimals are ties, which go by id: what they differ by beyond that is the
        order their scores were added in.
        """
        # Filtered within the row: a filter on the column would be pushed below the projection and
        # evaluate the extraction once more.
        low = F.filter(F.array(self._summary), lambda s: s["average_confidence"] < 0.5)
        return (
            rows_of(self.score(docs, places=False), low, "doc_id")
            .select("doc_id", "average_confidence", "total_results")
            .orderBy(F.round("average_confidence", 9), "doc_id")
            .limit(k)
        )

    def run_results(self, docs: DataFrame) -> DataFrame:
        """Per document what the metrics of a run need (see `evaluate.run_metrics`)."""
        return self.score(docs, places=False).select(
            "doc_id",
            "processing_time_seconds",
            "user_corrections",
            self._summary["average_confidence"].alias("average_confidence"),
            F.size("fields").alias("n_fields"),
            F.size(F.filter("fields", lambda f: f["confidence"] > 0.8)).alias("n_high"),
        )

    def stats(self, spark: SparkSession) -> DataFrame:
        """One row: the configured weights (the default ones if documents have their own) and facts about the classifier."""
        w = normalized_weights(None if isinstance(self.weights, str) else self.weights)
        info = self.classifier.info() if self.classifier else {}
        row = [
            (
                *(float(w[name]) for name in ("ocr", "ner", "validation")),
                info.get("num_classes"),
                ", ".join(info.get("document_types", [])) or None,
                info.get("vocabulary_size"),
                info.get("total_parameters"),
                info.get("training_documents"),
            )
        ]
        return spark.createDataFrame(
            row,
            "weight_ocr double, weight_ner double, weight_validation double, num_classes int, "
            "document_types string, vocabulary_size bigint, total_parameters bigint, "
            "training_documents bigint",
        )
