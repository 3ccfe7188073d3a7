"""Document types: a multinomial naive Bayes model trained and applied with Spark."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass
from functools import cached_property
from typing import ClassVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions.arrays import let, rows_of, total, values_of
from formwright.functions.text import word_tokens
from formwright.session import new_path
from formwright.vocabulary import DOCUMENT_TYPES, UNKNOWN_TYPE

N_TYPES = len(DOCUMENT_TYPES)
#: Tokens are counted in so many slots, at most 65,536; the model's size does not grow with the vocabulary.
SLOTS = 1 << 14


def _types() -> Column:
    return F.array(*[F.lit(t) for t in DOCUMENT_TYPES])


def type_name(label_id: Column) -> Column:
    return F.get(_types(), label_id)


def slot_of(token: Column) -> Column:
    """The token's slot: the first 16 bits of its MD5, modulo `SLOTS`."""
    return F.conv(F.substring(F.md5(token), 1, 4), 16, 10).cast("int") % F.lit(SLOTS)


def slot_counts(labelled: DataFrame) -> DataFrame:
    """(slot, counts): occurrences of each slot's tokens per class, from rows (text, label_id)."""
    slots = values_of(labelled, F.transform(word_tokens(F.col("text")), slot_of), "slot", "label_id")
    per_class = slots.groupBy("slot").agg(
        *[F.count_if(F.col("label_id") == i).alias(f"c{i}") for i in range(N_TYPES)]
    )
    return per_class.select("slot", F.array(*[f"c{i}" for i in range(N_TYPES)]).alias("counts"))


@dataclass(frozen=True)
class KeywordClassifier:
    """Slot counts per class as a written table, and the few numbers that turn them into weights.

    The weights, at most `SLOTS` rows, are a constant of the plan and are looked up inside the document's
    row, whatever the vocabulary. Slots without training tokens count for no class.
    """

    counts: DataFrame
    token_totals: tuple[int, ...]
    label_counts: tuple[int, ...]
    vocabulary_size: int

    META: ClassVar[str] = (
        "vocabulary_size bigint, token_totals array<bigint>, label_counts array<bigint>"
    )

    @classmethod
    def fit(cls, labelled: DataFrame, path: str | None = None) -> KeywordClassifier:
        """Train on (text, label_id) rows and write the model to `path`, which must be new."""
        spark = labelled.sparkSession
        path = path or new_path(spark, "classifier")
        labels = labelled.agg(*[F.count_if(F.col("label_id") == i) for i in range(N_TYPES)]).first()
        return cls._write(slot_counts(labelled), tuple(labels), path)

    @classmethod
    def _write(
        cls, counts: DataFrame, label_counts: tuple[int, ...], path: str
    ) -> KeywordClassifier:
        spark = counts.sparkSession
        counts.write.parquet(f"{path}/counts")
        counts = spark.read.parquet(f"{path}/counts")
        size, *totals = counts.agg(
            F.count("*"), *[F.coalesce(F.sum(F.get("counts", i)), F.lit(0)) for i in range(N_TYPES)]
        ).first()
        spark.createDataFrame([(size, totals, list(label_counts))], cls.META).write.parquet(f"{path}/meta")
        return cls.load(spark, path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> KeywordClassifier:
        meta = spark.read.schema(cls.META).parquet(f"{path}/meta").first()
        return cls(
            spark.read.parquet(f"{path}/counts"),
            tuple(meta["token_totals"]),
            tuple(meta["label_counts"]),
            meta["vocabulary_size"],
        )

    def save(self, path: str) -> KeywordClassifier:
        """Write the model to a new `path`."""
        return self._write(self.counts, self.label_counts, path)

    @property
    def priors(self) -> list[float]:
        n = sum(self.label_counts)
        return [math.log((c + 1) / (n + N_TYPES)) for c in self.label_counts]

    def weights(self) -> DataFrame:
        """(slot, weights): log probability of the slot in each class, add-one smoothed."""
        smoothed = [
            F.log((F.get("counts", i) + 1) / F.lit(float(t + self.vocabulary_size)))
            for i, t in enumerate(self.token_totals)
        ]
        return self.counts.select("slot", F.array(*smoothed).alias("weights"))

    def weight_rows(self) -> DataFrame:
        """(slot, label_id, weight)"""
        return self.weights().select("slot", F.posexplode("weights").alias("label_id", "weight"))

    @cached_property
    def _by_slot(self) -> Column:
        """The weights as a constant, NULL for slots without any.

        Written as JSON, which the optimizer turns into one literal value.
        """
        rows = dict(self.weights().collect())  # at most SLOTS rows
        listed = [rows.get(slot) for slot in range(SLOTS)]
        return F.from_json(F.lit(json.dumps(listed)), "array<array<double>>")

    def _scores(self, tokens: Column) -> Column:
        by_slot = self._by_slot

        def add(scores: Column, token: Column) -> Column:
            return let(
                F.get(by_slot, slot_of(token)),
                lambda w: F.when(w.isNull(), scores).otherwise(
                    F.zip_with(scores, w, lambda a, b: a + b)
                ),
            )

        return F.aggregate(tokens, F.array(*[F.lit(p) for p in self.priors]), add)

    def with_probabilities(self, docs: DataFrame, token_limit: int | None = None) -> DataFrame:
        """Adds `probabilities` (one per class, in class order); NULL where the text is NULL.

        The whole text counts unless `token_limit` is given.
        """
        scores = self._scores(_limited(word_tokens(F.col("text")), token_limit))
        return docs.withColumn("probabilities", softmax(scores))

    def classify(self, docs: DataFrame, token_limit: int | None = None) -> DataFrame:
        """Adds `document_type` and `classification_confidence`."""
        return with_document_type(self.with_probabilities(docs, token_limit))

    def info(self) -> dict[str, object]:
        return {
            "num_classes": N_TYPES,
            "document_types": list(DOCUMENT_TYPES),
            "vocabulary_size": self.vocabulary_size,
            "total_parameters": (self.vocabulary_size + 1) * N_TYPES,
            "training_documents": sum(self.label_counts),
        }


def _limited(tokens: Column, limit: int | None) -> Column:
    return tokens if limit is None else F.slice(tokens, 1, limit)


def softmax(scores: Column) -> Column:
    """Class probabilities from log scores, shifted by the highest one."""

    def normalized(e: Column) -> Column:
        return let(total(e, F.lit(0.0)), lambda s: F.transform(e, lambda x: x / s))

    return let(
        scores,
        lambda x: let(
            F.array_max(x), lambda top: let(F.transform(x, lambda y: F.exp(y - top)), normalized)
        ),
    )


def with_document_type(docs: DataFrame) -> DataFrame:
    """Adds the most probable class (the first of equals) and its probability from `probabilities`."""
    p = F.col("probabilities")

    def best(x: Column) -> Column:
        return let(
            F.array_max(x),
            lambda top: F.struct(
                type_name(F.array_position(x, top).cast("int") - 1).alias("name"),
                top.alias("confidence"),
            ),
        )

    unknown = F.struct(F.lit(UNKNOWN_TYPE).alias("name"), F.lit(0.0).alias("confidence"))
    picked = docs.withColumn("_best", F.when(p.isNull(), unknown).otherwise(let(p, best)))
    return picked.withColumns(
        {
            "document_type": F.col("_best.name"),
            "classification_confidence": F.col("_best.confidence"),
        }
    ).drop("_best")


def probability_map(probabilities: Column) -> Column:
    """Class name to probability."""
    return F.map_from_arrays(_types(), probabilities)


def probability_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, document_type, p) for every class of documents that have `probabilities`."""
    entries = F.transform(
        F.col("probabilities"),
        lambda p, i: F.struct(type_name(i).alias("document_type"), p.alias("p")),
    )
    return rows_of(docs, entries, "doc_id")
