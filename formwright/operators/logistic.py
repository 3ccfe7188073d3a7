"""Document types: multinomial logistic regression over weighted tokens, trained by repeated aggregation.

A document is a row with its sparse features: an array of (slot, value), the term frequencies of its tokens' slots
times the slots' inverse document frequencies, scaled to length one. A step scores every document within its row
against the weights, and sums the differences between what was expected and what was found over documents and slots:
one aggregation over at most `SLOTS` keys, merged before its shuffle. The weights are a table of one row, of a size
that the slots and types bound, which is why it may be broadcast; no data comes to the driver.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions.arrays import let, values_of
from formwright.functions.text import word_tokens
from formwright.operators.classify import N_TYPES, SLOTS, slot_of, softmax
from formwright.session import new_path

STEPS = 10
RATE = 8.0
#: How much of the weights each step takes back.
DECAY = 1e-4


def _zeros() -> Column:
    return F.array(*[F.lit(0.0)] * N_TYPES)


def slot_frequencies(docs: DataFrame) -> DataFrame:
    """(slot, idf): the inverse frequency of documents with a slot's tokens, smoothed by one more document with each."""
    slots = F.array_distinct(F.transform(word_tokens(F.col("text")), slot_of))
    counted = values_of(docs, slots, "slot").groupBy("slot").agg(F.count("*").alias("df"))
    total = docs.where(F.col("text").isNotNull()).agg(F.count("*").alias("n"))
    inverse = F.log((F.col("n") + 1.0) / (F.col("df") + 1.0)) + 1.0
    return counted.crossJoin(F.broadcast(total)).select("slot", inverse.alias("idf"))


def _one_row(by_slot: DataFrame, value: str, name: str) -> DataFrame:
    """(name): a map from slot to value, a single row of at most `SLOTS` entries."""
    entries = F.collect_list(F.struct("slot", value))
    return by_slot.agg(F.map_from_entries(F.array_sort(entries)).alias(name))


def with_features(docs: DataFrame, idf: DataFrame) -> DataFrame:
    """Adds `features`; NULL texts have none. Slots that no training text has are left out."""
    found = docs.crossJoin(F.broadcast(idf))
    slots = F.transform(word_tokens(F.coalesce("text", F.lit(""))), slot_of)

    def counted(sorted_slots: Column) -> Column:
        # In order, so that all of a slot's places follow its first one.
        firsts = F.filter(
            F.transform(sorted_slots, lambda s, i: F.struct(s.alias("slot"), i.alias("i"))),
            lambda x: (x["i"] == 0) | (F.get(sorted_slots, x["i"] - 1) != x["slot"]),
        )
        return let(
            firsts,
            lambda f: F.transform(
                f,
                lambda x, k: F.struct(
                    x["slot"].alias("slot"),
                    (
                        (F.coalesce(F.get(f, k + 1)["i"], F.size(sorted_slots)) - x["i"])
                        * F.coalesce(F.try_element_at(F.col("_idf"), x["slot"]), F.lit(0.0))
                    ).alias("value"),
                ),
            ),
        )

    def scaled(features: Column) -> Column:
        length = F.sqrt(F.aggregate(features, F.lit(0.0), lambda acc, x: acc + x["value"] * x["value"]))
        return let(
            length,
            lambda n: F.transform(features, lambda x: F.struct(x["slot"].alias("slot"), (x["value"] / n).alias("value"))),
        )

    weighted = let(F.array_sort(slots), counted)
    kept = F.filter(weighted, lambda x: x["value"] > 0)
    return found.withColumn("features", let(kept, scaled)).drop("_idf")


def _scores(features: Column, weights: Column, bias: Column) -> Column:
    def add(scores: Column, x: Column) -> Column:
        return F.zip_with(scores, F.coalesce(F.try_element_at(weights, x["slot"]), _zeros()), lambda s, w: s + w * x["value"])

    return F.aggregate(features, bias, add)


def _step(rows: DataFrame, model: DataFrame, rate: float, decay: float) -> DataFrame:
    """The model (weights, bias) after one more step; `rows` has features and label_id."""
    n = rows.agg(F.count("*").cast("double").alias("n"))
    scored = rows.crossJoin(F.broadcast(model)).select(
        "features", "label_id", softmax(_scores(F.col("features"), F.col("weights"), F.col("bias"))).alias("p")
    )
    missing = F.transform("p", lambda p, k: F.when(k == F.col("label_id"), 1.0).otherwise(0.0) - p)
    # Slot -1 stands for the bias: it is in every document, with value one.
    parts = F.array_append(F.col("features"), F.struct(F.lit(-1).alias("slot"), F.lit(1.0).alias("value")))
    shares = scored.select(missing.alias("missing"), F.explode(parts).alias("x")).select("x.slot", "x.value", "missing")
    sums = shares.groupBy("slot").agg(*[F.sum(F.col("value") * F.get("missing", F.lit(k))).alias(f"g{k}") for k in range(N_TYPES)])
    gradient = sums.crossJoin(F.broadcast(n)).select(
        "slot", F.array(*[F.col(f"g{k}") * rate / F.col("n") for k in range(N_TYPES)]).alias("move")
    )
    moved = gradient.crossJoin(F.broadcast(model)).select(
        "slot",
        F.zip_with(
            F.when(F.col("slot") < 0, F.col("bias")).otherwise(F.coalesce(F.try_element_at("weights", F.col("slot")), _zeros())),
            F.col("move"),
            lambda w, m: w * F.when(F.col("slot") < 0, 1.0).otherwise(1.0 - decay) + m,
        ).alias("w"),
    )
    weights = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("slot") >= 0, F.struct("slot", "w")))))
    bias = F.coalesce(F.max(F.when(F.col("slot") < 0, F.col("w"))), _zeros())
    return moved.agg(weights.alias("weights"), bias.alias("bias"))


@dataclass(frozen=True)
class LogisticClassifier:
    """Weights (weights map<int, array<double>>, bias array<double>) and (_idf map<int, double>), one row each."""

    model: DataFrame
    idf: DataFrame

    @classmethod
    def fit(
        cls, labelled: DataFrame, path: str | None = None, steps: int = STEPS, rate: float = RATE, decay: float = DECAY
    ) -> LogisticClassifier:
        """Trains on (text, label_id) rows from weights of zero; each step's model is written below `path`, which must be new.

        Texts that are NULL and labels that are no type are left out. Without any row the weights stay zero.
        """
        spark = labelled.sparkSession
        path = path or new_path(spark, "logistic")
        usable = labelled.where(F.col("text").isNotNull() & F.col("label_id").between(0, N_TYPES - 1)).select("text", "label_id")
        _one_row(slot_frequencies(usable), "idf", "_idf").write.parquet(f"{path}/idf")
        idf = spark.read.parquet(f"{path}/idf")
        with_features(usable, idf).select("features", "label_id").write.parquet(f"{path}/features")
        rows = spark.read.parquet(f"{path}/features")
        start = spark.range(1).select(
            F.expr("map_from_arrays(CAST(array() AS array<int>), CAST(array() AS array<array<double>>))").alias("weights"),
            _zeros().alias("bias"),
        )
        start.write.parquet(f"{path}/model/0")
        for step in range(1, steps + 1):
            before = spark.read.parquet(f"{path}/model/{step - 1}")
            _step(rows, before, rate, decay).write.parquet(f"{path}/model/{step}")
        return cls(spark.read.parquet(f"{path}/model/{steps}"), idf)

    def save(self, path: str) -> None:
        self.model.write.parquet(f"{path}/model")
        self.idf.write.parquet(f"{path}/idf")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> LogisticClassifier:
        return cls(spark.read.parquet(f"{path}/model"), spark.read.parquet(f"{path}/idf"))

    def weight_rows(self) -> DataFrame:
        """(slot, label_id, weight); slot -1 is the bias."""
        entries = F.map_entries(F.map_concat("weights", F.create_map(F.lit(-1), F.col("bias"))))
        by_slot = self.model.select(F.explode(entries).alias("e")).select(F.col("e.key").alias("slot"), F.col("e.value").alias("w"))
        return by_slot.select("slot", F.posexplode("w").alias("label_id", "weight"))

    def with_probabilities(self, docs: DataFrame) -> DataFrame:
        """Adds `probabilities`, one per class in class order; NULL where the text is NULL. No shuffle."""
        found = with_features(docs, self.idf).crossJoin(F.broadcast(self.model))
        scores = softmax(_scores(F.col("features"), F.col("weights"), F.col("bias")))
        return found.select(*docs.columns, F.when(F.col("text").isNotNull(), scores).alias("probabilities"))
