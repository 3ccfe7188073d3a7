"""Weights of the composite confidence as a table, one set for each provider."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from formwright import vocabulary as v

#: A table of sets up to this size, counted, is sent to all executors; larger ones are joined by key.
BROADCAST_BYTES = 8 << 20
#: Into so many parts the documents of a provider are dealt in a join by key.
SALTS = 32
#: What a set takes besides its provider's name.
_SET_BYTES = 64


def provider_weights(weights: DataFrame) -> DataFrame:
    """(provider, weights) from rows (provider, part, weight); parts are the names of the default weights.

    A set whose sum is more than 0.01 from 1 is divided by it. Rows for one part of a provider add up, a part without
    rows and a NULL weight count 0, other parts and rows without a provider are left out. A set of sum 0 gives no row.
    """
    parts = tuple(v.DEFAULT_WEIGHTS)
    known = weights.where(F.col("provider").isNotNull() & F.col("part").isin(*parts))
    summed = known.groupBy("provider", "part").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("weight"))
    whole = F.sum("weight").over(Window.partitionBy("provider"))
    share = F.when(F.abs(F.col("whole") - 1.0) > 0.01, F.col("weight") / F.col("whole")).otherwise(F.col("weight"))
    shares = summed.withColumn("whole", whole).where("whole <> 0").withColumn("share", share)
    named = [
        F.coalesce(F.max(F.when(F.col("part") == part, F.col("share"))), F.lit(0.0)).alias(part) for part in parts
    ]
    return shares.groupBy("provider").agg(*named).select("provider", F.struct(*parts).alias("weights"))


def with_weights(
    docs: DataFrame,
    weights: DataFrame,
    provider: str = "provider",
    key: str = "doc_id",
    name: str = "weights",
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Adds the document's provider's weights as `name`; the default ones where the provider is NULL or has none.

    A table beyond `broadcast_bytes` is joined by provider and a part of `key`'s hash, with a copy of each set for each
    part, so that a provider with most of the documents is spread over tasks.
    """
    defaults = F.struct(*[F.lit(float(w)).alias(part) for part, w in v.DEFAULT_WEIGHTS.items()])
    sets = provider_weights(weights).select(F.col("provider").alias("_provider"), F.col("weights").alias("_weights"))
    size = sets.agg(F.sum(F.octet_length(F.col("_provider").cast("string")) + _SET_BYTES)).first()[0] or 0
    same = F.col(provider) == F.col("_provider")
    if size <= broadcast_bytes:
        joined = docs.join(F.broadcast(sets), same, "left")
    else:
        dealt = docs.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
        copies = sets.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        # Spark takes the copies for no more than the sets and would send them all through the driver.
        joined = dealt.join(copies.hint("merge"), same & (F.col("_salt") == F.col("_part")), "left").drop("_salt", "_part")
    return joined.withColumn(name, F.coalesce("_weights", defaults)).drop("_provider", "_weights")
