"""Arriving documents, and running metrics of processed ones."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from formwright.operators.evaluate import distribution


def arriving_files(
    spark: SparkSession, folder: str, name_glob: str, max_files: int | None = None
) -> DataFrame:
    """A stream of Parquet files; the schema is that of the files already there."""
    schema = spark.read.option("pathGlobFilter", name_glob).parquet(folder).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_glob)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(folder)


_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Times keep their microseconds on the way through a row's text.
_TEXT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "ignoreNullFields": "false"}
_LAST = (1 << 63) - 1


def first_arrivals(docs: DataFrame, remembered: str | None = None) -> DataFrame:
    """The rows of a stream, each `doc_id` once however often and late it comes.

    Of the copies in a batch the first by (`arrival`, null last; hash of the row) is taken. Nothing is dropped for its time:
    rows without one, or behind all others, are rows like any other. Rows without an id are told apart by all their
    columns. The state is a row a key, in RocksDB; a batch looks up its own keys and no others, so the stream's output mode
    is "update". With `remembered` (such as "30 days") a key is forgotten so long after its last row, which bounds the state
    and costs a scan of its times at each batch and a call of Python for each key; the output mode is "append" then. Give ids
    and paths, not images.
    """
    row = F.xxhash64(*docs.columns)
    keyed = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col("doc_id").cast("string")), F.concat(F.lit("#"), row.cast("string"))).alias("key"),
        F.coalesce(F.unix_micros("arrival"), F.lit(_LAST)).alias("moment"),
        row.alias("hash"),
        F.struct(*docs.columns).alias("row"),
    )
    if remembered:
        return _forgetting(keyed, docs, remembered)
    # Within a batch the current time is one value, so a key is new where the batches it came in have one time.
    seen = keyed.withColumn("batch", F.current_timestamp()).groupBy("key").agg(
        F.min("batch").alias("first"),
        F.max("batch").alias("last"),
        F.min_by("row", F.struct("moment", "hash")).alias("row"),
    )
    return seen.where(F.col("first") == F.col("last")).select("row.*")


def _forgetting(keyed: DataFrame, docs: DataFrame, remembered: str) -> DataFrame:
    """The rows of new keys; a key is forgotten some time after its last row."""
    spark = docs.sparkSession
    milliseconds = spark.sql(f"SELECT unix_millis(timestamp_seconds(0) + INTERVAL {remembered})").first()[0]

    def first(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        best = min(min(zip(f["moment"], f["hash"], f["row"])) for f in frames)
        known = state.exists
        state.update((True,))
        state.setTimeoutDuration(milliseconds)
        if not known:
            yield pd.DataFrame({"row": [best[2]]})

    texts = keyed.withColumn("row", F.to_json("row", _TEXT))
    timeout = GroupStateTimeout.ProcessingTimeTimeout
    found = texts.groupBy("key").applyInPandasWithState(first, "row string", "seen boolean", "append", timeout)
    return found.select(F.from_json("row", docs.schema, _TEXT).alias("row")).select("row.*")


def started(writer: DataStreamWriter, spark: SparkSession, partitions: int | None) -> StreamingQuery:
    """Starts a stream with its state in RocksDB, in so many partitions, which stay the same for its whole life."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": _ROCKSDB}
    if partitions:
        wanted["spark.sql.shuffle.partitions"] = str(partitions)
    before = {name: spark.conf.get(name) for name in wanted}
    try:
        for name, value in wanted.items():
            spark.conf.set(name, value)
        return writer.start()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)


def score_stream(
    docs: DataFrame,
    process: Callable[[DataFrame], DataFrame],
    failures: Callable[[DataFrame], DataFrame],
    path: str,
    delay: str = "1 day",
    remembered: str | None = None,
    partitions: int | None = None,
) -> StreamingQuery:
    """Processes what has arrived and stops; every document once, however late it comes (see `first_arrivals`).

    `docs` has doc_id, arrival and error. Under `path` go the tables `arrived` (the new documents of each batch),
    `results`, `failures`, and `late`, the ids of documents that came more than `delay` behind the latest one of
    earlier batches. Late documents are processed like any other. Each batch writes folders of its own number, so a
    batch that is run again after a failure replaces what it had written and nothing is doubled. A batch reads what
    arrived in it, and of earlier ones a single row: the latest arrival so far.
    """
    progress_schema = "latest timestamp"

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{path}/arrived/batch={number}")
        fresh = spark.read.schema(batch.schema).parquet(f"{path}/arrived/batch={number}")
        known = spark.createDataFrame([], progress_schema)
        if number:
            known = spark.read.schema(progress_schema).parquet(f"{path}/progress/{number - 1}")
        latest = known.first()
        before = F.lit(latest[0] if latest else None).cast("timestamp")
        late = fresh.where(F.col("arrival") < before - F.expr(f"INTERVAL {delay}"))
        tables = {
            "results": process(fresh.filter(F.col("error").isNull())),
            "failures": failures(fresh),
            "late": late.select("doc_id", "arrival"),
        }
        for name, rows in tables.items():
            rows.write.mode("overwrite").parquet(f"{path}/{name}/batch={number}")
        reached = known.unionByName(fresh.select(F.col("arrival").alias("latest"))).agg(F.max("latest").alias("latest"))
        reached.write.mode("overwrite").parquet(f"{path}/progress/{number}")

    writer = (
        first_arrivals(docs, remembered)
        .writeStream.foreachBatch(write)
        .outputMode("append" if remembered else "update")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
    )
    return started(writer, docs.sparkSession, partitions)


def accumulate(
    rows: DataFrame,
    measure: Callable[[DataFrame], DataFrame],
    keys: Sequence[str],
    path: str,
    again: Callable[[int], bool] = lambda number: False,
) -> StreamingQuery:
    """Keeps mergeable measures of all batches so far, and stops when all input is read; see `merge_batch`.

    `again` names batches that are run a second time, as after a failure between a batch's work and its commit.
    """

    def write(batch: DataFrame, number: int) -> None:
        for _ in range(2 if again(number) else 1):
            merge_batch(batch, number, measure, keys, path)

    return (
        rows.writeStream.foreachBatch(write)
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )


def merge_batch(
    batch: DataFrame, number: int, measure: Callable[[DataFrame], DataFrame], keys: Sequence[str], path: str
) -> None:
    """Adds a batch to the measures so far and writes them as the state of its number.

    `measure` gives a small table of `keys`, of sums, and of columns that begin with `min_` or `max_`. The state
    after a batch is that of the batch before it, merged with the batch's own, so a batch that is run again gives
    the same state again, and what is read follows the number of keys, not of batches.
    """
    spark = batch.sparkSession
    own = measure(batch)
    if number:
        own = own.unionByName(spark.read.schema(own.schema).parquet(f"{path}/state/batch={number - 1}"))
    kinds = {"min": F.min, "max": F.max}
    merged = [kinds.get(c.split("_")[0], F.sum)(c).alias(c) for c in own.columns if c not in keys]
    own.groupBy(*keys).agg(*merged).coalesce(1).write.mode("overwrite").parquet(f"{path}/state/batch={number}")


def accumulated(spark: SparkSession, path: str) -> DataFrame:
    """The measures of all batches so far: the last state. Only its folder is read."""
    states = spark.read.parquet(f"{path}/state")
    last = states.select("batch").agg(F.max("batch")).first()[0]
    return states.where(F.col("batch") == last).drop("batch")


def windowed_metrics(runs: DataFrame, width: str, delay: str = "1 day") -> DataFrame:
    """Metrics per tumbling window of `arrival`; rows later than the delay are dropped.

    `runs` has arrival, processing_time_seconds, confidence and user_corrections. State is one row of
    sums per open window.
    """
    return (
        runs.withWatermark("arrival", delay)
        .groupBy(F.window("arrival", width))
        .agg(
            F.count("*").alias("total_documents"),
            *distribution(F.col("processing_time_seconds"), "time"),
            F.avg("confidence").alias("average_confidence"),
            F.sum(F.coalesce("user_corrections", F.lit(0))).alias("total_corrections"),
        )
        .select(
            F.col("window.start").alias("window_start"),
            F.col("window.end").alias("window_end"),
            "total_documents",
            "average_time",
            "time_std",
            "min_time",
            "max_time",
            "average_confidence",
            "total_corrections",
        )
    )


def write_closed_windows(metrics: DataFrame, path: str) -> StreamingQuery:
    """Appends each window once it can no longer change, and stops when all input is read."""
    return (
        metrics.writeStream.outputMode("append")
        .format("parquet")
        .option("path", f"{path}/windows")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
