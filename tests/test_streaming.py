"""Streams against the same work on a batch."""

from pyspark.sql import functions as F

from formwright import DocumentEngine
from formwright.plans import catalog
from formwright.plans import corpus as c
from formwright.sources import hooks
from formwright.streaming import arriving


def test_stream_equals_batch(spark, sf_dir):
    streamed = catalog.stream_scores(spark, sf_dir)
    good = c.with_run(c.documents(spark, sf_dir)).filter("error is null").select("doc_id")
    batch = (
        catalog.engine(spark, sf_dir)
        .process(c.runs(spark, sf_dir).join(good, "doc_id", "left_semi"))
        .select(
            "doc_id",
            "document_type",
            F.col("confidence_summary.total_results").alias("total_results"),
            F.round("confidence_summary.average_confidence", 9).alias("average_confidence"),
        )
    )
    assert streamed.count() == batch.count()
    assert streamed.exceptAll(batch).count() == 0


def test_files_arriving_over_several_batches(spark, tmp_path):
    """Repeats across files are dropped, failures land in their table, a restart adds nothing."""
    folder = str(tmp_path / "in")
    schema = "doc_id int, text string, arrival timestamp, error string, path string, ocr_confidence double"

    def write(rows):
        df = spark.createDataFrame(rows, "doc_id int, text string, arrival string, error string")
        (df.select("doc_id", "text", F.col("arrival").cast("timestamp"), "error", F.lit("p").alias("path"),
                   F.lit(0.9).alias("ocr_confidence"))
         .coalesce(1).write.mode("append").parquet(folder))

    write([(1, "SSN 518-52-8063", "2024-01-01 00:00:00", None), (2, "x", "2024-01-01 01:00:00", "unreadable")])
    out = str(tmp_path / "out")
    engine = DocumentEngine(as_of="2026-01-01")

    def run():
        docs = arriving.arriving_files(spark, folder, "*.parquet", 1)
        arriving.score_stream(docs, engine.process, hooks.failures, out).awaitTermination()
        results = spark.read.parquet(f"{out}/results").select("doc_id", "extracted_fields").collect()
        failed = spark.read.parquet(f"{out}/failures").collect()
        return sorted(r.doc_id for r in results), sorted(r.doc_id for r in failed)

    assert schema
    assert run() == ([1], [2])
    write([(1, "again", "2024-01-01 02:00:00", None), (3, "12", "2024-01-01 03:00:00", None)])
    assert run() == ([1, 3], [2])
    assert run() == ([1, 3], [2])


def test_late_documents_are_processed_and_listed(spark, tmp_path):
    """The first file is days ahead of the second; nothing of the second is lost."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    for day, ids in (("2024-03-01", (1, 2)), ("2024-01-01", (3, 4, 2)), ("2024-03-02", (5,))):
        rows = [(i, f"{day} 0{i}:00:00") for i in ids]
        df = spark.createDataFrame(rows, "doc_id int, arrival string").withColumn("arrival", F.col("arrival").cast("timestamp"))
        df.withColumns({"error": F.lit(None).cast("string"), "path": F.lit("p")}).coalesce(1).write.mode("append").parquet(folder)
        arriving.score_stream(
            arriving.arriving_files(spark, folder, "*.parquet", 1), lambda b: b.select("doc_id"), hooks.failures, out
        ).awaitTermination()
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/results").collect()) == [1, 2, 3, 4, 5]
    assert sorted(r.doc_id for r in spark.read.parquet(f"{out}/late").collect()) == [3, 4]


def test_late_rows_are_dropped(spark, tmp_path):
    folder = str(tmp_path / "runs")

    def write(rows):
        df = spark.createDataFrame(rows, "arrival string, seconds double")
        (df.select(F.col("arrival").cast("timestamp"), F.col("seconds").alias("processing_time_seconds"),
                   F.lit(0.5).alias("confidence"), F.lit(None).cast("int").alias("user_corrections"))
         .coalesce(1).write.mode("append").parquet(folder))

    out = str(tmp_path / "out")

    def run():
        runs = arriving.arriving_files(spark, folder, "*.parquet", 1)
        arriving.write_closed_windows(
            arriving.windowed_metrics(runs, "1 day", "1 hour"), out
        ).awaitTermination()
        rows = spark.read.parquet(f"{out}/windows").orderBy("window_start").collect()
        return [(str(r.window_start.date()), r.total_documents, r.average_time) for r in rows]

    write([("2024-01-01 10:00:00", 2.0), ("2024-01-01 12:00:00", 4.0), ("2024-01-03 12:00:00", 6.0)])
    assert run() == [("2024-01-01", 2, 3.0)]
    write([("2024-01-01 11:00:00", 99.0), ("2024-01-05 12:00:00", 6.0)])
    assert run() == [("2024-01-01", 2, 3.0), ("2024-01-03", 1, 6.0)]
