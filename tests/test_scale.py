"""How the work is dealt, on tables that are small to Spark."""

from pyspark.sql import functions as F

from formwright.operators.weights import with_weights
from formwright.plans import catalog
from formwright.plans import corpus as c
from formwright.sources import hooks, manifest, sinks
from formwright.streaming import arriving


def test_documents_are_made_by_many_tasks(spark, sf_dir, monkeypatch):
    """One file of keys is one task to Spark; the texts made of them are not."""
    monkeypatch.setattr(c, "ROWS_A_TASK", 100)
    sizes = c.runs(spark, sf_dir).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) == 15 and max(r["count"] for r in sizes) < 200
    monkeypatch.undo()
    assert c.orders(spark, sf_dir).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_batches_dealt_by_key_before_are_spread(spark, sf_dir):
    """A file with the keys of one remainder of their hash gave work to two of eight tasks."""
    dealt = c.table(spark, sf_dir, "orders").repartition(4, "o_orderkey").withColumn("file", F.spark_partition_id())
    for file in range(4):
        docs = c.batch_documents(dealt.where(F.col("file") == file))
        sizes = [r["count"] for r in docs.groupBy(F.spark_partition_id()).count().collect()]
        assert len(sizes) == spark.sparkContext.defaultParallelism and max(sizes) < sum(sizes) / 4


def test_first_arrivals_call_no_python(spark, tmp_path):
    """A stream of few large batches has as many keys as rows: a call of Python for each took most of the time."""
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(i % 3 or None, f"2024-01-0{1 + i % 5}", f"p{i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id int, arrival string, path string").withColumn("arrival", F.to_timestamp("arrival"))
    docs = docs.withColumn("error", F.lit(None).cast("string"))
    docs.coalesce(1).write.mode("append").parquet(folder)
    docs.withColumn("path", F.concat(F.lit("0"), "path")).coalesce(1).write.mode("append").parquet(folder)
    source = arriving.arriving_files(spark, folder, "*.parquet", 1)
    assert "Python" not in arriving.first_arrivals(source)._jdf.queryExecution().analyzed().toString()
    arriving.score_stream(source, lambda b: b.select("doc_id", "arrival", "path"), hooks.failures, out).awaitTermination()
    found = spark.read.parquet(f"{out}/results").collect()
    ids = sorted(r.doc_id for r in found if r.doc_id)
    assert ids == [1, 2] and len(found) == 2 + 20  # rows without an id: ten a file, told apart by their paths
    assert all(str(r.arrival.date()) == "2024-01-01" for r in found if r.doc_id)


def test_written_results_are_packed_and_read_once(spark, sf_dir, tmp_path):
    results = catalog.ENGINE.process(c.runs(spark, sf_dir).where("doc_id < 200"))
    path = str(tmp_path / "results")
    sinks.write_results(results, path)
    files = [f for f in (tmp_path / "results").rglob("part-*")]
    assert files and all(f.name.endswith(".json.gz") for f in files)
    texts = results.select(F.to_json(F.struct("*"))).collect()
    assert sum(f.stat().st_size for f in files) * 4 < sum(len(t[0]) for t in texts)
    back = sinks.read_results(spark, path, results.schema).select(results.columns)
    assert back.schema.simpleString() == results.schema.simpleString()
    assert back.exceptAll(results).count() == 0 and back.count() == results.count()


def test_many_sets_of_weights_are_not_broadcast(spark, tmp_path):
    """By its file the table is small; its sets, a copy for each part of the documents, are not."""
    part = F.element_at(F.array(F.lit("ocr"), F.lit("ner")), (F.col("id") % 2 + 1).cast("int"))
    path = str(tmp_path / "weights")
    spark.range(200_000).select((F.col("id") / 2).cast("long").alias("provider"), part.alias("part"), F.lit(1.0).alias("weight")).write.parquet(path)
    docs = spark.range(2000).select(F.col("id").alias("doc_id"), (F.col("id") % 7).alias("provider"))
    joined = with_weights(docs, spark.read.parquet(path), broadcast_bytes=1 << 20)
    assert {(r.provider, r.weights.ocr) for r in joined.collect()} == {(i, 0.5) for i in range(7)}
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_most_scans_are_packed(spark, sf_dir, tmp_path, monkeypatch):
    """A file for each order took a block of the disk for each; now their number does not grow with the orders."""
    monkeypatch.setattr(catalog, "new_path", lambda spark, name: str(tmp_path / name))
    monkeypatch.setattr(catalog, "LOOSE_BELOW", 40)
    found = {r.name: r.length for r in catalog.image_files(spark, sf_dir).collect()}
    pages = c.raw_pages(c.documents(spark, sf_dir)).where("doc_id % 4 <> 2").selectExpr("doc_id", "octet_length(raw) AS n").collect()
    kinds = ("jpg", "png", "txt", "jpeg")
    assert found == {f"page-{p.doc_id}.{kinds[p.doc_id % 4]}": p.n for p in pages}
    assert 0 < len(list((tmp_path / "scans").glob("page-*"))) <= 40
    assert sum(f.stat().st_size for f in (tmp_path / "packed-scans").rglob("*.parquet")) < 150 * 1500


def test_packed_files_read_like_files(spark, tmp_path):
    rows = [("a.png", b"\x00\xff"), ("b.jpg", b"j"), ("c.jpeg", b""), ("d.txt", b"no"), ("e.PNG", b"no"), ("jpg", b"no"), ("f.png.bak", b"no")]
    files = spark.createDataFrame(rows, "name string, content binary").repartition(3)
    loose, packed = str(tmp_path / "loose"), str(tmp_path / "packed")
    sinks.write_files(files, loose)
    sinks.pack_files(files, packed)
    names = F.substring_index("path", "/", -1).alias("name")
    images = [manifest.read_images(spark, loose), manifest.read_packed_images(spark, packed)]
    assert images[0].columns == images[1].columns
    got = [sorted(map(tuple, d.select(names, "length", "content").collect())) for d in images]
    assert got[0] == got[1] and [g[0] for g in got[0]] == ["a.png", "b.jpg"]
