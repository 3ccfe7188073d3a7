"""The registered queries of these operators, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.llm import (
    decontaminate,
    language,
    merkle,
    outliers,
    packing,
    quality,
    repeats,
    revisits,
    simhash,
    suffixes,
    toxicity,
    trie,
    url_filters,
)
from formwright.llm.common import map_rows, table, text_bytes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def query(run: Query) -> Query:
    QUERIES[run.__name__] = run
    return run


def id_fold(parts: int):
    """The checksum of the id as text, modulo `parts`."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(parts))


@query
def op1_url_filters(spark, sf_dir):
    rules = spark.createDataFrame(list(RULES), "host string, path string, action string")
    return url_filters.judge(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


def captures(pages: DataFrame) -> DataFrame:
    """Archive records that the pages' rows give: each page's response, and revisits before and after it.

    Revisits spell the URL differently; some have a weak entity tag, a wrong one, a date only, or nothing.
    """
    k = F.col("page_id")
    at = F.lit(1_700_000_000) + k * 7919 % 2_592_000
    tag = F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    date = F.concat(F.lit("day "), (k * 31 % 997).cast("string"))
    spelled = F.concat(F.regexp_replace("url", "^http", "HTTP"), F.lit("#again"))

    def record(number, kind, url, seconds, status, headers):
        return F.struct(
            (k * 4 + number).alias("record_id"),
            url.alias("url"),
            F.timestamp_seconds(seconds).alias("ts"),
            F.lit(kind).alias("kind"),
            F.lit(status).alias("http_status"),
            F.create_map(*[F.lit(x) if isinstance(x, str) else x for x in headers]).alias("headers"),
        )

    later = at + 3600 + k * 31 % 86_400
    weak = F.when(k % 3 == 0, F.concat(F.lit("W/"), tag)).otherwise(tag)
    rows = F.array(
        record(0, "response", F.col("url"), at, 200, ["ETag", tag, "Last-Modified", date, "Content-Type", "text/html"]),
        record(1, "revisit", spelled, later, 304, ["etag", weak, "Date", "later", "Content-Length", "0"]),
        record(
            2, "revisit", spelled, later + 60, 304,
            ["ETag", F.when(k % 5 == 0, F.lit('"other"')).otherwise(F.lit(None).cast("string")),
             "last-modified", F.when(k % 5 != 1, date), "Cache-Control", "no-cache"],
        ),
        record(3, "revisit", F.col("url"), at - F.when(k % 7 == 0, 60).otherwise(-60), 304, ["ETag", tag]),
    )
    return pages.select("page_id", "url", "html").select(F.inline(rows))


@query
def op2_revisits(spark, sf_dir):
    found = revisits.resolve(captures(table(spark, sf_dir, "pages")))
    lines = F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit(": "), e["value"]))
    return found.select(
        "record_id",
        "url",
        F.unix_seconds("ts").alias("moment"),
        "response_id",
        "status",
        F.array_join(F.sort_array(lines), "\n").alias("headers"),
    )


@query
def op3_outliers(spark, sf_dir):
    return outliers.judge(table(spark, sf_dir, "documents"))


@query
def op4_language(spark, sf_dir):
    model = language.train(table(spark, sf_dir, "documents"))
    return language.identify(table(spark, sf_dir, "pages"), model)


@query
def op5_decontaminate(spark, sf_dir):
    found = decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("k1", "k2")


def quality_model(spark: SparkSession, sf_dir: str) -> quality.Network:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality.train(docs, labels, "quality", id_fold(4) != 2)


@query
def op6_quality(spark, sf_dir):
    found = quality.scores(table(spark, sf_dir, "documents"), quality_model(spark, sf_dir), ["doc_id"])
    return _predicted(found, F.coalesce(id_fold(4) == 2, F.lit(False)), quality.THRESHOLD)


def _predicted(found: DataFrame, held_out, threshold: float) -> DataFrame:
    return found.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


@query
def op7_simhash(spark, sf_dir):
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "n_links")


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, "toxic", id_fold(5) != 0)
    found = toxicity.scores(docs, model, ["doc_id"])
    return _predicted(found, F.coalesce(id_fold(5) == 0, F.lit(False)), toxicity.THRESHOLD)


@query
def op9_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op10_repeats(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = repeats.with_intervals(docs, name="intervals")

    def rows(columns):
        out = {"doc_id": columns["doc_id"], "n_words": [], "n_removed": [], "kept_sha256": []}
        for text, intervals in zip(columns["text"], columns["intervals"]):
            n, kept = repeats.kept_words(text, intervals)
            out["n_words"].append(n)
            out["n_removed"].append(n - len(kept))
            out["kept_sha256"].append(hashlib.sha256(b" ".join(kept)).hexdigest())
        return out

    source = found.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"), "intervals")
    return map_rows(source, rows, "doc_id long, n_words long, n_removed long, kept_sha256 string")


@query
def op11_trie(spark, sf_dir):
    """The trie of conversations that begin with the first turns of every fifth one."""
    turns = trie.turns_of(table(spark, sf_dir, "conversations"))
    checksum = F.crc32(F.col("conv_id").cast("string").cast("binary"))
    rows, convs = trie.rebuilt(turns, F.col("conv_id") - F.col("conv_id") % 5, F.pmod(checksum, F.lit(9)), most=8)
    return trie.trie(rows, convs)


@query
def op12_suffixes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = suffixes.with_earlier(docs, name="intervals")

    def rows(columns):
        out = {"doc_id": columns["doc_id"], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": []}
        for text, intervals in zip(columns["text"], columns["intervals"]):
            kept = suffixes.kept_bytes(text, intervals)
            out["n_bytes"].append(len(text))
            out["n_removed"].append(len(text) - len(kept))
            out["n_spans"].append(len(intervals))
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
        return out

    source = found.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes("text").alias("text"), "intervals")
    return map_rows(source, rows, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


@query
def op13_merkle(spark, sf_dir):
    """Proofs of all documents; where 7 divides the id's checksum, the number of characters was tampered with."""
    tampered = F.when(id_fold(7) == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.proofs(table(spark, sf_dir, "documents"), changed={"n_chars": tampered})
