"""Resolution of not-modified revisit records in web archives.

A revisit that says "not modified" carries no body: it stands for the latest earlier full response of the same
canonical URL. Records are first reduced to one row for each URL and instant, then an as-of join finds that
response: within a time bucket by a window over its instants, across buckets by the last response of each. No
window holds more than a bucket's instants or a URL's buckets, however often a URL was captured.

The response is taken if the revisit's validators agree with it, and the revisit's headers update it, as far
as that is permitted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from formwright.llm.common import written

BUCKET_SECONDS = 3600
#: The header fields that a not-modified response may update.
PERMITTED = ("age", "cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
DEFAULT_PORTS = {"http": "80", "https": "443"}


def canonical_url(url: Column) -> Column:
    """Scheme and host in lower case, without default port and fragment, with `/` for an empty path.

    A URL without `://` stays as it is; null stays null.
    """
    part = r"(?s)^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^?#]*)(\?[^#]*)?(#.*)?$"
    scheme, host = F.lower(F.regexp_extract(url, part, 1)), F.lower(F.regexp_extract(url, part, 2))
    for name, port in DEFAULT_PORTS.items():
        host = F.when(scheme == name, F.regexp_replace(host, f":{port}$", "")).otherwise(host)
    path = F.regexp_extract(url, part, 3)
    path = F.when(path == "", F.lit("/")).otherwise(path)
    joined = F.concat(scheme, F.lit("://"), host, path, F.regexp_extract(url, part, 4))
    return F.when(url.rlike(part), joined).otherwise(url)


def lower_names(headers: Column) -> Column:
    """The headers with names in lower case, without null values; of fields that then coincide the
    one holds whose own name sorts last.
    """
    entries = F.transform(
        F.sort_array(F.map_entries(F.map_filter(headers, lambda k, v: v.isNotNull()))),
        lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")),
    )
    last = F.filter(
        entries,
        lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda x: x["key"] == e["key"]),
    )
    return F.coalesce(F.map_from_entries(last), F.expr("cast(map() AS map<string, string>)"))


def _opaque(tag: Column) -> Column:
    """An entity tag for weak comparison."""
    return F.regexp_replace(F.trim(tag), "^W/", "")


def resolve(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row for each revisit: (record_id, url, ts, response_id, status, headers).

    `records` has record_id (bigint), url, ts (timestamp), kind (`response` or `revisit`), http_status and headers
    (map of strings); other columns are ignored. Full responses are those of kind `response` with status 200.
    The response of a revisit is the latest strictly earlier one of its canonical URL; of several at one
    instant, that with the greatest id. `status` is

    - `no_response` where there is none, or where url or ts is null,
    - `no_validator` where the revisit has neither entity tag nor modification date,
    - `mismatch` where its entity tag (compared weakly), or without one its date, differs from the response's,
    - `resolved` otherwise; `headers` is then the response's, updated by the revisit's permitted fields.

    In the other cases `headers` is the revisit's own. Repeated records each have their row; an empty table gives
    an empty result.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    named = written(
        records.select(
            F.col("record_id").cast("long").alias("record_id"),
            canonical_url(F.col("url")).alias("url"),
            F.col("ts").cast("timestamp").alias("ts"),
            micros.alias("at"),
            (F.col("kind") == "revisit").alias("is_revisit"),
            ((F.col("kind") == "response") & (F.col("http_status") == 200)).alias("is_full"),
            lower_names(F.col("headers")).alias("headers"),
        ),
        "archive-records",
    )
    known = named.where("url IS NOT NULL AND ts IS NOT NULL AND (is_revisit OR is_full)")
    response = F.struct(F.col("record_id").alias("id"), F.col("headers").alias("headers"))
    full = F.when(F.col("is_full"), F.coalesce("record_id", F.lit(-1)))
    instants = written(
        known.groupBy("url", "at")
        .agg(F.max_by(F.when(F.col("is_full"), response), full).alias("full"), F.max("is_revisit").alias("asks"))
        .withColumn("bucket", F.floor(F.col("at") / (bucket_seconds * 1_000_000))),
        "instants",
    )
    buckets = instants.groupBy("url", "bucket").agg(
        F.max_by("full", F.when(F.col("full").isNotNull(), F.col("at"))).alias("last")
    )
    earlier = W.partitionBy("url").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = buckets.select("url", "bucket", F.last("last", ignorenulls=True).over(earlier).alias("carried"))
    within = W.partitionBy("url", "bucket").orderBy("at").rowsBetween(W.unboundedPreceding, -1)
    answers = (
        instants.withColumn("near", F.last("full", ignorenulls=True).over(within))
        .where("asks")
        .join(carried, ["url", "bucket"])
        .select("url", "at", F.coalesce("near", "carried").alias("full"))
    )
    asked = named.where("is_revisit").join(answers, ["url", "at"], "left")
    own, found = F.col("headers"), F.col("full.headers")
    tag, date = own["etag"], own["last-modified"]
    agrees = F.when(tag.isNotNull(), _opaque(tag) == _opaque(found["etag"])).otherwise(
        F.trim(date) == F.trim(found["last-modified"])
    )
    status = (
        F.when(F.col("full").isNull(), "no_response")
        .when(tag.isNull() & date.isNull(), "no_validator")
        .when(F.coalesce(agrees, F.lit(False)), "resolved")
        .otherwise("mismatch")
    )
    updates = F.map_filter(own, lambda k, v: k.isin(*PERMITTED))
    merged = F.map_concat(
        F.map_filter(found, lambda k, v: ~F.array_contains(F.map_keys(updates), k)), updates
    )
    return asked.withColumn("status", status).select(
        "record_id",
        "url",
        "ts",
        F.col("full.id").alias("response_id"),
        "status",
        F.when(F.col("status") == "resolved", merged).otherwise(own).alias("headers"),
    )
