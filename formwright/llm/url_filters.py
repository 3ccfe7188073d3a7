"""URL filters: host-suffix and path-prefix expressions of each URL, matched with rules by hash.

A rule is a host and the beginning of a path. Its anchor is its path up to the last `/`. A URL's expressions
are its host and each of that host's parents, joined with each beginning of its path that ends in `/` and the
empty one. So if a rule fits a URL, the URL has an expression equal to the rule's host and anchor. Expressions
and anchors are joined on the first 32 bits of their SHA-256; the whole digest, and for rules that go on
after their anchor the path itself, then confirm the match.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import fresh

#: Hexadecimal digits of the digest that rules and expressions are joined on.
PREFIX_DIGITS = 8
#: Rules of one prefix that are held in one row.
RULES_TOGETHER = 256
#: Rules that take more than this are not broadcast by hint.
BROADCAST_BYTES = 8 << 20
DEFAULT_VERDICT = "allow"
#: Parts that the rows of one address are dealt into.
SALTS = 64


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z in lower case; empty if there is none."""
    host = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # Hosts have no "/" and anchors are empty or begin with one, so the two parts can be told apart.
    return F.sha2(F.concat(host, F.lit("\n"), path), 256)


def _rules(rules: DataFrame) -> DataFrame:
    """(prefix, digest, rule_host, rule_path, action), the strictest action for a rule given twice."""
    host, path = F.lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    named = (
        rules.select(host.alias("rule_host"), path.alias("rule_path"), F.lower("action").alias("action"))
        .where("rule_host <> '' AND action IN ('allow', 'block')")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("action").alias("action"))
    )
    anchor = F.regexp_extract("rule_path", r"(?s)^(.*/)?", 0)
    return named.withColumn("digest", _digest(F.col("rule_host"), anchor)).withColumn(
        "prefix", F.substring("digest", 1, PREFIX_DIGITS)
    )


def judge(
    pages: DataFrame, rules: DataFrame, url: str = "url", default: str = DEFAULT_VERDICT
) -> DataFrame:
    """The columns of `pages` and host, path, rule, verdict, for every row.

    `rules` has host, path and action (`allow` or `block`). A rule fits its host and all its subdomains if the
    URL's path starts with the rule's. Of the rules that fit, the one with the longest host and path together
    holds; of equally long ones the longer host, then `block`. Rules without a host or with another action
    are ignored; a rule given with both actions blocks. A URL that no rule fits gets `default`, and so does a
    null one and one without `://`, whose host and path are empty. Repeated rows each get their verdict.
    Existing columns of the four names are replaced.
    """
    made = ("host", "path", "rule", "verdict")
    kept = [c for c in pages.columns if c.lower() not in made]
    source = pages.select(*kept, *([] if url in kept else [F.col(url)]))
    host, path, salt, best = (fresh(source, n) for n in ("host", "path", "salt", "best"))
    # Equal addresses are judged once for each salt, and rows meet their verdict by it: a very frequent
    # address, or the empty one, is dealt over all salts.
    plain = [f.name for f in source.schema if f.dataType.typeName() not in ("map", "array", "struct", "variant")]
    parsed = source.withColumns(
        {
            host: url_host(F.col(url)),
            path: url_path(F.col(url)),
            salt: F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in plain]), F.lit(SALTS)),
        }
    )
    keys = parsed.where(F.col(host) != "").select(
        F.col(host).alias("host"), F.col(path).alias("path"), F.col(salt).alias("salt")
    )
    matches = _matches(keys, _rules(rules)).select(
        F.col("host").alias(host), F.col("path").alias(path), F.col("salt").alias(salt), F.col("best").alias(best)
    )
    joined = parsed.join(matches, [host, path, salt], "left")
    return joined.select(
        *kept,
        F.col(host).alias("host"),
        F.col(path).alias("path"),
        F.concat(f"{best}.rule_host", f"{best}.rule_path").alias("rule"),
        F.coalesce(f"{best}.action", F.lit(default)).alias("verdict"),
    )


def _matches(keys: DataFrame, rules: DataFrame) -> DataFrame:
    """(host, path, salt, best): for the distinct keys that a rule fits, that rule."""
    depth = (
        rules.groupBy("prefix")
        .agg(
            F.max(F.size(F.split("rule_host", r"\."))).alias("labels"),
            F.max(F.length(F.regexp_replace("rule_path", "[^/]", ""))).alias("slashes"),
            F.count("*").alias("n"),
            F.sum(F.octet_length("rule_host") + F.octet_length("rule_path") + 200).alias("bytes"),
        )
        .agg(F.max("labels").alias("labels"), F.max("slashes").alias("slashes"), F.max("n").alias("n"), F.sum("bytes").alias("bytes"))
        .first()
    )
    labels, slashes = depth["labels"] or 0, depth["slashes"] or 0
    # Rules that share a prefix lie in pieces of about so many, however many one directory has.
    pieces = -(-(depth["n"] or 1) // RULES_TOGETHER)
    piece = F.pmod(F.xxhash64("rule_host", "rule_path"), F.lit(pieces)).alias("piece")
    rule = F.struct("digest", "rule_host", "rule_path", "action")
    by_prefix = rules.groupBy("prefix", piece).agg(F.collect_list(rule).alias("rules")).drop("piece")
    if (depth["bytes"] or 0) <= BROADCAST_BYTES:
        by_prefix = F.broadcast(by_prefix)
    # Only as many labels and slashes as some rule has: the URL's own length does not matter.
    suffixes = F.expr(
        rf"transform(sequence(1, least(size(split(host, '[.]')), {max(labels, 1)})), i -> substring_index(host, '.', -i))"
    )
    prefixes = F.expr(
        f"transform(sequence(0, least(length(path) - length(replace(path, '/', '')), {slashes})), "
        "i -> CASE WHEN i = 0 THEN '' ELSE concat(substring_index(path, '/', i), '/') END)"
    )
    expressions = (
        keys.distinct()
        .select("host", "path", "salt", F.explode(suffixes).alias("suffix"), prefixes.alias("anchors"))
        .select("host", "path", "salt", "suffix", F.explode("anchors").alias("anchor"))
        .withColumn("digest", _digest(F.col("suffix"), F.col("anchor")))
        .withColumn("prefix", F.substring("digest", 1, PREFIX_DIGITS))
    )
    # The short prefix finds candidates; the whole digest and the path confirm them.
    near = expressions.join(by_prefix, "prefix").select("host", "path", "salt", "digest", F.explode("rules").alias("r"))
    found = near.where((F.col("digest") == F.col("r.digest")) & F.startswith(F.col("path"), F.col("r.rule_path")))
    rank = F.struct(
        (F.length("r.rule_host") + F.length("r.rule_path")).alias("size"),
        F.length("r.rule_host").alias("host_size"),
        (F.col("r.action") == "block").alias("blocks"),
        F.col("r.rule_host").alias("rule_host"),
        F.col("r.rule_path").alias("rule_path"),
        F.col("r.action").alias("action"),
    )
    return found.groupBy("host", "path", "salt").agg(F.max(rank).alias("best"))
