"""Language of web pages by Bayesian fusion of several kinds of evidence.

- The text: byte trigrams of the visible text, scored by models that are counted over all documents of each
  language.
- The markup's declared language and the address's suffix: how often each occurs with each language, counted
  over all pages by what their texts alone say.
- The host: the share of each language among its other pages, smoothed towards its domain's share, and that
  towards the whole crawl's. All of it is grouped aggregation of the texts' probabilities.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.llm.common import UPPER_TO_LOWER, U64, arrow_schema, as_batches, join_counted, map_rows, text_bytes, written
from formwright.llm.url_filters import url_host

LANGUAGES = ("de", "en", "es", "fr")
#: Trigrams are counted in so many cells.
CELLS = 1 << 13
#: Neighbouring trigrams share bytes; each counts for so much of an independent one.
TEMPER = 0.3
#: Pages that a domain's, and the whole crawl's, shares count for in smoothing.
HOST_WEIGHT, DOMAIN_WEIGHT, OTHER_WEIGHT = 5.0, 20.0, 1.0
#: Bytes of a text at a time.
BLOCK = 1 << 20

_NOT_LETTERS = bytes(i for i in range(128) if not (65 <= i <= 90 or 97 <= i <= 122))
_LETTERS = bytes.maketrans(_NOT_LETTERS, b" " * len(_NOT_LETTERS))
_HIDDEN = re.compile(rb"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^<>]*>|&#?\w+;")
_DECLARED = re.compile(rb"(?is)<html\b[^<>]*?\blang\s*=\s*[\"']?\s*([a-z]+)")


def trigram_cells(text: bytes) -> np.ndarray:
    """How often each cell's trigrams occur; letters in lower case, anything else in ASCII a single blank."""
    data = b" ".join(text.translate(_LETTERS).translate(UPPER_TO_LOWER).split())
    out = np.zeros(CELLS, np.int64)
    if not data:
        return out
    raw = np.frombuffer(b" " + data + b" ", np.uint8)
    for i in range(0, len(raw) - 2, BLOCK):
        part = raw[i : i + BLOCK + 2].astype(np.uint32)
        code = (part[:-2] << np.uint32(16)) | (part[1:-1] << np.uint32(8)) | part[2:]
        out += np.bincount((code * np.uint32(2654435761)) >> np.uint32(19), minlength=CELLS)
    return out


def visible(html: bytes) -> bytes:
    return _HIDDEN.sub(b" ", html)


def declared(html: bytes) -> str | None:
    found = _DECLARED.search(html)
    return found[1][:2].decode().lower() if found else None


def train(docs: DataFrame, languages: tuple[str, ...] = LANGUAGES, lang: str = "lang", text: str = "text") -> np.ndarray:
    """(languages, CELLS): log probabilities of the cells, counted over all documents of each language.

    Documents of other languages, and null ones, are left out. A language without documents is uniform.
    """
    names = {name: i for i, name in enumerate(languages)}
    schema = "lang int, cell int, n long"
    target = arrow_schema(docs.sparkSession, schema)

    def run(batches):
        counts = np.zeros((len(names), CELLS), np.int64)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                counts[names[name]] += trigram_cells(content.as_py())
        at, cell = np.nonzero(counts)
        yield from as_batches({"lang": at, "cell": cell, "n": counts[at, cell]}, target)

    source = docs.where(F.col(lang).isin(*languages)).select(F.col(lang), text_bytes(text))
    # At most CELLS rows a language reach the driver.
    sums = source.mapInArrow(run, schema).groupBy("lang", "cell").agg(F.sum("n").alias("n")).toArrow()
    counts = np.full((len(languages), CELLS), 0.5)
    counts[sums["lang"].to_numpy(), sums["cell"].to_numpy()] += sums["n"].to_numpy()
    return np.log(counts / counts.sum(1, keepdims=True))


def _sum_columns(prefix: str, source: str, n: int) -> list[Column]:
    return [F.sum(F.col(source)[i]).alias(f"{prefix}{i}") for i in range(n)]


def _share(parts: str, count: str, parent: list[Column], weight: float, n: int) -> list[Column]:
    return [(F.col(f"{parts}{i}") + weight * parent[i]) / (F.col(count) + weight) for i in range(n)]


def identify(
    pages: DataFrame,
    model: np.ndarray,
    languages: tuple[str, ...] = LANGUAGES,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
) -> DataFrame:
    """(page_id, lang, probability, text_lang, declared_lang, host), a row for each row of `pages`.

    `lang` is the most probable language, of equally probable ones the first in `languages`. Pages without
    visible text (null and empty ones) go by the other evidence. Null and incomplete URLs share the empty
    host. Repeated rows each count; an empty table gives an empty result.
    """
    k = len(languages)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def rows(columns):
        out = {"page_id": columns["page_id"], "host": columns["host"], "ll": [], "q": [], "declared_lang": []}
        for content in columns["html"]:
            ll = TEMPER * (shared.value @ trigram_cells(visible(content)))
            q = np.exp(ll - ll.max())
            out["ll"].append(ll - ll.max())
            out["q"].append(q / q.sum())
            out["declared_lang"].append(declared(content))
        return out

    source = pages.select(
        F.col(page_id).cast("long").alias("page_id"), url_host(F.col(url)).alias("host"), text_bytes(html).alias("html")
    )
    read = map_rows(
        source, rows, "page_id long, host string, ll array<double>, q array<double>, declared_lang string"
    )
    said = F.when(F.col("declared_lang").isin(*languages), F.col("declared_lang")).otherwise(
        F.when(F.col("declared_lang").isNotNull(), F.lit("other")).otherwise(F.lit("none"))
    )
    read = written(read.withColumn("said", said), "page-evidence")
    # Declared languages: k + 2 rows at most.
    by_said = {r["said"]: r for r in read.groupBy("said").agg(*_sum_columns("s", "q", k)).collect()}
    whole = [sum(r[f"s{i}"] for r in by_said.values()) for i in range(k)]
    pages_n = sum(whole)
    crawl = [(whole[i] + 1.0) / (pages_n + k) for i in range(k)]
    kinds = [*languages, "other", "none"]
    says = [
        F.create_map(
            *[
                c
                for s in kinds
                for c in (
                    F.lit(s),
                    F.lit(float(np.log(((by_said[s][f"s{i}"] if s in by_said else 0.0) + OTHER_WEIGHT / len(kinds)) / (whole[i] + OTHER_WEIGHT)))),
                )
            ]
        )[F.col("said")]
        for i in range(k)
    ]
    hosts = read.groupBy("host").agg(F.count("*").alias("n"), *_sum_columns("h", "q", k))
    labels = F.split("host", r"\.")
    hosts = written(
        hosts.withColumns(
            {"domain": F.substring_index("host", ".", -2), "suffix": F.element_at(labels, -1)}
        ),
        "hosts",
    )
    sums = lambda by, to: hosts.groupBy(by).agg(
        F.count("*").alias("hosts"), F.sum("n").alias(f"{to}n"), *[F.sum(f"h{i}").alias(f"{to}{i}") for i in range(k)]
    )
    known = join_counted(hosts, sums("domain", "d"), ["domain"], "hosts").drop("hosts")
    known = join_counted(known, sums("suffix", "t"), ["suffix"], "hosts").drop("hosts")
    domain = _share("d", "dn", [F.lit(c) for c in crawl], DOMAIN_WEIGHT, k)
    suffixes = hosts.select(F.count_distinct("suffix")).first()[0] or 1
    known = known.select(
        "host",
        "n",
        *[F.col(f"h{i}") for i in range(k)],
        *[domain[i].alias(f"p{i}") for i in range(k)],
        *[F.log((F.col(f"t{i}") + 1.0 / suffixes) / F.lit(whole[i] + 1.0)).alias(f"x{i}") for i in range(k)],
    )
    joined = join_counted(read, written(known, "host-shares"), ["host"], "n")
    # The page's own text is taken out of its host's share: it counts once.
    prior = [
        F.log(
            (F.greatest(F.col(f"h{i}") - F.col("q")[i], F.lit(0.0)) + HOST_WEIGHT * F.col(f"p{i}"))
            / (F.col("n") - 1 + HOST_WEIGHT)
        )
        for i in range(k)
    ]
    total = [F.col("ll")[i] + says[i] + F.col(f"x{i}") + prior[i] for i in range(k)]
    fused = joined.withColumn("total", F.array(*total))
    top = F.array_max("total")
    parts = F.aggregate(F.transform("total", lambda v: F.exp(v - top)), F.lit(0.0), lambda a, b: a + b)
    name = lambda at: F.element_at(F.array(*map(F.lit, languages)), at.cast("int"))
    return fused.select(
        "page_id",
        name(F.array_position("total", top)).alias("lang"),
        (F.lit(1.0) / parts).alias("probability"),
        name(F.array_position("q", F.array_max("q"))).alias("text_lang"),
        "declared_lang",
        "host",
    )
