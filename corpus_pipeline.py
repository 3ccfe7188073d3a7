"""From raw documents to packed training sequences.

Each stage reads what the one before it kept, written as Parquet, and all but the last return the columns of
documents. `run` writes the stages' tables to the shared folder.

Null and empty texts are scored, grouped and packed like any other; rows without an id are documents of their own
unless their text is that of another one; repeated rows count as one document from the second stage on. An empty
table stays empty through all stages. Columns beyond those of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.llm import decontaminate, packing, quality, repeats, simhash
from formwright.llm.common import table, written
from formwright.llm.queries import quality_model


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality network accepts."""
    return quality.accepted(docs, quality_model(spark, sf_dir))


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by the SimHash operator with its own shingles and bits."""
    return simhash.one_of_each(docs)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without word windows that occur elsewhere too; `n_chars` follows the text."""
    found = repeats.without_repeats(docs)
    return found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no benchmark item leaks into."""
    return decontaminate.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each run of a document's ids lies in the training sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality", good_quality),
    ("near_duplicates", without_near_duplicates),
    ("repeats", without_repeats),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: A trained network and a tokenizer take part, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
