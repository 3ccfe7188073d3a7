"""Which documents there are: path lists, image folders, and what is missing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from formwright.functions.text import strip
from formwright.vocabulary import IMAGE_ENDINGS, IMAGE_GLOB


def read_path_list(spark: SparkSession, list_file: str) -> DataFrame:
    """(path) from a text file, trimmed, blank lines dropped."""
    return spark.read.text(list_file).select(strip(F.col("value")).alias("path")).filter(
        F.col("path") != ""
    )


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modificationTime, length, content) of the images in a folder, not below it.

    Columns that are not used are not read: `select("path")` lists files only. Empty files are left out by Spark.
    """
    return spark.read.format("binaryFile").option("pathGlobFilter", IMAGE_GLOB).load(folder)


def read_packed_images(spark: SparkSession, folder: str) -> DataFrame:
    """The same for files packed into a table (see `sinks.pack_files`); contents that are not used are not read either."""
    packed = spark.read.parquet(folder)
    ending = F.substring_index("path", ".", -1)
    return packed.where(ending.isin(*IMAGE_ENDINGS) & F.col("path").contains(".") & (F.col("length") > 0))


def missing_inputs(manifest: DataFrame, scanned: DataFrame) -> DataFrame:
    """Manifest rows without a scanned file, as failures.

    Paths scanned several times are merged before the join.
    """
    absent = manifest.join(scanned.select("path").distinct(), "path", "left_anti")
    return absent.withColumns(
        {
            "error": F.concat(F.lit("Image file not found: "), F.col("path")),
            "status": F.lit("failed"),
        }
    )
