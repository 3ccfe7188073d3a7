"""Training data from JSON, checks on it, and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from formwright.sources.json_objects import BLOCK_BYTES, paired, read_arrays
from formwright.vocabulary import DOCUMENT_TYPES

_MODULUS = 2_147_483_647  # prime
_MULTIPLIER = 48_271


def read_labelled_texts(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, text, label) of a JSON object with parallel arrays `texts` and `labels`.

    Positions only one of the arrays has give NULL on the other side; see `label_violations`. The
    object is read as one row: `read_labelled_objects` reads larger ones.
    """
    data = spark.read.schema("texts array<string>, labels array<string>").json(path, multiLine=True)
    return data.select(F.posexplode(F.arrays_zip("texts", "labels")).alias("sample_id", "s")).select(
        "sample_id", F.col("s.texts").alias("text"), F.col("s.labels").alias("label")
    )


def read_labelled_objects(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, sample_id, text, label) of files with such an object each, every file read by several tasks.

    Positions only one of the arrays has give NULL on the other side.
    """
    both = paired(read_arrays(spark, path, block_bytes), "texts", "labels", "string")
    return both.select("path", F.col("pos").alias("sample_id"), F.col("texts").alias("text"), F.col("labels").alias("label"))


def read_sequence_objects(spark: SparkSession, path: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(path, seq_id, tokens, tags) of files with an object of token and tag lists each, every file read by several tasks."""
    both = paired(read_arrays(spark, path, block_bytes), "texts", "labels", "array<string>")
    named = both.select("path", F.col("pos").alias("seq_id"), F.col("texts").alias("tokens"), F.col("labels").alias("tags"))
    return _same_length(named)


def read_labelled_lines(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, text, label) of line-delimited JSON with these fields, read in parallel."""
    return spark.read.schema("sample_id bigint, text string, label string").json(path)


def read_sequence_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, tokens, tags) of line-delimited JSON with these fields, read in parallel."""
    return _same_length(
        spark.read.schema("seq_id bigint, tokens array<string>, tags array<string>").json(path)
    )


def _same_length(sequences: DataFrame) -> DataFrame:
    tags = F.when(F.size("tokens") == F.size("tags"), F.col("tags")).otherwise(
        F.raise_error(F.lit("texts and labels must have same length"))
    )
    return sequences.withColumn("tags", tags)


def label_violations(samples: DataFrame) -> DataFrame:
    """Samples that cannot be used, with the reason: unequal lengths, no integer, out of range."""
    label = F.col("label")
    problem = (
        F.when(F.col("text").isNull() | label.isNull(), "texts and labels must have same length")
        .when(~label.rlike(r"^-?\d+$"), "labels must be integers")
        .when(
            ~label.try_cast("bigint").between(0, len(DOCUMENT_TYPES) - 1),
            f"labels must be 0-{len(DOCUMENT_TYPES) - 1}",
        )
    )
    return samples.withColumn("problem", problem).filter(F.col("problem").isNotNull())


def checked_labels(samples: DataFrame) -> DataFrame:
    """(sample_id, text, label_id); a sample that cannot be used fails the job that reads it."""
    label = F.col("label").try_cast("int")
    usable = F.col("text").isNotNull() & label.between(0, len(DOCUMENT_TYPES) - 1)
    message = F.concat(F.lit("unusable training sample "), F.col("sample_id").cast("string"))
    return samples.select(
        "sample_id", "text", F.when(usable, label).otherwise(F.raise_error(message)).alias("label_id")
    )


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(seq_id, tokens, tags) of a JSON object with parallel arrays of token and tag lists."""
    schema = "texts array<array<string>>, labels array<array<string>>"
    data = spark.read.schema(schema).json(path, multiLine=True)
    pairs = F.when(F.size("texts") == F.size("labels"), F.arrays_zip("texts", "labels")).otherwise(
        F.raise_error(F.lit("texts and labels must have same length"))
    )
    return data.select(F.posexplode(pairs).alias("seq_id", "s")).select(
        "seq_id", F.col("s.texts").alias("tokens"), F.col("s.labels").alias("tags")
    )


def split_key(key: Column) -> Column:
    """A number below 2**31 - 1 that orders whole-number ids as if at random."""
    return F.pmod(key.cast("bigint"), F.lit(_MODULUS)) * _MULTIPLIER % _MODULUS


def split(samples: DataFrame, key: str, label: str | None = None) -> DataFrame:
    """Adds `is_train`: of each label exactly the first four fifths (rounded down) by `split_key`.

    A label may hold most of the data, so no label is sorted as a whole. Keys fall into 65,536 equal
    ranges; their counts tell in which range of a label the border lies, only that range is ranked,
    and the border itself (one row per label of a closed vocabulary) is what all samples are compared
    with. `key` is unique; keys that are not whole numbers are ordered by their hash.
    """
    whole_numbers = samples.schema[key].dataType.typeName() in ("byte", "short", "integer", "long")
    number = F.col(key) if whole_numbers else F.xxhash64(key)
    place = samples.withColumns(
        {"_label": F.col(label) if label else F.lit(0), "_key": split_key(number)}
    )
    ranges = place.groupBy("_label", F.shiftright("_key", 15).alias("_range")).agg(
        F.count("*").alias("n")
    )
    whole = Window.partitionBy("_label")
    upto = F.sum("n").over(whole.orderBy("_range"))
    quota = F.expr("total * 4 div 5")
    border_range = (
        ranges.withColumns({"upto": upto, "total": F.sum("n").over(whole)})
        .filter((F.col("upto") >= quota) & (F.col("upto") - F.col("n") < quota))
        .select("_label", "_range", (quota - (F.col("upto") - F.col("n"))).alias("take"))
    )
    in_range = place.select(
        "_label", "_key", F.col(key).alias("_id"), F.shiftright("_key", 15).alias("_range")
    ).join(border_range, ["_label", "_range"])
    rank = F.row_number().over(whole.orderBy("_key", "_id"))
    border = (
        in_range.withColumn("rank", rank)
        .filter(F.col("rank") == F.col("take"))
        .select("_label", F.struct("_key", "_id").alias("_border"))
    )
    is_train = F.struct("_key", F.col(key).alias("_id")) <= F.col("_border")
    return (
        place.join(border, "_label", "left")
        .withColumn("is_train", F.coalesce(is_train, F.lit(False)))
        .drop("_label", "_key", "_border")
    )
