"""OCR lines of a document and the text they make up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from formwright.functions.arrays import let, total
from formwright.functions.text import strip
from formwright.vocabulary import TEXT_LINE_CONFIDENCE, TEXT_ONLY_CONFIDENCE

LINES = (
    "array<struct<line_no:int,text:string,confidence:double,bbox:array<array<double>>>>"
)


def text_lines(raw: Column) -> Column:
    """Lines of a plain text as OCR lines: trimmed, blank ones dropped.

    The box comes from the line's place among all lines and its untrimmed length: 20 high, 10 wide
    for each character.
    """

    def line(text: Column, i: Column) -> Column:
        right = (F.length(text) * 10).cast("double")
        top, bottom = (i * 20).cast("double"), ((i + 1) * 20).cast("double")
        left = F.lit(0.0)
        return F.struct(
            i.alias("line_no"),
            strip(text).alias("text"),
            F.lit(TEXT_LINE_CONFIDENCE).alias("confidence"),
            F.array(
                F.array(left, top),
                F.array(right, top),
                F.array(right, bottom),
                F.array(left, bottom),
            ).alias("bbox"),
        )

    return F.filter(F.transform(F.split(raw, "\n", -1), line), lambda x: x["text"] != "")


def joined_text(lines: Column) -> Column:
    """Line texts joined by one blank, in array order."""
    return F.array_join(F.transform(lines, lambda x: x["text"]), " ")


def mean_confidence(lines: Column) -> Column:
    """Mean line confidence, 0 without lines; 0.8 where a source has text but no lines (NULL)."""

    def mean(c: Column) -> Column:
        return F.when(F.size(c) > 0, total(c, F.lit(0.0)) / F.size(c)).otherwise(F.lit(0.0))

    return F.when(lines.isNull(), F.lit(TEXT_ONLY_CONFIDENCE)).otherwise(
        let(F.transform(lines, lambda x: x["confidence"]), mean)
    )


def with_text(docs: DataFrame, lines: str = "lines") -> DataFrame:
    """Adds `text` and `ocr_confidence` from an array of lines; stays within the row.

    A source with text but no lines (NULL) keeps its text.
    """
    own = F.col("text") if "text" in docs.columns else F.lit(None).cast("string")
    text = F.when(F.col(lines).isNull(), own).otherwise(joined_text(F.col(lines)))
    return docs.withColumns({"text": text, "ocr_confidence": mean_confidence(F.col(lines))})


def assemble_text(lines: DataFrame, docs: DataFrame | None = None, block: int = 4096) -> DataFrame:
    """(doc_id, text, ocr_confidence) from a table of lines (doc_id, line_no, text, confidence).

    Lines are joined in blocks first, so that a document with very many lines is spread over tasks;
    only its few blocks meet at the end. `docs` (doc_id) adds documents that have no line.
    """

    def in_order(rows: Column, name: str) -> Column:
        return F.array_join(F.transform(F.sort_array(rows), lambda r: r[name]), " ")

    blocks = (
        lines.groupBy("doc_id", F.expr(f"line_no div {block}").alias("block"))
        .agg(
            F.collect_list(F.struct("line_no", "text")).alias("rows"),
            F.sum("confidence").alias("confidence"),
            F.count("confidence").alias("n"),
        )
        .select("doc_id", "block", in_order(F.col("rows"), "text").alias("text"), "confidence", "n")
    )
    if docs is not None:
        blocks = blocks.unionByName(docs.select("doc_id"), allowMissingColumns=True)
    return (
        blocks.groupBy("doc_id")
        .agg(
            F.collect_list(
                F.when(F.col("block").isNotNull(), F.struct("block", "text"))
            ).alias("rows"),
            F.sum("confidence").alias("confidence"),
            F.sum("n").alias("n"),
        )
        .select(
            "doc_id",
            in_order(F.col("rows"), "text").alias("text"),
            F.coalesce(F.col("confidence") / F.col("n"), F.lit(0.0)).alias("ocr_confidence"),
        )
    )
