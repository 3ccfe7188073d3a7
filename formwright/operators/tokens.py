"""Token tags: ids for training, and entity spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from formwright.functions.arrays import let, rows_of
from formwright.vocabulary import BIO_TAGS, IGNORED_LABEL

#: Positions of a sequence that are looked at together in `spans_of_rows`.
BLOCK = 65_536


def tag_id(tag: Column) -> Column:
    """Position of a tag in the label list; unknown tags count as `O`, which is 0."""
    ids = F.create_map(*[x for i, name in enumerate(BIO_TAGS) for x in (F.lit(name), F.lit(i))])
    return F.coalesce(F.try_element_at(ids, tag), F.lit(0))


def encoded_tags(tokens: Column, tags: Column) -> Column:
    """One id per token; tokens past the end of the tags get the ignored label."""
    return F.transform(
        tokens,
        lambda _, i: F.when(i < F.size(tags), tag_id(F.get(tags, i))).otherwise(
            F.lit(IGNORED_LABEL)
        ),
    )


def bio_spans(tokens: Column, tags: Column, scores: Column) -> Column:
    """Entity spans of one sequence: array of (field_name, value, score, start, end).

    `B-` starts a span, `I-` of the same type goes on with it, anything else ends it; an `I-` that
    follows nothing of its type starts one. `start` and `end` are token positions, `value` the tokens
    joined by a blank, `score` their mean. The n-th place where a span starts and the n-th place
    where one ends belong together, so one look at each token and its neighbours is enough.
    """

    def goes_on(t: Column, i: Column) -> Column:
        """Whether token i continues the span of the token before it."""
        kind = F.substr(F.get(t, i), F.lit(3))
        before = F.get(t, i - 1)
        continues = F.get(t, i).startswith("I-") & (before != "O")
        return F.coalesce(continues & (F.substr(before, F.lit(3)) == kind), F.lit(False))

    def places(t: Column) -> Column:
        inside = F.filter(
            F.transform(t, lambda x, i: F.when(x != "O", i)), lambda i: i.isNotNull()
        )
        return let(
            inside,
            lambda at: let(
                F.filter(at, lambda i: ~goes_on(t, i)),
                lambda starts: let(
                    F.filter(at, lambda i: ~goes_on(t, i + 1)),
                    lambda ends: F.zip_with(starts, ends, lambda s, e: span(t, s, e)),
                ),
            ),
        )

    def span(t: Column, s: Column, e: Column) -> Column:
        n = e - s + 1
        part = F.slice(scores, s + 1, n)
        mean = F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x) / n
        return F.struct(
            F.substr(F.get(t, s), F.lit(3)).alias("field_name"),
            F.array_join(F.slice(tokens, s + 1, n), " ").alias("value"),
            mean.alias("score"),
            s.alias("start"),
            (e + 1).alias("end"),
        )

    return let(tags, places)


def span_rows(sequences: DataFrame) -> DataFrame:
    """(seq_id, field_name, value, score, start, end) of sequences (tokens, tags, scores)."""
    spans = bio_spans(F.col("tokens"), F.col("tags"), F.col("scores"))
    return rows_of(sequences, spans, "seq_id")


def token_rows(sequences: DataFrame, **arrays: Column) -> DataFrame:
    """(seq_id, pos, ...) with one row per token; `arrays` are parallel to `tokens`."""
    rows = F.transform(
        F.col("tokens"),
        lambda token, i: F.struct(
            i.alias("pos"),
            token.alias("token"),
            *[F.get(array, i).alias(name) for name, array in arrays.items()],
        ),
    )
    return rows_of(sequences, rows, "seq_id")


def spans_of_rows(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """(seq_id, field_name, value, score, start, end) of a table (seq_id, pos, token, tag, score), one row per token.

    The same spans as `span_rows` gives for arrays. A sequence is cut into blocks of `block` positions. Each block marks
    its starts by itself; one row per block carries on the last tag and the number of spans begun so far, and the parts
    of a span that crosses blocks are put together at the end. So no sequence lies in one task, however long.

    Positions are unique within a sequence and need not be dense: the token before is the one at the next smaller
    position. Null tags count as `O`; a null score makes its span's null; null tokens are left out of the value. Rows
    without a position belong to no span. Rows without a sequence id are one sequence. An empty table gives no rows.
    """
    by = ["no_id", "seq_id", "block"]
    kind = rows.schema["seq_id"].dataType
    none = F.lit("0").cast(kind)
    placed = rows.where(F.col("pos").isNotNull()).select(
        F.col("seq_id").isNull().alias("no_id"),
        F.coalesce("seq_id", none).alias("seq_id"),
        F.floor(F.col("pos") / block).cast("long").alias("block"),
        "pos",
        "token",
        F.coalesce("tag", F.lit("O")).alias("tag"),
        "score",
    )
    inner = Window.partitionBy(*by).orderBy("pos")
    marked = placed.withColumn("before", F.lag("tag").over(inner)).withColumn(
        "starts", _begins(F.col("tag"), F.col("before")).cast("long")
    )
    summed = marked.withColumn("begun", F.sum("starts").over(inner))
    edges = marked.groupBy(*by).agg(
        F.min_by("tag", "pos").alias("first"), F.max_by("tag", "pos").alias("last"), F.sum("starts").alias("n")
    )
    along = Window.partitionBy("no_id", "seq_id").orderBy("block")
    # The first token of a block was marked as if nothing came before it.
    carried = edges.withColumn("joined", (F.col("first") != "O") & ~_begins(F.col("first"), F.lag("last").over(along)))
    own = F.col("n") - F.col("joined").cast("long")
    earlier = F.coalesce(F.sum(own).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shifts = carried.select(*by, (earlier - F.col("joined").cast("long")).alias("shift"))
    inside = summed.where("tag <> 'O'").join(shifts, by).withColumn("span", F.col("begun") + F.col("shift"))
    item = F.struct("pos", "token", "score", F.substring("tag", 3, 1 << 20).alias("kind"))
    parts = inside.groupBy(*by, "span").agg(F.collect_list(item).alias("part"))
    spans = parts.groupBy("no_id", "seq_id", "span").agg(F.array_sort(F.flatten(F.collect_list("part"))).alias("items"))
    scores = F.aggregate("items.score", F.lit(0.0), lambda total, x: total + x) / F.size("items")
    return spans.select(
        F.when(~F.col("no_id"), F.col("seq_id")).alias("seq_id"),
        F.get("items.kind", F.lit(0)).alias("field_name"),
        F.array_join("items.token", " ").alias("value"),
        scores.alias("score"),
        F.get("items.pos", F.lit(0)).cast("int").alias("start"),
        (F.get("items.pos", F.size("items") - 1) + 1).cast("int").alias("end"),
    )


def _begins(tag: Column, before: Column) -> Column:
    """Whether a token begins a span, by its tag and the one before it (null at the beginning)."""
    goes_on = tag.startswith("I-") & (before != "O") & (F.substr(before, F.lit(3)) == F.substr(tag, F.lit(3)))
    return (tag != "O") & ~F.coalesce(goes_on, F.lit(False))
