"""Helpers for work inside a document row.

A document is one row, so everything that concerns one document is an expression over that row: no
shuffle, and nothing to skew. The helpers keep those expressions linear (or close to it) in the size
of the document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times in `body`.

    A column that is used several times may be inlined by the optimizer and then evaluated once per
    use; a lambda variable never is. The binding is the end of an aggregation over no elements, which
    is the cheapest form of it.
    """
    return F.aggregate(F.array().cast("array<int>"), value, lambda acc, _: acc, body)


def total(values: Column, zero: Column | None = None) -> Column:
    """Sum of an array (an int array unless `zero` says otherwise)."""
    return F.aggregate(values, F.lit(0) if zero is None else zero, lambda acc, x: acc + x)


_BLOCK = 1024


def _scan(values: Column, start: Column) -> Column:
    """`start` and the sums after each entry. Appending copies, so this is for short arrays."""
    return F.aggregate(
        values, F.array(start), lambda sums, x: F.array_append(sums, F.element_at(sums, -1) + x)
    )


def running_total(values: Column) -> Column:
    """For each entry of an int array, the sum of the entries before it; last, the sum of all.

    Long arrays are summed block by block, each from the total of the blocks before it, so that the
    work stays about linear for millions of entries.
    """

    def in_blocks(v: Column) -> Column:
        firsts = F.sequence(F.lit(1), F.size(v), F.lit(_BLOCK))
        blocks = F.transform(firsts, lambda first: F.slice(v, first, F.lit(_BLOCK)))
        return let(
            blocks, lambda b: let(_scan(sums_of(b), F.lit(0)), lambda s: joined(b, s))
        )

    def sums_of(blocks: Column) -> Column:
        return F.transform(blocks, lambda block: total(block))

    def joined(blocks: Column, bases: Column) -> Column:
        summed = F.transform(
            blocks,
            lambda block, j: F.slice(_scan(block, F.get(bases, j)), F.lit(1), F.size(block)),
        )
        return F.array_append(F.flatten(summed), F.element_at(bases, -1))

    return let(
        values, lambda v: F.when(F.size(v) <= _BLOCK, _scan(v, F.lit(0))).otherwise(in_blocks(v))
    )


def rows_of(df: DataFrame, array: str | Column, *keep: str | Column) -> DataFrame:
    """One row per element of an array of structs, with the struct's fields as columns.

    The outer form is used on purpose: for the inner form Spark infers `size(array) > 0` and pushes
    it to the scan, which evaluates the whole array expression a second time.
    """
    exploded = df.select(*keep, F.explode_outer(array).alias("_row"))
    kept = exploded.columns[:-1]
    return exploded.filter(F.col("_row").isNotNull()).select(*kept, "_row.*")


def values_of(df: DataFrame, array: str | Column, name: str, *keep: str | Column) -> DataFrame:
    """One row per non-NULL element of an array of plain values (see `rows_of`)."""
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())
