"""Rows from arrays, and folds over long ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


#: A fold that grows an array copies it at each step; so long arrays are folded in pieces of this size.
CHUNK = 128


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """`use` of a value that is evaluated once, however often `use` names it, also inside lambdas."""
    return F.transform(F.array(value), use)[0]


def chunks(array: Column) -> Column:
    """The pieces of CHUNK elements of an array (bound by let, or a plain column), the last one shorter; an empty array has none."""
    n = F.size(array)
    each = F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / CHUNK).cast("int"), F.lit(0))), lambda k: F.slice(array, k * CHUNK + 1, F.lit(CHUNK)))
    return F.when(n > 0, each).otherwise(F.slice(each, F.lit(1), F.lit(0)))


def rows_of(df: DataFrame, array: Column, *keep: str | Column, item: str = "item", ordinal: str = "ordinal") -> DataFrame:
    """keep..., ordinal (from 0), item: a row an element, also for null elements; none for null and empty arrays.

    A plain explode makes the optimizer put a filter on the array's size below, which computes the array, however costly,
    once more for each reference in it. An outer one with a filter on the ordinal doesn't.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(ordinal, item)).where(F.col(ordinal).isNotNull())
