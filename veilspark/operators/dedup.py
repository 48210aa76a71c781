"""Messages delivered more than once: exactly one copy of each stays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .bloom import mark_absent


def _first(order: list[Column]) -> Column:
    """A struct whose least value is the first row; null comes last in each field."""
    return F.struct(*[f for i, c in enumerate(order) for f in (c.isNull().alias(f"n{i}"), c.alias(f"o{i}"))])


def keep_one(df: DataFrame, key: Column, order: list[Column]) -> DataFrame:
    """One whole row of each key: the first by `order`, nulls last; rows that tie in all of `order` are told apart by their content.

    Hash aggregation with min_by over a struct, so copies meet map-side before the shuffle and a key with a third of all
    rows is one partial row a task. Rows with a null key are no copies of anything and all stay. Columns keep their names
    and order, whatever they are called; columns of a map type are carried along but don't break ties. An empty table stays empty.
    """
    plain = [c for c, t in df.dtypes if "map<" not in t and t != "variant"]
    work = df.select(key.alias("_k"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.struct(_first(order).alias("by"), F.xxhash64(*[F.col(f"`{c}`") for c in plain]).alias("tie")).alias("_by"))
    once = work.where(F.col("_k").isNotNull()).groupBy("_k").agg(F.min_by("_row", "_by").alias("_row"))
    return once.select("_row.*").unionByName(work.where(F.col("_k").isNull()).select("_row.*"))


def copies_to_drop(df: DataFrame, key: Column, order: list[Column], row_id: str) -> DataFrame:
    """The ids of the rows that keep_one would drop. `row_id` is unique and must be the last of `order`'s ties.

    1. Rows are counted by a 64-bit hash of the key, by hash aggregation over numbers alone.
    2. A Bloom filter of the hashes that occur more than once takes all rows away that are surely the only one of their key.
    3. Of those left, min_by over a struct finds the winner of each key (copies meet map-side, so a hot key is one partial row a
       task), and an anti-join on the unique id, which has no hot key, gives the rest. A key alone that came through wins by itself.
    """
    ids = df.select(key.alias("_k"), _first([*order, F.col(row_id)]).alias("_by"), F.col(row_id)).where(F.col("_k").isNotNull())
    counted = df.select(F.xxhash64(key).alias("_h"), key.isNotNull().alias("_is")).where("_is").groupBy("_h").agg(F.count("*").alias("_n"))
    several = cut(counted.where(F.col("_n") > 1).select("_h"))  # for its number and for the filter
    some = cut(mark_absent(ids.withColumn("_h", F.xxhash64("_k")), "_h", several, "_h", "_alone").where(~F.col("_alone")).select("_k", "_by", row_id))
    winners = some.groupBy("_k").agg(F.min_by(row_id, "_by").alias(row_id)).select(row_id)
    return some.select(row_id).join(winners, row_id, "left_anti")
