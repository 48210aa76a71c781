"""Joins and filters that hold when one key has a third of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: At most this many keys are found hot and broadcast, whatever the input's size: more than can have a hundredth of the rows each.
HOT_KEYS = 128
#: The sketch of frequent keys tracks so many; a key with over a hundredth of the rows is never missed.
TRACKED = 4096
SALTS = 32


def hot_keys(df: DataFrame, key: str, share: float = 0.01) -> DataFrame:
    """The 64-bit hashes (column hot_key, at most HOT_KEYS rows) of keys with about `share` of the rows or more, by one mergeable sketch: no shuffle of rows."""
    top = df.where(F.col(key).isNotNull()).select(F.xxhash64(key).alias("_h")).agg(F.expr(f"approx_top_k(_h, {HOT_KEYS}, {TRACKED})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") >= F.col("n") * share).select(F.col("t.item").alias("hot_key"))


def salted_join(left: DataFrame, right: DataFrame, key: str, spread: Column, how: str = "left") -> DataFrame:
    """Join to `right` by key. Rows of `left` with a hot key go to SALTS tasks, by the hash of `spread`; the rows of `right`
    with such a key are repeated for it, so `right` should be the side with few rows a key. Columns other than `key` must differ.
    """
    hot = F.broadcast(hot_keys(left, key))
    is_hot = F.xxhash64(key) == F.col("hot_key")
    a = left.join(hot, is_hot, "left").withColumn("_salt", F.when(F.col("hot_key").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)).drop("hot_key")
    every = F.array(*[F.lit(i) for i in range(SALTS)])
    b = right.join(hot, is_hot, "left").withColumn("_salt", F.explode(F.when(F.col("hot_key").isNotNull(), every).otherwise(F.array(F.lit(0))))).drop("hot_key")
    return a.join(b, [key, "_salt"], how).drop("_salt")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, spread: Column) -> DataFrame:
    """Left join to `right`, which has one row a key at most: at most HOT_KEYS * SALTS of them are repeated."""
    return salted_join(left, right, key, spread)
