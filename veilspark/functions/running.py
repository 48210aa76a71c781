"""Running sums over groups that may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..session import cut


def running(df: DataFrame, group: list[str], order: list[str], amount: str, out: str = "before", how: str = "sum") -> DataFrame:
    """`df` with `out`: the sum (0 where there are none) or, with how="max", the maximum (null) of `amount` over the rows of the
    same group that come before in `order`. For sums the order must be total.

    Rows are range-partitioned by group and order, so a group goes over as many tasks as it needs; a prefix over the ranges
    (one row a range) is added to what is before within the range. The ranges are written once, as both read them.
    """
    of = F.sum if how == "sum" else F.max
    placed = cut(df.repartitionByRange(*[F.col(c) for c in (*group, *order)]).withColumn("_range", F.spark_partition_id()))
    ahead = lambda w: w.rowsBetween(W.unboundedPreceding, -1)
    per = placed.groupBy(*group, "_range").agg(of(amount).alias("_s"))
    base = per.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_range").alias("_r"), of("_s").over(ahead(W.partitionBy(*group).orderBy("_range"))).alias("_base"))
    inner = placed.withColumn("_in", of(amount).over(ahead(W.partitionBy(*group, "_range").orderBy(*order))))
    same = F.col("_range") == F.col("_r")
    for i, c in enumerate(group):
        same = same & F.col(c).eqNullSafe(F.col(f"_g{i}"))
    zero = F.lit(0)
    both = F.coalesce("_base", zero) + F.coalesce("_in", zero) if how == "sum" else F.greatest("_base", "_in")
    return inner.join(base, same).withColumn(out, both).select(*df.columns, out)
