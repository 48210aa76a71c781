"""Reading the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One Parquet file or folder of part files; filters and column choices reach its scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
