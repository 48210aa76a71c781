"""Readers: requests from files of several formats, the vault from a database."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = ("parquet", "orc", "json", "csv", "text")


def requests(spark: SparkSession, path: str, kind: str = "parquet", payload: str = "payload", schema: str | None = None) -> DataFrame:
    """One row a request with its text in `text`. A text file has a request a line; csv and json need a schema."""
    if kind not in FORMATS:
        raise ValueError(f"unknown format {kind}")
    reader = spark.read.schema(schema) if schema else spark.read
    df = reader.option("header", True).csv(path) if kind == "csv" else reader.format(kind).load(path)
    return df.withColumnRenamed("value" if kind == "text" else payload, "text")


def vault_over_jdbc(spark: SparkSession, url: str, table: str = "vault_entries", **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()


def health(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit("veilspark").alias("service"))
