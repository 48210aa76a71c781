"""The token vault: tokens for values, with the encrypted value and the transaction that owns it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import decrypt, encrypt, vault_token

SCHEMA = "token string, pii_type string, encrypted_value string, transaction_id string, created_at string"


def create_table(spark: SparkSession, name: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({SCHEMA}) USING parquet")


def new_entries(values: DataFrame, key: bytes) -> DataFrame:
    """Entries of values: pii_type, value, transaction_id, created_at. Null values have none. Ciphertexts differ at each evaluation: write once, then read."""
    v = values.where(F.col("value").isNotNull() & F.col("pii_type").isNotNull())
    return v.select(vault_token(F.col("pii_type"), F.col("value"), key).alias("token"), "pii_type", encrypt(F.col("value"), key).alias("encrypted_value"), "transaction_id", "created_at")


def upsert(entries: DataFrame, order: list[str]) -> DataFrame:
    """One entry a token: the last by `order` wins, with its transaction. Partial aggregates meet before the shuffle, so a token stored by a third of all rows is no hot spot."""
    rest = [c for c in entries.columns if c != "token"]
    last = F.max_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return entries.groupBy("token").agg(last.alias("e")).select("token", "e.*").select(*entries.columns)


def retrieve(tokens: DataFrame, vault: DataFrame, key: bytes, strict: bool = True) -> DataFrame:
    """token, value: null for an unknown token."""
    found = tokens.select("token").join(vault.select("token", "encrypted_value"), "token", "left")
    return found.select("token", decrypt(F.col("encrypted_value"), key, strict).alias("value"))


def retrieve_entries(tokens: DataFrame, vault: DataFrame) -> DataFrame:
    return tokens.select("token").join(vault, "token", "left")


def purge(vault: DataFrame, transactions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(what stays, how many entries each purged transaction had). A token stored again later belongs to the later transaction and stays."""
    gone = transactions.select("transaction_id").distinct()
    stays = vault.join(gone, "transaction_id", "left_anti").select(*vault.columns)
    counts = gone.join(vault.groupBy("transaction_id").agg(F.count("*").alias("purged")), "transaction_id", "left").select("transaction_id", F.coalesce("purged", F.lit(0)).alias("purged"))
    return stays, counts
