"""References to records that do not exist."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.running import running
from ..session import cut
from .bloom import mark_absent
from .skew import salted_left_join


def find_orphans(refs: DataFrame, targets: DataFrame, bloom_bits: int | None = None) -> DataFrame:
    """References without a valid target at their own time.

    refs: ref_field str, row_id long, key str, at timestamp. targets: key str, valid_from timestamp (null: always), valid_to
    timestamp (null: for ever); a target is valid from valid_from, itself included, until before valid_to. Both keys are
    already normalised, each space of keys with its own prefix. Result: ref_field, row_id, at, reason.

    reason is `missing` if no target has the key, else `late` if the first becomes valid after `at`, else `deleted`.
    Null keys refer to nothing and are no rows of the result. A reference without a time can only be `missing`. Repeated
    references each count. Other columns are ignored.

    1. A Bloom filter of all target keys, sized by their number, proves definite orphans without a shuffle (see bloom.mark_absent).
    2. Targets are pre-aggregated to one row a key; the filter's positives join it exactly, hot keys salted.
    3. Where only targets that end could still cover the reference, running maxima of their ends decide, in ranges of key and
       time with a prefix over the ranges: no pairs are formed, and neither a key nor a key's day has to fit into one task.
    """
    always = F.to_timestamp(F.lit("0001-01-01 00:00:00"))
    refs = refs.where(F.col("key").isNotNull()).select("ref_field", "row_id", "key", "at")
    targets = targets.where(F.col("key").isNotNull()).select("key", F.coalesce("valid_from", always).alias("valid_from"), "valid_to")
    tested = cut(mark_absent(refs, "key", targets, "key", "_absent", bloom_bits))  # read for the definite orphans, for hot keys and for the join
    missing = tested.where(F.col("_absent")).select("ref_field", "row_id", "key", "at", F.lit("missing").alias("reason"))

    per_key = targets.groupBy("key").agg(
        F.min("valid_from").alias("_first"),
        F.min(F.when(F.col("valid_to").isNull(), F.col("valid_from"))).alias("_open"),
        F.max("valid_to").alias("_last_end"),
    )
    row = F.struct("ref_field", "row_id")
    joined = salted_left_join(tested.where(~F.col("_absent")).drop("_absent"), per_key, "key", row)
    after_first, open_ = F.col("at") >= F.col("_first"), F.coalesce(F.col("at") >= F.col("_open"), F.lit(False))
    state = (
        F.when(F.col("_first").isNull(), "missing")
        .when(F.col("at").isNull() | open_, "valid")
        .when(~after_first, "late")
        .when(F.coalesce(F.col("at") >= F.col("_last_end"), F.lit(False)), "deleted")
        .otherwise("ends")
    )
    found = joined.withColumn("reason", state).where(F.col("reason") != "valid").select("ref_field", "row_id", "key", "at", "reason")
    judged = cut(missing.unionByName(found))  # few rows are left here, and two ways lead on
    clear = judged.where(F.col("reason") != "ends").select("ref_field", "row_id", "at", "reason")
    return clear.unionByName(_uncovered(judged.where(F.col("reason") == "ends"), targets.where(F.col("valid_to").isNotNull())))


def _uncovered(refs: DataFrame, closed: DataFrame) -> DataFrame:
    """References at whose time none of the key's closed intervals holds; all begin no later than their key's first interval."""
    wanted = closed.join(refs.select("key").distinct(), "key", "left_semi")
    events = refs.select("key", F.col("at").alias("t"), F.lit(1).alias("kind"), F.lit(None).cast("timestamp").alias("end"), "ref_field", "row_id").unionByName(
        wanted.select("key", F.col("valid_from").alias("t"), F.lit(0).alias("kind"), F.col("valid_to").alias("end")), allowMissingColumns=True)
    reached = running(events, ["key"], ["t", "kind", "ref_field", "row_id"], "end", "_reach", how="max").where(F.col("kind") == 1)
    covered = F.coalesce(F.col("_reach") > F.col("t"), F.lit(False))
    return reached.where(~covered).select("ref_field", "row_id", F.col("t").alias("at"), F.lit("deleted").alias("reason"))


def orphan_report(orphans: DataFrame) -> DataFrame:
    """Orphans per referring table, month of the referring row (yyyy-MM, null without a time), field and reason."""
    return orphans.groupBy(
        F.split_part("ref_field", F.lit("."), F.lit(1)).alias("ref_table"), "ref_field", F.date_format("at", "yyyy-MM").alias("month"), "reason"
    ).agg(F.count("*").alias("orphans"))
