"""The scrub pipeline: numbers, cards, rules, merged spans, audit log. One narrow stage, no shuffle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import CITATIONS
from ..functions.arrays import let, rows_of
from . import detect, spans

ENTRY = "struct<count:int,cfr_citation:string>"


def citation(flag: Column) -> Column:
    """The regulation of a flag, or null."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in CITATIONS.items() for x in kv]), flag)


def flag_map(ssn: Column, pan: Column, merged: Column) -> Column:
    """Flag to (count, citation): numbers and cards by hit, other flags once for each merged span that has them."""
    names = F.flatten(F.transform(merged, lambda x: F.array_sort(x["f"])))
    entry = lambda name, n: F.struct(name.alias("key"), F.struct(n.cast("int").alias("count"), citation(name).alias("cfr_citation")).alias("value"))
    fixed = F.filter(F.array(F.struct(F.lit("HIPAA_SSN").alias("k"), ssn.alias("n")), F.struct(F.lit("PCI_PAN").alias("k"), pan.alias("n"))), lambda x: x["n"] > 0)
    counted = F.transform(F.array_distinct(names), lambda k: F.struct(k.alias("k"), F.size(F.filter(names, lambda x: x == k)).alias("n")))
    return F.map_from_entries(F.transform(F.concat(fixed, counted), lambda x: entry(x["k"], x["n"])))


def scrub(df: DataFrame, transaction_id: str, text: str, more: Callable[[Column], Column] | None = None) -> DataFrame:
    """`df` with `clean_text`, `audit_log` and `spans`. Null text gives null clean_text and an audit log without flags.

    The order is fixed: social security numbers, then cards on the cleaned text, then all other recognisers on that. `more`
    may add spans of a named-entity model (an array of detect.SPANS made of the cleaned text); those come first among equals.
    """
    t = F.col(f"`{text}`")
    step = df.withColumn("_ssn", F.coalesce(detect.count_matches(t, detect.SSN), F.lit(0))).withColumn("_t1", detect.ssn_redact(t))
    step = step.withColumn("_pan", F.greatest(F.coalesce(detect.pan_count(F.col("_t1")), F.lit(0)), F.lit(0))).withColumn("_t2", detect.pan_redact(F.col("_t1")))
    found = detect.all_spans(F.col("_t2"))
    if more is not None:
        found = F.concat(more(F.col("_t2")).cast(detect.SPANS), found)
    step = step.withColumn("_found", F.coalesce(found, F.array().cast(detect.SPANS))).withColumn("spans", spans.merge_spans(F.col("_found")))
    step = step.withColumn("clean_text", spans.redact(F.col("_t2"), F.col("spans")))
    flags = flag_map(F.col("_ssn"), F.col("_pan"), F.col("spans"))
    log = F.struct(F.col(f"`{transaction_id}`").cast("string").alias("transaction_id"), F.length(t).alias("original_char_count"), F.length("clean_text").alias("redacted_char_count"), F.col("_flags").alias("flags_triggered"), F.col("_flags").alias("flags_redacted"))
    return step.withColumn("_flags", flags).withColumn("audit_log", log).drop("_ssn", "_pan", "_t1", "_t2", "_found", "_flags")


def scrubbed(text: Column) -> Column:
    """clean_text and flags (name to count and citation) of one text, as a struct: the same pipeline as an expression, for texts
    inside arrays. Null stays null."""
    final = lambda ssn, x: let(spans.merge_spans(F.coalesce(detect.all_spans(x["t"]), F.array().cast(detect.SPANS))), lambda m: F.struct(
        spans.redact(x["t"], m).alias("clean_text"), flag_map(ssn, F.greatest(F.coalesce(x["n"], F.lit(0)), F.lit(0)), m).alias("flags")))
    cards = lambda t1: let(F.struct(detect.pan_count(t1).alias("n"), detect.pan_redact(t1).alias("t")), lambda x: final(F.coalesce(detect.count_matches(text, detect.SSN), F.lit(0)), x))
    return let(detect.ssn_redact(text), cards)


def flag_counts(m: Column) -> Column:
    """Flag to count only."""
    return F.transform_values(m, lambda k, v: v["count"])


def explode_flags(df: DataFrame, *keep: str) -> DataFrame:
    """One row a flag: keep..., flag, count, cfr_citation."""
    rows = rows_of(df, F.map_entries("audit_log.flags_triggered"), *keep, item="_f", ordinal="_i")
    return rows.select(*keep, F.col("_f.key").alias("flag"), "_f.value.count", "_f.value.cfr_citation")


def residual(clean: Column) -> Column:
    """How many identifiers a second look at a clean text still finds; 0 for a right scrub."""
    return detect.count_matches(clean, detect.SSN) + detect.pan_count(clean) + F.size(detect.all_spans(clean))
