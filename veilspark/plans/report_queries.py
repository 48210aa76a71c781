"""Queries of quality, latency, reports and event windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import OTHER_TOOLS, QUALITY_CASES
from ..operators import evaluate
from ..sources.tables import table
from ..streaming.streams import flag_windows


def eval_confusion(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.confusion(evaluate.quality_cases(spark))


def eval_rates(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.rates(eval_confusion(spark, sf)).select("pii_class", "detection_rate", "false_positive_rate")


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and the values at 95 and 99 % of the sorted list, of events by type."""
    return evaluate.index_quantile(table(spark, sf, "events"), ["event_type"], "value", {"p95": 0.95, "p99": 0.99})


def _own(spark: SparkSession, sf: str) -> DataFrame:
    rate = lambda c: F.max(F.when(F.col("pii_class") == c, F.col("detection_rate")))
    return eval_rates(spark, sf).agg(F.lit("veilspark").alias("tool"), rate("HIPAA_SSN").alias("ssn_rate"), rate("PCI_PAN").alias("pan_rate"), F.lit(0.0).alias("p50_latency_ms"), F.lit("local").alias("note"), F.lit(True).alias("reversible"), F.lit(True).alias("receipts"), F.lit(False).alias("proxy"))


def tool_report(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.report_rows(_own(spark, sf), evaluate.other_tools(spark))


def capability_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.capability_rows(_own(spark, sf).unionByName(evaluate.other_tools(spark)))


def case_classes(spark: SparkSession, sf: str) -> DataFrame:
    return evaluate.quality_cases(spark).groupBy("pii_class").agg(F.count("*").alias("cases"), F.count("expected_token").alias("positives"))


def stream_flag_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Flags of requests per hour of arrival: the batch form of the streaming query."""
    return flag_windows(table(spark, sf, "scrub_requests"), "ingested_at", "transaction_id", "payload").select(F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "flag", "n")


def events_by_window(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return e.groupBy(F.window("at", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def receipt_flags_total(spark: SparkSession, sf: str) -> DataFrame:
    """Classes over all receipts, HIPAA and payment, with the share of receipts that name any."""
    r = table(spark, sf, "compliance_receipts").select(F.size("pii_classes_detected").alias("n"), F.size(F.filter("pii_classes_detected", lambda c: c.startswith("HIPAA"))).alias("h"))
    return r.agg(F.sum("h").alias("hipaa"), F.sum(F.col("n") - F.col("h")).alias("payment"), F.count_if(F.col("n") > 0).alias("with_any"), F.count("*").alias("receipts"))


QUERIES = {f.__name__: f for f in (eval_confusion, eval_rates, latency_percentiles, tool_report, capability_matrix, case_classes, stream_flag_windows, events_by_window, receipt_flags_total)}

from .scrub_queries import _pipeline  # noqa: E402

_VALUES = ", ".join(f"({i}, '{t}', {'NULL' if e is None else repr(e)}, '{c}')" for i, (t, e, c) in enumerate(QUALITY_CASES))
_CASES = f"(SELECT * FROM (VALUES {_VALUES}) v(case_id, text, expected_token, pii_class)) q"
_CONF = _pipeline(_CASES, "case_id", "text") + f""", judged AS (SELECT pii_class, expected_token IS NOT NULL AS pos, contains(clean, coalesce(expected_token, CASE WHEN pii_class LIKE 'PCI%' THEN '[REDACTED_PAN]' ELSE '[REDACTED_SSN]' END)) AS hit FROM done JOIN {_CASES} USING (case_id)),
conf AS (SELECT pii_class, count(*) FILTER (pos AND hit) AS true_positives, count(*) FILTER (NOT pos AND hit) AS false_positives, count(*) FILTER (NOT pos AND NOT hit) AS true_negatives, count(*) FILTER (pos AND NOT hit) AS false_negatives, count(*) AS test_cases_run FROM judged GROUP BY pii_class)"""
_TOOLS = ", ".join(f"('{t}', {a}, {b}, {c}, '{n}', {r}, {k}, {x})" for t, a, b, c, n, r, k, x in [("veilspark", 1.0, 1.0, 0.0, "local", True, True, False), *OTHER_TOOLS])
_MARK = "CASE WHEN {} THEN '✅' ELSE '❌' END"
_LEAVES = "regexp_matches(lower(n), 'egress|cloud|network')"

ORACLE = {
    "eval_confusion": _CONF + " SELECT * FROM conf",
    "eval_rates": _CONF + " SELECT pii_class, CASE WHEN true_positives + false_negatives > 0 THEN round(true_positives / (true_positives + false_negatives), 4) ELSE 0.0 END AS detection_rate, CASE WHEN true_negatives + false_positives > 0 THEN round(false_positives / (true_negatives + false_positives), 4) ELSE 0.0 END AS false_positive_rate FROM conf",
    "latency_percentiles": "SELECT event_type, median(value) AS p50, list_sort(list(value))[CAST(floor(count(value) * 0.95) AS BIGINT) + 1] AS p95, list_sort(list(value))[CAST(floor(count(value) * 0.99) AS BIGINT) + 1] AS p99 FROM events GROUP BY event_type",
    "tool_report": f"SELECT tool, printf('| %s | %.0f%% | %.0f%% | %.0fms | %s | %s | %s |', tool, CAST(a * 100 AS DOUBLE), CAST(b * 100 AS DOUBLE), CAST(c AS DOUBLE), {_MARK.format(f'NOT {_LEAVES}')}, {_MARK.format('r')}, {_MARK.format('k')}) AS line FROM (VALUES {_TOOLS}) v(tool, a, b, c, n, r, k, x)",
    "capability_matrix": f"SELECT capability, '| ' || capability || ' | ' || string_agg({_MARK.format('has')}, ' | ' ORDER BY tool) || ' |' AS line FROM (SELECT tool, unnest(['Reversible redaction', 'Signed receipts', 'Proxy mode', 'No data leaves']) AS capability, unnest([r, k, x, NOT {_LEAVES}]) AS has FROM (VALUES {_TOOLS}) v(tool, a, b, c, n, r, k, x)) GROUP BY capability",
    "case_classes": f"SELECT pii_class, count(*) AS cases, count(expected_token) AS positives FROM {_CASES} GROUP BY pii_class",
    "stream_flag_windows": _pipeline("scrub_requests", "request_id", "payload") + " SELECT strftime(date_trunc('hour', ingested_at), '%Y-%m-%d %H:%M') AS start, flag, CAST(sum(n) AS BIGINT) AS n FROM flags JOIN scrub_requests USING (request_id) GROUP BY 1, 2",
    "events_by_window": "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "receipt_flags_total": "SELECT CAST(sum(len(list_filter(pii_classes_detected, lambda c: c LIKE 'HIPAA%'))) AS BIGINT) AS hipaa, CAST(sum(len(list_filter(pii_classes_detected, lambda c: c NOT LIKE 'HIPAA%'))) AS BIGINT) AS payment, count(*) FILTER (len(pii_classes_detected) > 0) AS with_any, count(*) AS receipts FROM compliance_receipts",
}
