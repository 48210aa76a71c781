"""Queries of the core's data problems: orphan references, repeated deliveries, nested records."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import instant, norm_key, trimmed, utc
from ..operators.dedup import copies_to_drop, keep_one
from ..operators.nested import CLASS_LISTS, FLAG_LISTS, Shape, children, flat_tables, flatten, response_rows
from ..operators.orphans import find_orphans, orphan_report
from ..sources.tables import table


def _refs_targets(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    receipts, vault = table(spark, sf, "compliance_receipts"), table(spark, sf, "vault_entries")
    key = lambda space, c: F.concat(F.lit(space), norm_key(F.col(c))).alias("key")
    ref = lambda df, field, row, space, at: df.select(F.lit(field).alias("ref_field"), F.col(row).alias("row_id"), key(space, field.split(".")[1]), at.alias("at"))
    target = lambda df, space, c, start, end: df.select(key(space, c), start.alias("valid_from"), end.cast("timestamp").alias("valid_to"))
    no_end, always = F.lit(None), F.lit(None).cast("timestamp")
    refs = (
        ref(receipts, "compliance_receipts.transaction_id", "delivery_id", "t:", utc(F.col("delivered_at")))
        .unionByName(ref(receipts, "compliance_receipts.previous_receipt_hash", "delivery_id", "h:", utc(F.col("delivered_at"))))
        .unionByName(ref(vault, "vault_entries.transaction_id", "entry_id", "t:", instant(F.col("created_at"))))
    )
    targets = (
        target(table(spark, sf, "scrub_requests"), "t:", "transaction_id", utc(F.col("ingested_at")), utc(F.col("deleted_at")))
        .unionByName(target(table(spark, sf, "standing_transactions"), "t:", "transaction_id", utc(F.col("opened_at")), utc(F.col("closed_at"))))
        .unionByName(target(receipts, "h:", "receipt_hash", utc(F.col("delivered_at")), no_end))
        .unionByName(target(table(spark, sf, "relay_replicas"), "h:", "genesis_hash", always, no_end))
    )
    return refs, targets


def p2_orphans(spark: SparkSession, sf: str) -> DataFrame:
    return find_orphans(*_refs_targets(spark, sf))


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_orphans(spark, sf).select("ref_field", "row_id", "reason")


def p2_report(spark: SparkSession, sf: str) -> DataFrame:
    return orphan_report(p2_orphans(spark, sf))


_ORDER = lambda: [instant(F.col("issued_at")), utc(F.col("delivered_at")), F.col("delivery_id")]


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return copies_to_drop(table(spark, sf, "compliance_receipts"), norm_key(F.col("receipt_id")), _ORDER(), "delivery_id")


def p3_kept(spark: SparkSession, sf: str) -> DataFrame:
    kept = keep_one(table(spark, sf, "compliance_receipts"), norm_key(F.col("receipt_id")), _ORDER())
    return kept.select("delivery_id", norm_key(F.col("receipt_id")).alias("receipt_key"), "batch_id", trimmed(F.col("issued_at")).alias("issued_at"), "receipt_hash")


def _rows(spark: SparkSession, sf: str) -> tuple[DataFrame, Shape]:
    return response_rows(table(spark, sf, "scrub_responses"), table(spark, sf, "response_batches"))


_LINK = ["record_table", "record_id", "item_path"]


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return children(*_rows(spark, sf))


_RECEIPT = ("receipt_id", "transaction_id", "issued_at", "issuer", "payload_char_count_in", "payload_char_count_out", "chars_removed", "zero_pii_egress_confirmed", "downstream_target", "previous_receipt_hash", "receipt_hash", "chain_position")
_AUDIT = ("transaction_id", "original_char_count", "redacted_char_count")


def _of(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; what no row of the data has is null."""
    return df.select(*[F.col(n) if n in df.columns else F.lit(None).cast("string").alias(n) for n in names])


def p5_responses(spark: SparkSession, sf: str) -> DataFrame:
    """Responses with what their producers add, and their audit logs' counts, by the merged schema."""
    rows = flat_tables(*_rows(spark, sf))["responses"]
    return _of(rows, *_LINK, "parent_path", "clean_text", "transaction_id", "producer", "meta_n", "meta_seq", *[f"audit_log_{c}" for c in _AUDIT])


def p5_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The receipts of the responses that have one."""
    names = [f"compliance_receipt_{c}" for c in _RECEIPT]
    rows = _of(flat_tables(*_rows(spark, sf))["responses"], *_LINK, *names)
    return rows.where(F.coalesce(*[F.col(c).cast("string") for c in names]).isNotNull()).select(*_LINK, *[F.col(c).alias(c[len("compliance_receipt_"):]) for c in names])


def _lists(spark: SparkSession, sf: str, names: tuple[str, ...], prefix: str, *cols: str) -> DataFrame:
    tables = flat_tables(*_rows(spark, sf))
    one = lambda n: tables[prefix + n].withColumn("child_list", F.lit(n)).select(*_LINK, "parent_key", "ordinal", "child_list", *cols)
    return functools.reduce(DataFrame.unionByName, map(one, names))


def p5_flags(spark: SparkSession, sf: str) -> DataFrame:
    rows = _lists(spark, sf, FLAG_LISTS, "audit_log_", "map_key", "flag", "value", "count", "cfr_citation")
    return rows.select(*_LINK, "parent_key", "ordinal", "child_list", F.coalesce("map_key", "flag", F.when(F.col("map_key").isNull(), F.col("value").cast("string"))).alias("flag"), F.coalesce("count", F.col("value").cast("string").try_cast("bigint")).alias("count"), "cfr_citation")


def p5_entities(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf, ("entities",), "audit_log_", "start", "end", "entity_type", "flag", "placeholder").drop("child_list")


def p5_classes(spark: SparkSession, sf: str) -> DataFrame:
    return _lists(spark, sf, CLASS_LISTS, "compliance_receipt_", F.col("value").alias("pii_class"))


def p5_flattened_receipts(spark: SparkSession, sf: str) -> DataFrame:
    """The generic operator over scrub_responses: the child table of one array, three levels down."""
    return flatten(table(spark, sf, "scrub_responses"), ["response_id"])["root.compliance_receipt_pii_classes_detected"]


QUERIES = {f.__name__: f for f in (p2_found, p2_report, p3_found, p3_kept, p5_found, p5_responses, p5_receipts, p5_flags, p5_entities, p5_classes, p5_flattened_receipts)}

_KEY = r"nullif(lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g')), '')"
_AT = "CAST(replace({}, ' ', 'T') AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"

_ORPHANS = f"""
WITH refs AS (
  SELECT 'compliance_receipts.transaction_id' AS ref_field, delivery_id AS row_id, 't:' || {_KEY.format("transaction_id")} AS k, delivered_at AS t0 FROM compliance_receipts
  UNION ALL SELECT 'compliance_receipts.previous_receipt_hash', delivery_id, 'h:' || {_KEY.format("previous_receipt_hash")}, delivered_at FROM compliance_receipts
  UNION ALL SELECT 'vault_entries.transaction_id', entry_id, 't:' || {_KEY.format("transaction_id")}, {_AT.format("created_at")} FROM vault_entries
), targets AS (
  SELECT 't:' || {_KEY.format("transaction_id")} AS k, ingested_at AS f, coalesce(deleted_at, TIMESTAMP '9999-01-01') AS e FROM scrub_requests
  UNION ALL SELECT 't:' || {_KEY.format("transaction_id")}, opened_at, coalesce(closed_at, TIMESTAMP '9999-01-01') FROM standing_transactions
  UNION ALL SELECT 'h:' || {_KEY.format("receipt_hash")}, delivered_at, TIMESTAMP '9999-01-01' FROM compliance_receipts
  UNION ALL SELECT 'h:' || {_KEY.format("genesis_hash")}, TIMESTAMP '0001-01-01', TIMESTAMP '9999-01-01' FROM relay_replicas
), orphans AS (
  SELECT r.ref_field, r.row_id, r.t0,
    CASE WHEN count(t.k) = 0 THEN 'missing' WHEN min(t.f) > r.t0 THEN 'late' ELSE 'deleted' END AS reason
  FROM refs r LEFT JOIN targets t ON r.k = t.k WHERE r.k IS NOT NULL
  GROUP BY r.ref_field, r.row_id, r.t0 HAVING NOT coalesce(bool_or(t.f <= r.t0 AND r.t0 < t.e), false)
)
"""

_RANKED = f"""
WITH ranked AS (
  SELECT *, {_KEY.format("receipt_id")} AS receipt_key,
    row_number() OVER (PARTITION BY {_KEY.format("receipt_id")} ORDER BY {_AT.format("issued_at")} NULLS LAST, delivered_at, delivery_id) AS rn
  FROM compliance_receipts)
"""

_BODIES = """
WITH RECURSIVE docs AS (
  SELECT batch_id, CAST(body AS JSON) AS b FROM response_batches WHERE json_valid(body)
), lists AS (
  SELECT batch_id, CASE
    WHEN json_type(b) = 'ARRAY' THEN b
    WHEN json_type(b) <> 'OBJECT' THEN '[]'
    WHEN list_contains(json_keys(b), 'responses') THEN CASE json_type(b, '$.responses') WHEN 'ARRAY' THEN b->'$.responses' WHEN 'OBJECT' THEN json_array(b->'$.responses') ELSE '[]' END
    WHEN list_contains(json_keys(b), 'data') THEN CASE json_type(b, '$.data.responses') WHEN 'ARRAY' THEN b->'$.data.responses' WHEN 'OBJECT' THEN json_array(b->'$.data.responses') ELSE '[]' END
    ELSE json_array(b) END AS l FROM docs
), items(batch_id, item_path, parent_path, r) AS (
  SELECT batch_id, CAST(i AS VARCHAR), CAST(NULL AS VARCHAR), l->('$[' || i || ']') FROM lists, unnest(range(CAST(json_array_length(l) AS BIGINT))) t(i)
  UNION ALL
  SELECT batch_id, item_path || '/' || i, item_path, r->('$.parts[' || i || ']') FROM items, unnest(range(CASE WHEN json_type(r, '$.parts') = 'ARRAY' THEN CAST(json_array_length(r, '$.parts') AS BIGINT) ELSE 0 END)) t(i)
), resp AS (
  SELECT batch_id, item_path, parent_path, r,
    CASE json_type(r, '$.audit_log') WHEN 'OBJECT' THEN r->'$.audit_log' WHEN 'VARCHAR' THEN CASE WHEN json_valid(r->>'$.audit_log') THEN CAST(r->>'$.audit_log' AS JSON) END END AS a,
    CASE json_type(r, '$.compliance_receipt') WHEN 'OBJECT' THEN r->'$.compliance_receipt' END AS c
  FROM items WHERE json_type(r) = 'OBJECT'
), flag_values AS (
  SELECT batch_id, item_path, l, a->('$.' || l) AS v FROM resp, (VALUES ('flags_triggered'), ('flags_redacted')) x(l)
), flag_rows AS (
  SELECT batch_id, item_path, l, k, v->('$."' || k || '"') AS x FROM flag_values, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE [] END) t(k)
  UNION ALL
  SELECT batch_id, item_path, l, v->>('$[' || i || '].flag'), v->('$[' || i || ']') FROM flag_values, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) ELSE 0 END)) t(i)
), entity_rows AS (
  SELECT batch_id, item_path, i, a->('$.entities[' || i || ']') AS x FROM resp, unnest(range(CASE WHEN json_type(a, '$.entities') = 'ARRAY' THEN CAST(json_array_length(a, '$.entities') AS BIGINT) ELSE 0 END)) t(i)
), class_rows AS (
  SELECT batch_id, item_path, l, i, c->>('$.' || l || '[' || i || ']') AS n FROM resp, (VALUES ('pii_classes_detected'), ('pii_classes_redacted')) x(l), unnest(range(CASE WHEN json_type(c, '$.' || l) = 'ARRAY' THEN CAST(json_array_length(c, '$.' || l) AS BIGINT) ELSE 0 END)) t(i)
)
"""

ORACLE = {
    "p2_found": _ORPHANS + "SELECT ref_field, row_id, reason FROM orphans",
    "p2_report": _ORPHANS + "SELECT split_part(ref_field, '.', 1) AS ref_table, ref_field, strftime(t0, '%Y-%m') AS month, reason, count(*) AS orphans FROM orphans GROUP BY ALL",
    "p3_found": _RANKED + "SELECT delivery_id FROM ranked WHERE receipt_key IS NOT NULL AND rn > 1",
    "p3_kept": _RANKED + "SELECT delivery_id, receipt_key, batch_id, issued_at, receipt_hash FROM ranked WHERE receipt_key IS NULL OR rn = 1",
    "p5_found": _BODIES + """
SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, l AS child_list, upper(trim(k)) AS child_key FROM flag_rows WHERE k IS NOT NULL
UNION SELECT 'response_batches', batch_id, item_path, 'entities', CAST(i AS VARCHAR) FROM entity_rows
UNION SELECT 'response_batches', batch_id, item_path, l, upper(trim(n)) FROM class_rows WHERE n IS NOT NULL
UNION SELECT 'scrub_responses', response_id, '0', 'flags_triggered', upper(trim(k)) FROM scrub_responses, unnest(map_keys(audit_log.flags_triggered)) t(k)
UNION SELECT 'scrub_responses', response_id, '0', 'flags_redacted', upper(trim(k)) FROM scrub_responses, unnest(map_keys(audit_log.flags_redacted)) t(k)
UNION SELECT 'scrub_responses', response_id, '0', 'pii_classes_detected', upper(trim(k)) FROM scrub_responses, unnest(compliance_receipt.pii_classes_detected) t(k) WHERE k IS NOT NULL
UNION SELECT 'scrub_responses', response_id, '0', 'pii_classes_redacted', upper(trim(k)) FROM scrub_responses, unnest(compliance_receipt.pii_classes_redacted) t(k) WHERE k IS NOT NULL""",
    "p5_responses": _BODIES + """
SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, parent_path, r->>'$.clean_text' AS clean_text, r->>'$.transaction_id' AS transaction_id, r->>'$.producer' AS producer, CAST(r->>'$.meta.n' AS BIGINT) AS meta_n, CAST(r->>'$.meta.seq' AS BIGINT) AS meta_seq,
  a->>'$.transaction_id' AS audit_log_transaction_id, CAST(a->>'$.original_char_count' AS BIGINT) AS audit_log_original_char_count, CAST(a->>'$.redacted_char_count' AS BIGINT) AS audit_log_redacted_char_count FROM resp
UNION ALL SELECT 'scrub_responses', response_id, '0', NULL, clean_text, transaction_id, NULL, NULL, NULL, audit_log.transaction_id, audit_log.original_char_count, audit_log.redacted_char_count FROM scrub_responses""",
    "p5_entities": _BODIES + """
SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, 'response_batches/' || batch_id || '/' || item_path AS parent_key, CAST(i AS INT) AS ordinal, CAST(x->>'$.start' AS BIGINT) AS "start", CAST(x->>'$.end' AS BIGINT) AS "end", x->>'$.entity_type' AS entity_type, x->>'$.flag' AS flag, x->>'$.placeholder' AS placeholder FROM entity_rows""",
    "p5_classes": _BODIES + """
SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, 'response_batches/' || batch_id || '/' || item_path AS parent_key, CAST(i AS INT) AS ordinal, l AS child_list, n AS pii_class FROM class_rows
UNION ALL SELECT 'scrub_responses', response_id, '0', 'scrub_responses/' || response_id || '/0', CAST(i - 1 AS INT), 'pii_classes_detected', compliance_receipt.pii_classes_detected[i] FROM scrub_responses, unnest(range(1, 1 + len(compliance_receipt.pii_classes_detected))) t(i)
UNION ALL SELECT 'scrub_responses', response_id, '0', 'scrub_responses/' || response_id || '/0', CAST(i - 1 AS INT), 'pii_classes_redacted', compliance_receipt.pii_classes_redacted[i] FROM scrub_responses, unnest(range(1, 1 + len(compliance_receipt.pii_classes_redacted))) t(i)""",
    "p5_flags": _BODIES + """, listed AS (
  SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, l, k AS flag, row_number() OVER (PARTITION BY batch_id, item_path, l ORDER BY k) - 1 AS ord, CAST(CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.count' WHEN 'UBIGINT' THEN x->>'$' END AS BIGINT) AS n, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.cfr_citation' END AS c
    FROM (SELECT batch_id, item_path, l, k, v->('$."' || k || '"') AS x FROM flag_values, unnest(CASE WHEN json_type(v) = 'OBJECT' THEN json_keys(v) ELSE [] END) t(k))
  UNION ALL SELECT 'response_batches', batch_id, item_path, l, CASE json_type(x) WHEN 'OBJECT' THEN x->>'$.flag' WHEN 'VARCHAR' THEN x->>'$' END, i, CASE WHEN json_type(x) = 'OBJECT' THEN CAST(x->>'$.count' AS BIGINT) END, CASE WHEN json_type(x) = 'OBJECT' THEN x->>'$.cfr_citation' END
    FROM (SELECT *, v->('$[' || i || ']') AS x FROM flag_values, unnest(range(CASE WHEN json_type(v) = 'ARRAY' THEN CAST(json_array_length(v) AS BIGINT) ELSE 0 END)) t(i))
  UNION ALL SELECT 'scrub_responses', response_id, '0', l, e.key, row_number() OVER (PARTITION BY response_id, l ORDER BY e.key) - 1, e.value.count, e.value.cfr_citation
    FROM (SELECT response_id, 'flags_triggered' AS l, unnest(map_entries(audit_log.flags_triggered)) AS e FROM scrub_responses UNION ALL SELECT response_id, 'flags_redacted', unnest(map_entries(audit_log.flags_redacted)) FROM scrub_responses))
SELECT record_table, record_id, item_path, record_table || '/' || record_id || '/' || item_path AS parent_key, CAST(ord AS INT) AS ordinal, l AS child_list, flag, n AS count, c AS cfr_citation FROM listed""",
    "p5_receipts": _BODIES + """
SELECT * FROM (SELECT 'response_batches' AS record_table, batch_id AS record_id, item_path, c->>'$.receipt_id' AS receipt_id, c->>'$.transaction_id' AS transaction_id, c->>'$.issued_at' AS issued_at, c->>'$.issuer' AS issuer, CAST(c->>'$.payload_char_count_in' AS BIGINT) AS payload_char_count_in, CAST(c->>'$.payload_char_count_out' AS BIGINT) AS payload_char_count_out, CAST(c->>'$.chars_removed' AS BIGINT) AS chars_removed,
  CAST(c->>'$.zero_pii_egress_confirmed' AS BOOLEAN) AS zero_pii_egress_confirmed, c->>'$.downstream_target' AS downstream_target, c->>'$.previous_receipt_hash' AS previous_receipt_hash, c->>'$.receipt_hash' AS receipt_hash, CAST(c->>'$.chain_position' AS BIGINT) AS chain_position FROM resp
UNION ALL SELECT 'scrub_responses', response_id, '0', r.receipt_id, r.transaction_id, r.issued_at, r.issuer, r.payload_char_count_in, r.payload_char_count_out, r.chars_removed, r.zero_pii_egress_confirmed, r.downstream_target, r.previous_receipt_hash, r.receipt_hash, r.chain_position FROM (SELECT response_id, compliance_receipt AS r FROM scrub_responses))
WHERE coalesce(receipt_id, transaction_id, issued_at, issuer, CAST(payload_char_count_in AS VARCHAR), CAST(payload_char_count_out AS VARCHAR), CAST(chars_removed AS VARCHAR), CAST(zero_pii_egress_confirmed AS VARCHAR), downstream_target, previous_receipt_hash, receipt_hash, CAST(chain_position AS VARCHAR)) IS NOT NULL""",
    "p5_flattened_receipts": """
SELECT response_id || '/compliance_receipt_pii_classes_detected/' || (i - 1) AS row_key, CAST(response_id AS VARCHAR) AS parent_key, CAST(i - 1 AS INT) AS ordinal, compliance_receipt.pii_classes_detected[i] AS value
FROM scrub_responses, unnest(range(1, 1 + len(compliance_receipt.pii_classes_detected))) t(i)""",
}
