"""Queries of receipts, chains, the vault and ciphers."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import GENESIS, ISSUER
from ..functions.arrays import rows_of
from ..functions.crypto import decrypt, encrypt, hmac_sha256, vault_token
from ..functions.keys import instant, norm_key
from ..functions.running import running
from ..operators import attest, detect, vault
from ..operators.scrub import scrub
from ..session import cut
from ..sources.sinks import dispatch
from ..sources.tables import table
from .scrub_queries import _RAW, _REQUESTS, _spans_sql

#: For the registered queries only; real keys come from functions.crypto.load_key.
_KEY = b"no secret: key of the registered"[:32]


def _events(spark: SparkSession, sf: str) -> DataFrame:
    """Each request, scrubbed, as an event of its replica's chain, in order of arrival."""
    r = table(spark, sf, "scrub_requests").select("request_id", "transaction_id", "replica", "received_at", "payload")
    log = F.col("audit_log")
    names = lambda c: F.array_sort(F.map_keys(log[c]))
    return scrub(r, "transaction_id", "payload").select(
        F.col("replica").alias("chain_id"), F.lower(F.btrim("transaction_id")).alias("transaction_id"), F.date_format(F.col("received_at").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'+00:00'").alias("issued_at"),
        names("flags_triggered").alias("detected"), names("flags_redacted").alias("redacted"), log["original_char_count"].alias("char_in"), log["redacted_char_count"].alias("char_out"),
        F.when(F.col("request_id") % 3 == 0, F.lit("model-é")).alias("downstream_target"), "received_at", "request_id")


_ORDER = ["received_at", "request_id"]


def _chain(spark: SparkSession, sf: str) -> DataFrame:
    return attest.issue(_events(spark, sf), _KEY, _ORDER)


def _flat(df: DataFrame) -> DataFrame:
    lists = [c for c, t in df.dtypes if t.startswith("array")]
    return df.withColumns({c: F.array_join(c, "|") for c in lists})


def receipts_issue(spark: SparkSession, sf: str) -> DataFrame:
    return _flat(_chain(spark, sf)).drop("issuer")


def receipts_append(spark: SparkSession, sf: str) -> DataFrame:
    """The chains issued in two parts, the second appended to the heads of the first: the receipts are those of one part."""
    events = _events(spark, sf)
    middle = table(spark, sf, "scrub_requests").agg(F.avg(F.unix_micros(F.col("received_at").cast("timestamp"))).alias("m")).scalar()
    early = F.unix_micros(F.col("received_at").cast("timestamp")) < middle
    first = cut(attest.issue(events.where(early), _KEY, _ORDER))
    second = attest.issue(events.where(~early), _KEY, _ORDER, after=attest.heads(first))
    return _flat(first.unionByName(second)).drop("issuer")


def chain_verify(spark: SparkSession, sf: str) -> DataFrame:
    return attest.verify(_chain(spark, sf), _KEY)


def chain_tampered(spark: SparkSession, sf: str) -> DataFrame:
    """Chains with one receipt edited, one left out, or neither, by chain."""
    c = _chain(spark, sf)
    n = F.regexp_extract("chain_id", r"(\d+)", 1).cast("int") % 3
    edited = c.withColumn("payload_char_count_out", F.when((n == 0) & (F.col("chain_position") == 2), F.lit(-1)).otherwise(F.col("payload_char_count_out")))
    return attest.verify(edited.where(~((n == 1) & (F.col("chain_position") == 3))), _KEY)


def delivered_links(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered receipts per replica: how many link to the receipt before, over distinct receipts by hash, with lag over the chain's positions."""
    r = table(spark, sf, "compliance_receipts").select("replica", norm_key(F.col("receipt_hash")).alias("h"), norm_key(F.col("previous_receipt_hash")).alias("p"), "chain_position").distinct()
    known = r.select(F.col("replica").alias("r2"), F.col("h").alias("h2")).distinct()
    linked = r.join(known, (r["replica"] == known["r2"]) & (r["p"] == known["h2"]), "left")
    return linked.groupBy("replica").agg(F.count("*").alias("receipts"), F.count("h2").alias("linked"), F.max("chain_position").alias("last_position"))


def chain_positions(spark: SparkSession, sf: str) -> DataFrame:
    """Positions given by arrival within a replica, and whether the delivered one is the same. A replica may hold any share of the rows."""
    r = table(spark, sf, "compliance_receipts").select("delivery_id", "replica", "delivered_at", "chain_position", F.lit(1).alias("one"))
    placed = running(r, ["replica"], ["delivered_at", "delivery_id"], "one", "n").withColumn("n", F.col("n").cast("int"))
    return placed.select("delivery_id", F.col("n").alias("arrival_position"), (F.col("n") == F.col("chain_position")).alias("same"))


def receipt_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """The latest receipt of each transaction."""
    r = table(spark, sf, "compliance_receipts").select(norm_key(F.col("transaction_id")).alias("transaction_id"), "chain_position", "receipt_hash", "replica").where("transaction_id IS NOT NULL")
    return attest.latest_receipt(r)


def event_payload(spark: SparkSession, sf: str) -> DataFrame:
    e = attest.event_payload(table(spark, sf, "compliance_receipts").select("delivery_id", *[c for c in attest.SIGNED if c != "issuer"], "receipt_hash"))
    return _flat(e)


def _receiver(url: str, body: bytes, headers: dict, timeout: float) -> int:
    """Stands for a web hook: takes confirmed events with the right header."""
    ok = url.startswith("https://") and headers.get("X-Relay-Key") == "test" and headers["Content-Type"] == "application/json"
    return (204 if json.loads(body)["zero_pii_egress_confirmed"] else 500) if ok else 401


def webhook_dispatch(spark: SparkSession, sf: str) -> DataFrame:
    """Events posted to a receiver with a header of its own; what it refuses counts as not sent and fails nothing."""
    e = attest.event_payload(table(spark, sf, "compliance_receipts"))
    return dispatch(e, "https://hook.example/in", token="test", header="X-Relay-Key", send=_receiver).groupBy("sent").agg(F.count("*").alias("n"))


def zero_egress(spark: SparkSession, sf: str) -> DataFrame:
    """Whether classes detected and redacted agree, against what the receipt claims."""
    r = table(spark, sf, "compliance_receipts")
    same = attest.zero_egress(F.col("pii_classes_detected"), F.col("pii_classes_redacted"))
    return r.groupBy(same.alias("agrees"), "zero_pii_egress_confirmed").agg(F.count("*").alias("n"), F.sum(F.col("payload_char_count_in") - F.col("payload_char_count_out") - F.col("chars_removed")).alias("off_by"))


def chain_export(spark: SparkSession, sf: str) -> DataFrame:
    """The delivered chain as records, in order."""
    r = table(spark, sf, "compliance_receipts").select("replica", "chain_position", "delivery_id", "receipt_id", "receipt_hash")
    return r.orderBy("replica", "chain_position", "delivery_id")


def hmac_signatures(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "compliance_receipts").select("delivery_id", hmac_sha256(F.concat_ws("|", "receipt_id", "receipt_hash"), _KEY).alias("mac"))


def _mails(spark: SparkSession, sf: str) -> DataFrame:
    """The addresses of mail in the payloads, as values for the vault."""
    plain = table(spark, sf, "scrub_requests").select("request_id", "payload")
    found = rows_of(plain, detect.rule_spans(detect.ascii_digits(F.col("payload")), "EMAIL_ADDRESS", 0), "request_id", "payload", item="x", ordinal="nth")
    return found.select("request_id", "nth", F.lit("EMAIL").alias("pii_type"), F.substring("payload", F.col("x.s") + 1, F.col("x.e") - F.col("x.s")).alias("value"))


def vault_tokens(spark: SparkSession, sf: str) -> DataFrame:
    return _mails(spark, sf).select("request_id", "nth", vault_token(F.col("pii_type"), F.col("value"), _KEY).alias("token"))


def vault_retrieve(spark: SparkSession, sf: str) -> DataFrame:
    """Each address stored under its token, encrypted, and brought back by it; a token never stored has null."""
    values = _mails(spark, sf).select("pii_type", "value", F.col("request_id").cast("string").alias("transaction_id"), F.lpad(F.col("request_id").cast("string"), 12, "0").alias("created_at"))
    stored = vault.upsert(cut(vault.new_entries(values, _KEY)), ["created_at"])
    wanted = stored.select("token").unionByName(spark.range(1).select(F.lit("[REDACTED_SSN_doesnotexist]").alias("token")))
    return vault.retrieve(wanted, stored, _KEY)


def _vault(spark: SparkSession, sf: str) -> DataFrame:
    v = table(spark, sf, "vault_entries")
    return v.select("token", "pii_type", "encrypted_value", norm_key(F.col("transaction_id")).alias("transaction_id"), instant(F.col("created_at")).alias("at"), "entry_id")


def vault_upsert(spark: SparkSession, sf: str) -> DataFrame:
    """The last writer of each token owns it."""
    return vault.upsert(_vault(spark, sf), ["at", "entry_id"]).select("token", "pii_type", "transaction_id", "entry_id")


def _purged(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "standing_transactions").select(norm_key(F.col("transaction_id")).alias("transaction_id"))


def vault_purge(spark: SparkSession, sf: str) -> DataFrame:
    return vault.purge(vault.upsert(_vault(spark, sf), ["at", "entry_id"]), _purged(spark, sf))[1]


def vault_after_purge(spark: SparkSession, sf: str) -> DataFrame:
    stays = vault.purge(vault.upsert(_vault(spark, sf), ["at", "entry_id"]), _purged(spark, sf))[0]
    return stays.groupBy("pii_type").agg(F.count("*").alias("entries"))


def vault_size(spark: SparkSession, sf: str) -> DataFrame:
    return _vault(spark, sf).agg(F.count("*").alias("entries"), F.countDistinct("token").alias("tokens"))


def vault_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Placeholders with a token in the vault's form, resolved; unknown tokens have no entry."""
    v = vault.upsert(_vault(spark, sf), ["at", "entry_id"])
    wanted = table(spark, sf, "vault_entries").select("token").unionByName(spark.range(1).select(F.lit("[REDACTED_SSN_doesnotexist]").alias("token"))).distinct()
    return vault.retrieve_entries(wanted, v).select("token", "pii_type", "entry_id")


def vault_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """Each token encrypted and decrypted again under a test key."""
    v = table(spark, sf, "vault_entries").select("entry_id", "token")
    return v.select("entry_id", decrypt(encrypt(F.col("token"), _KEY), _KEY).alias("value"))


QUERIES = {f.__name__: f for f in (
    receipts_issue, receipts_append, chain_verify, chain_tampered, delivered_links, chain_positions, receipt_lookup, event_payload, webhook_dispatch, zero_egress, chain_export,
    hmac_signatures, vault_tokens, vault_retrieve, vault_upsert, vault_purge, vault_after_purge, vault_size, vault_lookup, vault_roundtrip)}


def _hmac(message: str) -> str:
    block = _KEY.ljust(64, b"\0")
    inner, outer = (bytes(x ^ pad for x in block).hex() for pad in (0x36, 0x5C))
    return f"sha256(unhex('{outer}' || sha256(unhex('{inner}' || hex(encode({message}))))))"


_N = r"lower(regexp_replace({}, '^[\s\p{{Z}}]+|[\s\p{{Z}}]+$', '', 'g'))"
_CHAIN = rf"""WITH RECURSIVE {_REQUESTS[5:]}, listed AS (SELECT request_id, list(flag ORDER BY flag) AS fl FROM flags GROUP BY request_id), ev AS (
  SELECT replica AS chain_id, lower(trim(transaction_id)) AS tx, strftime(received_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00' AS issued_at,
    coalesce(array_to_string(fl, '|'), '') AS cls, coalesce('"' || array_to_string(fl, '","') || '"', '') AS quoted, coalesce(chars_in, 0) AS ci, coalesce(length(clean), 0) AS co,
    CASE WHEN request_id % 3 = 0 THEN 'model-é' END AS tgt, CAST(row_number() OVER (PARTITION BY replica ORDER BY received_at, request_id) - 1 AS INT) AS pos FROM scrub_requests JOIN done USING (request_id) LEFT JOIN listed USING (request_id)
), chain AS (
  SELECT chain_id, CAST(-1 AS INT) AS pos, sha256('{GENESIS}') AS h, CAST(NULL AS VARCHAR) AS prev FROM (SELECT DISTINCT chain_id FROM ev)
  UNION ALL
  SELECT e.chain_id, e.pos, {_hmac(r'''
    '{"chain_position":' || e.pos || ',"chars_removed":' || (ci - co) || ',"compliance_frameworks":["HIPAA","PCI-DSS"],"downstream_target":' || CASE WHEN tgt IS NULL THEN 'null' ELSE '"model-\u00e9"' END
    || ',"issued_at":"' || issued_at || '","issuer":"ISSUER","payload_char_count_in":' || ci || ',"payload_char_count_out":' || co
    || ',"pii_classes_detected":[' || quoted || '],"pii_classes_redacted":[' || quoted || '],"previous_receipt_hash":"' || c.h
    || '","receipt_id":"rcpt_' || tx || '_' || lpad(CAST(e.pos AS VARCHAR), 6, '0') || '","transaction_id":"' || tx || '","zero_pii_egress_confirmed":true}' ''')}, c.h
  FROM chain c JOIN ev e ON e.chain_id = c.chain_id AND e.pos = c.pos + 1
)""".replace("ISSUER", ISSUER.replace("—", "\\u2014"))
_UPSERT = f"""WITH v AS (SELECT *, {_N.format('transaction_id')} AS tx, row_number() OVER (PARTITION BY token ORDER BY CAST(replace(created_at, ' ', 'T') AS TIMESTAMPTZ) DESC, entry_id DESC) AS rn FROM vault_entries), u AS (SELECT token, pii_type, tx AS transaction_id, entry_id FROM v WHERE rn = 1)"""

_MAILS = f"{_RAW}{_spans_sql('raw')}, mails AS (SELECT request_id, CAST(row_number() OVER (PARTITION BY request_id ORDER BY s) - 1 AS INT) AS nth, substr(payload, s + 1, e - s) AS v FROM spans JOIN scrub_requests USING (request_id) WHERE p = 'EMAIL')"
_TOKEN = "'[REDACTED_EMAIL_' || left(" + _hmac("'EMAIL:' || v") + ", 16) || ']'"

ORACLE = {
    "receipts_issue": _CHAIN + """ SELECT e.chain_id, 'rcpt_' || tx || '_' || lpad(CAST(e.pos AS VARCHAR), 6, '0') AS receipt_id, tx AS transaction_id, issued_at, 'HIPAA|PCI-DSS' AS compliance_frameworks, cls AS pii_classes_detected, cls AS pii_classes_redacted,
  CAST(ci AS INT) AS payload_char_count_in, CAST(co AS INT) AS payload_char_count_out, CAST(ci - co AS INT) AS chars_removed, true AS zero_pii_egress_confirmed, tgt AS downstream_target, prev AS previous_receipt_hash, h AS receipt_hash, e.pos AS chain_position FROM ev e JOIN chain c ON e.chain_id = c.chain_id AND e.pos = c.pos""",
    "chain_verify": "SELECT replica AS chain_id, count(*) AS receipts, true AS valid, CAST(NULL AS INT) AS first_bad FROM scrub_requests GROUP BY replica",
    "chain_tampered": r"SELECT replica AS chain_id, count(*) - CASE WHEN k = 1 AND count(*) > 3 THEN 1 ELSE 0 END AS receipts, CASE k WHEN 0 THEN count(*) <= 2 WHEN 1 THEN count(*) <= 4 ELSE true END AS valid, CASE WHEN k = 0 AND count(*) > 2 THEN 2 WHEN k = 1 AND count(*) > 4 THEN 4 END AS first_bad FROM (SELECT replica, CAST(regexp_extract(replica, '(\d+)', 1) AS INT) % 3 AS k FROM scrub_requests) GROUP BY replica, k",
    "delivered_links": f"WITH r AS (SELECT DISTINCT replica, {_N.format('receipt_hash')} AS h, {_N.format('previous_receipt_hash')} AS p, chain_position FROM compliance_receipts), k AS (SELECT DISTINCT replica, h FROM r) SELECT r.replica, count(*) AS receipts, count(k.h) AS linked, max(chain_position) AS last_position FROM r LEFT JOIN k ON r.replica = k.replica AND r.p = k.h GROUP BY r.replica",
    "chain_positions": "SELECT delivery_id, CAST(n AS INT) AS arrival_position, n = chain_position AS same FROM (SELECT *, row_number() OVER (PARTITION BY replica ORDER BY delivered_at, delivery_id) - 1 AS n FROM compliance_receipts)",
    "receipt_lookup": f"SELECT tx AS transaction_id, chain_position, receipt_hash, replica FROM (SELECT *, {_N.format('transaction_id')} AS tx, row_number() OVER (PARTITION BY {_N.format('transaction_id')} ORDER BY chain_position DESC, receipt_hash DESC) AS rn FROM compliance_receipts WHERE trim(transaction_id) <> '') WHERE rn = 1",
    "event_payload": "SELECT 'scrub' AS event_type, 'veilspark' AS source, receipt_id, transaction_id, issued_at, array_to_string(compliance_frameworks, '|') AS compliance_frameworks, array_to_string(pii_classes_detected, '|') AS pii_classes_detected, array_to_string(pii_classes_redacted, '|') AS pii_classes_redacted, zero_pii_egress_confirmed, chain_position, receipt_hash, previous_receipt_hash FROM compliance_receipts",
    "webhook_dispatch": "SELECT coalesce(zero_pii_egress_confirmed, false) AS sent, count(*) AS n FROM compliance_receipts GROUP BY 1",
    "zero_egress": "SELECT list_sort(list_distinct(pii_classes_detected)) = list_sort(list_distinct(pii_classes_redacted)) AS agrees, zero_pii_egress_confirmed, count(*) AS n, CAST(sum(payload_char_count_in - payload_char_count_out - chars_removed) AS BIGINT) AS off_by FROM compliance_receipts GROUP BY 1, 2",
    "chain_export": "SELECT replica, chain_position, delivery_id, receipt_id, receipt_hash FROM compliance_receipts",
    "hmac_signatures": "SELECT delivery_id, " + _hmac("concat_ws('|', receipt_id, receipt_hash)") + " AS mac FROM compliance_receipts",
    "vault_tokens": _MAILS + f" SELECT request_id, nth, {_TOKEN} AS token FROM mails",
    "vault_retrieve": _MAILS + f" SELECT DISTINCT {_TOKEN} AS token, v AS value FROM mails UNION ALL SELECT '[REDACTED_SSN_doesnotexist]', NULL",
    "vault_upsert": _UPSERT + " SELECT * FROM u",
    "vault_purge": _UPSERT + f" SELECT s.transaction_id, count(u.token) AS purged FROM (SELECT DISTINCT {_N.format('transaction_id')} AS transaction_id FROM standing_transactions) s LEFT JOIN u USING (transaction_id) GROUP BY s.transaction_id",
    "vault_after_purge": _UPSERT + f" SELECT pii_type, count(*) AS entries FROM u WHERE transaction_id IS NULL OR transaction_id NOT IN (SELECT {_N.format('transaction_id')} FROM standing_transactions) GROUP BY pii_type",
    "vault_size": "SELECT count(*) AS entries, count(DISTINCT token) AS tokens FROM vault_entries",
    "vault_lookup": _UPSERT + " SELECT w.token, pii_type, entry_id FROM (SELECT DISTINCT token FROM vault_entries UNION ALL SELECT '[REDACTED_SSN_doesnotexist]') w LEFT JOIN u USING (token)",
    "vault_roundtrip": "SELECT entry_id, token AS value FROM vault_entries",
}
ORACLE["receipts_append"] = ORACLE["receipts_issue"]
