"""Receipts: issuing signed chains and verifying them."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..constants import FRAMEWORKS, GENESIS, ISSUER
from ..functions.crypto import canonical_json, hmac_sha256
from ..session import ship_package

RECEIPT = "chain_id string, receipt_id string, transaction_id string, issued_at string, issuer string, compliance_frameworks array<string>, pii_classes_detected array<string>, pii_classes_redacted array<string>, payload_char_count_in int, payload_char_count_out int, chars_removed int, zero_pii_egress_confirmed boolean, downstream_target string, previous_receipt_hash string, receipt_hash string, chain_position int"
RECEIPT_FIELDS = [x.split()[0] for x in RECEIPT.split(", ")]
SIGNED = [c for c in RECEIPT_FIELDS if c not in ("chain_id", "receipt_hash")]


def genesis_hash(seed: str = GENESIS) -> str:
    return hashlib.sha256(seed.encode()).hexdigest()


def zero_egress(detected: Column, redacted: Column) -> Column:
    """Both lists hold the same classes."""
    return F.array_sort(F.array_distinct(detected)) == F.array_sort(F.array_distinct(redacted))


def _inside(json: Column) -> Column:
    """What stands between the braces of an object."""
    return F.substring(json, F.lit(2), F.length(json) - 2)


def signed_parts(events: DataFrame, issuer: str = ISSUER) -> DataFrame:
    """`events` with `parts`: the canonical JSON of each receipt but for the position and the hash before, which stand between the
    parts. What has no serial order is made here, by built-in expressions. Null lists are empty, null counts 0."""
    lists = [F.coalesce(F.col(c), F.array().cast("array<string>")) for c in ("detected", "redacted")]
    n = [F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("char_in", "char_out")]
    made = {
        "transaction_id": F.col("transaction_id"), "issued_at": F.col("issued_at"), "issuer": F.lit(issuer), "compliance_frameworks": F.array(*map(F.lit, FRAMEWORKS)),
        "pii_classes_detected": lists[0], "pii_classes_redacted": lists[1], "payload_char_count_in": n[0], "payload_char_count_out": n[1], "chars_removed": n[0] - n[1],
        "zero_pii_egress_confirmed": zero_egress(*lists), "downstream_target": F.col("downstream_target"), "_id": F.concat(F.lit("rcpt_"), F.coalesce("transaction_id", F.lit("")), F.lit("_")),
    }
    some = lambda *names: _inside(canonical_json({k: made[k] for k in names}))
    quoted = _inside(canonical_json({"receipt_id": made["_id"]}))  # without its last quote the id's number follows
    parts = F.array(
        F.concat(F.lit(","), some(*[c for c in made if "chain_position" < c < "previous_receipt_hash" and c != "_id"]), F.lit(',"previous_receipt_hash":"')),
        F.concat(F.lit('",'), F.substring(quoted, F.lit(1), F.length(quoted) - 1)),
        F.concat(F.lit('",'), some("transaction_id", "zero_pii_egress_confirmed"), F.lit("}")),
    )
    return events.withColumn("parts", parts).withColumns({k: v for k, v in made.items() if k != "_id"})


def sign(key: bytes, position: int, before: str, parts: list[str]) -> str:
    """The hash of the receipt at a position, which holds the hash of the one before."""
    message = f'{{"chain_position":{position}{parts[0]}{before}{parts[1]}{position:06d}{parts[2]}'
    return hmac.new(key, message.encode(), hashlib.sha256).hexdigest()


def heads(receipts: DataFrame) -> DataFrame:
    """chain_id, head_hash, length of chains: what issue() needs to append to them."""
    return receipts.groupBy("chain_id").agg(F.max_by("receipt_hash", "chain_position").alias("head_hash"), (F.max("chain_position") + 1).alias("length"))


def as_receipts(signed: DataFrame) -> DataFrame:
    """RECEIPT of the rows of signed_parts that have position, before and hash as well."""
    own = {"receipt_id": F.concat(F.lit("rcpt_"), F.coalesce("transaction_id", F.lit("")), F.format_string("_%06d", F.col("position"))), "previous_receipt_hash": F.col("before"), "receipt_hash": F.col("hash"), "chain_position": F.col("position")}
    return signed.select(*[own.get(c, F.col(c)).alias(c) for c in RECEIPT_FIELDS])


def issue(events: DataFrame, key: bytes, order: list[str], issuer: str = ISSUER, seed: str = GENESIS, after: DataFrame | None = None) -> DataFrame:
    """Signed receipts (RECEIPT) of events: chain_id, transaction_id, issued_at (text), detected, redacted (arrays), char_in, char_out, downstream_target.

    Each receipt signs the hash of the one before, so a chain is serial by definition; it streams through one task in
    `order` with the last hash as the only state, and chains run side by side. Only the HMAC is made there: the signed text
    comes from built-in expressions before. Memory doesn't grow with a chain's length. `after` (see heads) has the hash and
    the length of chains that exist; their receipts follow on them, those of other chains begin at the genesis hash.
    """
    first = genesis_hash(seed)
    ready = signed_parts(events, issuer)
    if after is None:
        ready = ready.withColumn("_head", F.lit(first)).withColumn("_length", F.lit(0))
    else:
        known = after.select(F.col("chain_id").alias("_chain"), F.col("head_hash").alias("_h"), F.col("length").cast("int").alias("_n"))
        ready = ready.join(known, F.col("chain_id").eqNullSafe(F.col("_chain")), "left").drop("_chain")
        ready = ready.withColumn("_head", F.coalesce("_h", F.lit(first))).withColumn("_length", F.coalesce("_n", F.lit(0))).drop("_h", "_n")
    kept = [c for c in ready.columns if c in RECEIPT_FIELDS or c in order or c in ("chain_id", "parts", "_head", "_length")]
    ready = ready.select(*kept).repartition("chain_id").sortWithinPartitions("chain_id", *order)
    schema = T.StructType([*ready.schema.fields, T.StructField("position", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("hash", T.StringType())])
    at = {c: i for i, c in enumerate(kept)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, prev, position = object(), "", 0
        for b in batches:
            out: tuple[list, list, list] = ([], [], [])
            for own, parts, head, n in zip(*(b.column(at[c]).to_pylist() for c in ("chain_id", "parts", "_head", "_length"))):
                if own != chain:
                    chain, prev, position = own, head, n
                digest = sign(key, position, prev, parts)
                for column, value in zip(out, (position, prev, digest)):
                    column.append(value)
                prev, position = digest, position + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out[0], pa.int32()), pa.array(out[1], pa.string()), pa.array(out[2], pa.string())], [*kept, "position", "before", "hash"])

    ship_package(events.sparkSession)
    return as_receipts(ready.mapInArrow(run, schema))


def signature(key: bytes) -> Column:
    """What receipt_hash must be, from the row's own fields."""
    return hmac_sha256(canonical_json({c: F.col(c) for c in SIGNED}), key)


def check_links(receipts: DataFrame, key: bytes | None, seed: str = GENESIS) -> DataFrame:
    """Each receipt with signature_ok, link_ok and unique_ok. The receipt before comes by an equi-join on chain and position, so a long chain is spread over all tasks. key=None skips the signature."""
    before = receipts.groupBy("chain_id", (F.col("chain_position") + 1).alias("chain_position")).agg(F.min("receipt_hash").alias("_expected"), F.count("*").alias("_same"))
    own = receipts.groupBy("chain_id", "chain_position").agg(F.count("*").alias("_copies"))
    joined = receipts.join(before, ["chain_id", "chain_position"], "left").join(own, ["chain_id", "chain_position"])
    expected = F.when(F.col("chain_position") == 0, F.lit(genesis_hash(seed))).otherwise(F.col("_expected"))
    return joined.select(
        *receipts.columns,
        (F.lit(True) if key is None else F.col("receipt_hash").eqNullSafe(signature(key))).alias("signature_ok"),
        F.coalesce(F.col("previous_receipt_hash") == expected, F.lit(False)).alias("link_ok"),
        (F.col("_copies") == 1).alias("unique_ok"),
    )


def verify(receipts: DataFrame, key: bytes | None, seed: str = GENESIS) -> DataFrame:
    """chain_id, receipts, valid, first_bad: signatures hold, each links to the one before, positions run from 0 without gap or repeat.

    A table without rows has no invalid chain. Cutting off a chain's tail isn't seen: keep length and head elsewhere.
    """
    ok = F.col("signature_ok") & F.col("link_ok") & F.col("unique_ok")
    per = check_links(receipts, key, seed).groupBy("chain_id").agg(
        F.count("*").alias("receipts"), F.bool_and(ok).alias("_ok"), F.min("chain_position").alias("_lo"), F.max("chain_position").alias("_hi"),
        F.min(F.when(~ok, F.col("chain_position"))).alias("first_bad"))
    return per.select("chain_id", "receipts", (F.col("_ok") & (F.col("_lo") == 0) & (F.col("_hi") == F.col("receipts") - 1)).alias("valid"), "first_bad")


def latest_receipt(receipts: DataFrame, by: str = "transaction_id") -> DataFrame:
    """Of each transaction the receipt with the highest position."""
    rest = [c for c in receipts.columns if c != by]
    return receipts.groupBy(by).agg(F.max_by(F.struct(*rest), F.struct("chain_position", "receipt_hash")).alias("r")).select(by, "r.*")


def event_payload(receipts: DataFrame, event_type: str = "scrub", source: str = "veilspark") -> DataFrame:
    """The exported form of a receipt: classes, frameworks, links and position, without counts, issuer and target."""
    return receipts.select(
        F.lit(event_type).alias("event_type"), F.lit(source).alias("source"), "receipt_id", "transaction_id", "issued_at", "compliance_frameworks",
        "pii_classes_detected", "pii_classes_redacted", "zero_pii_egress_confirmed", "chain_position", "receipt_hash", "previous_receipt_hash")
