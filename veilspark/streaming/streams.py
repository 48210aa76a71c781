"""The pipeline over streams: stateless scrub, windowed flags, chains with state."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..constants import GENESIS, ISSUER
from ..operators.attest import RECEIPT_FIELDS, as_receipts, genesis_hash, sign, signed_parts
from ..operators.scrub import explode_flags, scrub
from ..session import ship_package
from ..sources.sinks import dispatch


def scrub_stream(stream: DataFrame, transaction_id: str, text: str) -> DataFrame:
    return scrub(stream, transaction_id, text)


def flag_windows(df: DataFrame, time: str, transaction_id: str, text: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of flags in tumbling windows; on a stream, rows later than `late` behind the newest are left out."""
    timed = df.withColumn("_at", F.col(time).cast("timestamp"))
    timed = timed.withWatermark("_at", late) if df.isStreaming else timed
    flags = explode_flags(scrub(timed, transaction_id, text), "_at")
    return flags.groupBy(F.window("_at", width), "flag").agg(F.sum("count").alias("n")).select(F.col("window.start").alias("start"), "flag", "n")


def receipt_stream(events: DataFrame, key: bytes, issuer: str = ISSUER, seed: str = GENESIS) -> DataFrame:
    """Signed receipts of a stream of events (as attest.issue takes them, with `seq` for the order in a batch), by the same
    signature. The state of a chain is its last hash and length. As a micro-batch of a chain must be put in order, it is held
    in memory: bound it by the source's own limit per trigger."""
    first = genesis_hash(seed)
    ready = signed_parts(events, issuer)
    ready = ready.select("seq", "parts", *[c for c in ready.columns if c in RECEIPT_FIELDS])
    schema = T.StructType([*ready.schema.fields, T.StructField("position", T.IntegerType()), T.StructField("before", T.StringType()), T.StructField("hash", T.StringType())])
    ship_package(events.sparkSession)

    def run(chain: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        prev, position = state.get if state.exists else (first, 0)
        rows = pd.concat(list(batches)).sort_values("seq", kind="stable")
        places, before, hashes = [], [], []
        for parts in rows["parts"]:
            places.append(int(position))
            before.append(prev)
            prev = sign(key, position, prev, list(parts))
            hashes.append(prev)
            position += 1
        state.update((prev, int(position)))
        yield rows.assign(position=places, before=before, hash=hashes)

    return as_receipts(ready.groupBy("chain_id").applyInPandasWithState(run, schema, "prev string, position int", "append", GroupStateTimeout.NoTimeout))


def webhook_writer(url: str | None, report: Callable[[int, dict[bool, int]], None] | None = None, **options) -> Callable[[DataFrame, int], None]:
    """For writeStream.foreachBatch: posts a batch's events. Failures are counted, not raised: `report` gets the batch's number
    and how many events were sent (True) and weren't (False); without it the counts go to the log, as a warning where some weren't."""

    def write(batch: DataFrame, number: int) -> None:
        counts = {r["sent"]: r["count"] for r in dispatch(batch, url, **options).groupBy("sent").count().collect()}
        if report is not None:
            report(number, counts)
        else:
            logging.getLogger(__name__).log(logging.WARNING if counts.get(False) else logging.INFO, "batch %d: %d events sent, %d not", number, counts.get(True, 0), counts.get(False, 0))

    return write
