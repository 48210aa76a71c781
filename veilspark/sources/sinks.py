"""Sinks: events to a web hook, chains and reports to files."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def post(url: str, body: bytes, headers: dict[str, str], timeout: float) -> int:
    request = urllib.request.Request(url, data=body, headers=headers, method="POST")
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return answer.status


def dispatch(events: DataFrame, url: str | None, token: str | None = None, timeout: float = 3.0, send: Callable[[str, bytes, dict, float], int] = post, header: str = "Authorization", prefix: str | None = None) -> DataFrame:
    """receipt_id, sent: each event posted as JSON from the task that holds it. Never fails a job: no address, an error or a status other than 2xx is false.

    A token goes into the header named; `prefix` stands before it, `Bearer ` in Authorization and nothing in others where it is
    None. An event may be posted again if its task is retried; receivers tell copies by receipt_id.
    """
    lead = prefix if prefix is not None else "Bearer " if header.lower() == "authorization" else ""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        headers = {"Content-Type": "application/json"} | ({header: lead + token} if token else {})
        for b in batches:
            sent = []
            for body in b["body"]:
                try:
                    sent.append(bool(url) and 200 <= send(url, body.encode(), headers, timeout) < 300)
                except Exception:  # noqa: BLE001
                    sent.append(False)
            yield pd.DataFrame({"receipt_id": b["receipt_id"], "sent": sent})

    return events.select("receipt_id", F.to_json(F.struct(*events.columns), {"ignoreNullFields": "false"}).alias("body")).mapInPandas(run, "receipt_id string, sent boolean")


def export_chain(receipts: DataFrame, path: str) -> None:
    """Receipts in order of chain and position, as JSON lines."""
    receipts.orderBy("chain_id", "chain_position").write.mode("overwrite").json(path)


def write_report(text: str, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(text)


#: Small tables come to the driver; more rows than this are an error.
MOST_ROWS = 1000


def at_most(rows: DataFrame, most: int = MOST_ROWS) -> list[Row]:
    few = rows.limit(most + 1).collect()
    if len(few) > most:
        raise ValueError(f"more than {most} rows")
    return few


def write_results(rows: DataFrame, path: str) -> None:
    """A small result table as one indented JSON file; more than MOST_ROWS rows are an error, before anything is written."""
    few = at_most(rows)
    with open(path, "w", encoding="utf-8") as f:
        json.dump([r.asDict(True) for r in few], f, indent=2, default=str)
