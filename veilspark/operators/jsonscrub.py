"""Scrubbing JSON bodies: text under prompt keys, and bodies that are no JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import DROPPED_HEADERS, TEXT_KEYS
from ..functions.arrays import let
from ..session import ship_package
from .nested import whole_json
from .scrub import scrubbed


def _walk(value, key, fn):
    """A copy of a JSON value with fn applied to each string whose own key is a prompt key; strings in a list have no key of their own."""
    if isinstance(value, dict):
        return {k: _walk(v, k, fn) for k, v in value.items()}
    if isinstance(value, list):
        return [_walk(v, None, fn) for v in value]
    if isinstance(value, str) and key is not None and key.lower() in TEXT_KEYS:
        return fn(value)
    return value


def _json_texts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Of each body its prompt texts in order; null for what is no JSON."""
    for b in batches:
        rows = []
        for body in b.to_pylist():
            try:
                texts: list[str] = []
                _walk(json.loads(body), None, lambda s, t=texts: t.append(s) or s)
                rows.append(texts)
            except (TypeError, ValueError, RecursionError):
                rows.append(None)
        yield pa.array(rows, pa.list_(pa.string()))


def _json_fill(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for bodies, cleans in batches:
        rows = []
        for body, clean in zip(bodies.to_pylist(), cleans.to_pylist()):
            left = iter(clean or [])
            rows.append(None if clean is None else json.dumps(_walk(json.loads(body), None, lambda s, t=left: next(t))))
        yield pa.array(rows, pa.string())


def scrub_bodies(df: DataFrame, row_id: str, body: str) -> DataFrame:
    """row_id, body (scrubbed), is_json, texts (the prompt texts, scrubbed), flags (map of counts), bytes_in, bytes_out.

    In JSON, strings whose own key is a prompt key are scrubbed at any depth and flags add up over them; all else passes,
    and the body is written again with ASCII escapes. What is no JSON is scrubbed as text. Null stays null; repeated rows are
    each scrubbed. Narrow steps only: the pipeline is an expression over the array of a body's texts. Only walking the tree is
    Python, once to take the texts out and once to put them back.
    """
    ship_package(df.sparkSession)
    # Named nondeterministic so that no use of their results evaluates them again.
    take, fill = (F.arrow_udf(f, kind).asNondeterministic() for f, kind in ((_json_texts, "array<string>"), (_json_fill, "string")))
    base = df.select(F.col(row_id), F.col(f"`{body}`").cast("string").alias("_b"))
    base = base.select(row_id, "_b", take("_b").alias("_texts"))
    plain = F.when(F.col("_texts").isNull(), F.when(F.col("_b").isNotNull(), F.array("_b"))).otherwise(F.col("_texts"))
    done = base.select(row_id, "_b", F.col("_texts").isNotNull().alias("is_json"), F.transform(plain, scrubbed).alias("_d"))
    entries = F.flatten(F.transform("_d", lambda d: F.transform(F.map_entries(d["flags"]), lambda e: F.struct(e["key"].alias("k"), e["value"]["count"].alias("n")))))
    total = let(entries, lambda es: F.map_from_entries(F.transform(F.array_sort(F.array_distinct(F.transform(es, lambda e: e["k"]))), lambda k: F.struct(k.alias("key"), F.aggregate(F.filter(es, lambda e: e["k"] == k), F.lit(0), lambda a, e: a + e["n"]).alias("value")))))
    texts = F.transform("_d", lambda d: d["clean_text"])
    done = done.select(row_id, "_b", "is_json", texts.alias("texts"), F.coalesce(total, F.create_map().cast("map<string,int>")).alias("flags"))
    done = done.select("*", fill("_b", F.when(F.col("is_json"), F.col("texts"))).alias("_f"))
    out = done.withColumn("body", F.when(F.col("is_json"), F.col("_f")).otherwise(F.get("texts", F.lit(0))))
    return out.select(row_id, "body", "is_json", "texts", "flags", F.octet_length("_b").alias("bytes_in"), F.octet_length("body").alias("bytes_out"))


def is_json(body: Column) -> Column:
    return whole_json(body).isNotNull()


def decode(body: Column) -> Column:
    """Bytes as UTF-8, invalid ones replaced."""
    return F.make_valid_utf8(body.cast("string"))


def forward_headers(headers: Column, length: Column) -> Column:
    """Without the headers that aren't forwarded, whatever their case, and with the new content length."""
    kept = F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*DROPPED_HEADERS))
    return F.map_concat(kept, F.create_map(F.lit("content-length"), length.cast("string")))


def resolve_target(target: Column, known: dict[str, str], strict: bool = True) -> Column:
    """A known name's address, else the text itself; an empty one is an error, or null with strict=False."""
    table = F.create_map(*[F.lit(x) for kv in known.items() for x in kv]) if known else F.create_map().cast("map<string,string>")
    none = F.raise_error(F.lit("no target")) if strict else F.lit(None).cast("string")
    return F.when(F.coalesce(F.trim(target), F.lit("")) == "", none).otherwise(F.coalesce(F.try_element_at(table, target), target))
