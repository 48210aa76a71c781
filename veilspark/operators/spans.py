"""Overlapping spans: merging, flags, placeholders, redaction."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..constants import PRIORITY
from ..functions.arrays import chunks, let
from .detect import SPANS

_EMAIL, _URL = "HIPAA_PHI_EMAIL", "HIPAA_PHI_URL"


def overlaps(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    """Half-open: touching spans don't overlap."""
    return (s1 < e2) & (s2 < e1)


def contains(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return (s1 <= s2) & (e2 <= e1)


def priority(placeholder: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in PRIORITY.items() for x in kv])
    return F.coalesce(F.try_element_at(table, placeholder), F.lit(0))


def preferred(current: Column, candidate: Column) -> Column:
    """The candidate only if it ranks strictly higher."""
    return F.when(priority(candidate) > priority(current), candidate).otherwise(current)


def _flags(last: Column, x: Column) -> Column:
    """The union of both; an address of mail swallows the web address that lies inside it, whichever came first."""
    has = lambda f, name: F.array_contains(f, name)
    inside_old = has(last["f"], _EMAIL) & has(x["f"], _URL) & contains(last["s"], last["e"], x["s"], x["e"])
    inside_new = has(x["f"], _EMAIL) & has(last["f"], _URL) & contains(x["s"], x["e"], last["s"], last["e"])
    union = F.array_union(last["f"], x["f"])
    return F.when(inside_old | inside_new, F.array_remove(union, _URL)).otherwise(union)


def sort_spans(spans: Column) -> Column:
    """By start, then the longer first, then by the recogniser's order: the natural order of structs with these fields first."""
    keyed = F.transform(spans, lambda a: F.struct(a["s"].alias("a"), (a["s"] - a["e"]).alias("b"), a["o"].alias("c"), a.alias("x")))
    return F.transform(F.sort_array(keyed), lambda k: k["x"])


def merge_spans(spans: Column) -> Column:
    """Spans sorted and folded, each overlapping one into the last: least start, greatest end, flags united, the preferred placeholder."""
    join = lambda last, x: F.struct(F.least(last["s"], x["s"]).alias("s"), F.greatest(last["e"], x["e"]).alias("e"), _flags(last, x).alias("f"), preferred(last["p"], x["p"]).alias("p"), last["o"].alias("o"))

    none = F.array().cast(SPANS)

    def step(a: Column, x: Column) -> Column:
        last = F.get(a["last"], F.lit(0))
        meets = (F.size(a["last"]) > 0) & overlaps(last["s"], last["e"], x["s"], x["e"])
        return F.struct(F.when(meets, a["out"]).otherwise(F.concat(a["out"], a["last"])).alias("out"), F.when(meets, F.array(join(last, x))).otherwise(F.array(x)).alias("last"))

    def outer(a: Column, chunk: Column) -> Column:
        inner = F.aggregate(chunk, F.struct(none.alias("out"), a["last"].alias("last")), step)
        return let(inner, lambda r: F.struct(F.concat(a["outs"], F.array(r["out"])).alias("outs"), r["last"].alias("last")))

    zero = F.struct(F.array().cast(f"array<{SPANS}>").alias("outs"), none.alias("last"))
    folded = lambda ordered: F.aggregate(chunks(ordered), zero, outer, lambda a: F.flatten(F.concat(a["outs"], F.array(a["last"]))))
    return let(spans, lambda x: F.when(F.size(x) < 2, x).otherwise(let(sort_spans(x), folded)))


def redact(text: Column, merged: Column) -> Column:
    """The text with [REDACTED_<placeholder>] in place of each span; spans are in order and don't overlap. The gaps between them
    are cut in one look each, chunk by chunk, and joined once."""
    mark = lambda x: F.concat(F.lit("[REDACTED_"), x["p"], F.lit("]"))
    return F.when(F.size(merged) > 0, replaced(text, merged, "s", "e", mark)).otherwise(text)


def replaced(text: Column, pieces: Column, start: str, end: str, mark: Callable[[Column], Column]) -> Column:
    """The text with `mark` of each piece in its place. So that no look at a place begins at the text's start again, the text is first cut
    at every CHUNKth piece, from the rest each time, and within such a part by the piece."""

    def part(state: Column, chunk: Column) -> Column:
        to = F.element_at(chunk, -1)[end]
        here = F.substring(state["rest"], F.lit(1), to - state["at"])
        inner = lambda h: F.array_join(F.flatten(F.transform(F.zip_with(F.concat(F.array(state["at"]), F.transform(F.slice(chunk, F.lit(1), F.size(chunk) - 1), lambda x: x[end])), chunk, lambda a, x: F.struct(a.alias("a"), x.alias("x"))), lambda y: F.array(F.substring(h, y["a"] - state["at"] + 1, y["x"][start] - y["a"]), mark(y["x"])))), "")
        return F.struct(to.alias("at"), F.substring(state["rest"], to - state["at"] + 1, F.length(state["rest"])).alias("rest"), F.concat(state["out"], F.array(let(here, inner))).alias("out"))

    zero = F.struct(F.lit(0).alias("at"), text.alias("rest"), F.array().cast("array<string>").alias("out"))
    return F.aggregate(chunks(pieces), zero, part, lambda a: F.concat(F.array_join(a["out"], ""), a["rest"]))


def span_islands(exploded: DataFrame, doc: str) -> DataFrame:
    """Islands of overlapping spans by windows over one row a span (columns doc, s, e): doc, s, e, n. The set-based form of merge_spans' geometry."""
    w = W.partitionBy(doc).orderBy("s", F.col("s") - F.col("e"))
    reach = F.max("e").over(w.rowsBetween(W.unboundedPreceding, -1))
    marked = exploded.withColumn("_new", F.when(reach.isNull() | (F.col("s") >= reach), 1).otherwise(0))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(doc, "_island").agg(F.min("s").alias("s"), F.max("e").alias("e"), F.count("*").alias("n")).drop("_island")
