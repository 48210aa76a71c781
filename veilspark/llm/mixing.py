"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..functions.keys import norm_key
from ..session import cut, spread

#: Running sums go by bucket of a source's shuffled texts, or slice of virtual time, first, and then within it; as many of them as leave so many rows for each.
ROWS_A_BUCKET = 100_000
#: The table of targets is a list of sources made by hand; it comes to the driver, and more rows than this are an error.
MOST_SOURCES = 10_000


def _running(df: DataFrame, group: list[str], bucket: str, order: list, amount: str) -> DataFrame:
    """Adds `before`: the sum of `amount` over the group's rows ahead in (bucket, order). Two levels, so a group may hold any share of the rows."""
    sums = df.groupBy(*group, bucket).agg(F.sum(amount).alias("_s"))
    base = sums.select(*group, bucket, (F.sum("_s").over(W.partitionBy(*group).orderBy(bucket).rowsBetween(W.unboundedPreceding, 0)) - F.col("_s")).alias("_base"))
    inner = df.withColumn("_in", F.sum(amount).over(W.partitionBy(*group, bucket).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)) - F.col(amount))
    return inner.join(base, [*group, bucket]).withColumn("before", F.col("_base") + F.col("_in")).drop("_base", "_in")


def _virtual_end(targets: list[dict], budget: int) -> float:
    """The virtual time at which min(weight * time, capacity), summed over the sources, is the budget; the last finish if all together is less."""
    open_ = [(t["capacity"] / t["weight"], t) for t in targets if t["capacity"] and t["weight"] > 0]
    full, weight, last = 0.0, sum(t["weight"] for _, t in open_), 0.0
    for at, t in sorted(open_, key=lambda x: x[0]):
        if full + weight * at >= budget:
            return max((budget - full) / weight, 1e-300)
        full, weight, last = full + t["capacity"], weight - t["weight"], at
    return max(last, 1e-300)


def mix(texts: DataFrame, targets: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(mix, shares): texts of the sources in `targets` in an order in which every stretch has about the target shares.

    texts: doc_id long, source str, text_key (equal for equal texts), tokens long; it is read several times and should be
    a written table. targets: source str, target_share double, max_repeats int. Sources are equal up to case and blanks
    around; of a source named twice in targets the shares add up and the largest max_repeats holds.

    The budget is the token count of all rows whose source is in targets. Copies are one text, which belongs to the
    source of its smallest doc_id and is used max_repeats times at most (null: once). Texts of no tokens are left out.
    Each text in its source's shuffled order finishes at virtual time (tokens of its source up to and with it) / weight;
    a further round of the source follows on the round before. All uses are range-sorted by that time, ties by source,
    doc_id and round, and cut where the budget is full: the last use is the one that still fits. A source that has too little for its share is used up,
    and the others go on in the proportion of their weights. Weights of 0 or null give nothing. Empty tables give an empty mix.

    mix (not sorted; its order is that of cum_tokens): doc_id, source, use_no (from 0), tokens, finish, cum_tokens (with this use). shares: source, target_share,
    actual_share, tokens, uses, texts, max_uses, budget.
    """
    named = targets.select(norm_key(F.col("source")).alias("source"), F.col("target_share").cast("double").alias("w"), F.greatest(F.coalesce(F.col("max_repeats"), F.lit(1)), F.lit(0)).alias("rep"))
    want = [r.asDict() for r in named.where(F.col("source").isNotNull()).groupBy("source").agg(F.coalesce(F.sum("w"), F.lit(0.0)).alias("w"), F.max("rep").alias("rep")).limit(MOST_SOURCES + 1).collect()]
    if len(want) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources in the table of targets")
    spark = texts.sparkSession
    small = F.broadcast(spark.createDataFrame([(r["source"], r["w"], int(r["rep"])) for r in want], "source string, w double, rep int"))
    docs = texts.select("doc_id", norm_key(F.col("source")).alias("source"), "text_key", F.col("tokens").cast("long").alias("tokens")).join(small, "source")
    budget = docs.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("b")).first()["b"]
    best = docs.where(F.col("tokens") > 0).groupBy("text_key").agg(F.min_by(F.struct("doc_id", "source", "tokens", "w", "rep"), "doc_id").alias("d")).select("d.*")
    unique = cut(best.withColumn("_h", F.xxhash64(F.lit(seed), "doc_id")))  # read for the sums and for the queue
    sums = {r["source"]: (r["t"], r["n"]) for r in unique.groupBy("source").agg(F.sum("tokens").alias("t"), F.count("*").alias("n")).collect()}
    held = {k: t for k, (t, _) in sums.items()}
    plan = [{"weight": r["w"], "capacity": held.get(r["source"], 0) * r["rep"]} for r in want]
    end = _virtual_end(plan, budget)

    buckets = max([n for _, n in sums.values()], default=0) // ROWS_A_BUCKET + 1
    # The hash's upper 40 bits in `buckets` equal parts, so that buckets are in the order of the hash.
    top = F.shiftrightunsigned("_h", 24)
    shuffled = unique.where((F.col("w") > 0) & (F.col("rep") > 0)).withColumn("_b", F.floor(top * F.lit(buckets) / F.lit(float(1 << 40))))
    placed = _running(shuffled.withColumn("_top", top), ["source"], "_b", ["_top", "_h", "doc_id"], "tokens")
    totals = F.broadcast(spark.createDataFrame(list(held.items()), "source string, held long"))
    rounds = placed.join(totals, "source").withColumn("use_no", F.explode(F.sequence(F.lit(0), F.col("rep") - 1)))
    queue = rounds.withColumn("finish", (F.col("use_no") * F.col("held") + F.col("before") + F.col("tokens")) / F.col("w")).select("doc_id", "source", "use_no", "tokens", "finish")
    # Past twice the virtual end nothing is taken, as every source still has its share or is used up by then.
    queue = cut(queue.where(F.col("finish") <= 2 * end + 1e-9))  # both levels of the sums read it
    slices = queue.count() // ROWS_A_BUCKET + 1
    sorted_ = _running(queue.withColumn("_all", F.lit(0)).withColumn("_slice", F.floor(F.col("finish") / end * slices)), ["_all"], "_slice", ["finish", "source", "doc_id", "use_no"], "tokens")
    order = cut(sorted_.withColumn("cum_tokens", F.col("before") + F.col("tokens")).where(F.col("cum_tokens") <= budget).select("doc_id", "source", "use_no", "tokens", "finish", "cum_tokens"))  # the mix and its shares read it
    per = order.groupBy("source", "doc_id").agg(F.sum("tokens").alias("t"), F.count("*").alias("u")).groupBy("source").agg(F.sum("t").alias("tokens"), F.sum("u").alias("uses"), F.count("*").alias("texts"), F.max("u").alias("max_uses"))
    total = per.agg(F.sum("tokens").alias("total"))
    none = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    shares = small.join(per, "source", "left").select(
        "source", F.col("w").alias("target_share"), F.coalesce(F.try_divide("tokens", total.scalar()), F.lit(0.0)).alias("actual_share"),
        none("tokens"), none("uses"), none("texts"), none("max_uses"), F.lit(budget).cast("long").alias("budget"),
    )
    return order, shares


def token_table(docs: DataFrame, tokens, text: str = "text") -> DataFrame:
    """doc_id, source, text_key and tokens of each document, cut from its lineage in the shared folder: texts are encoded once."""
    return cut(spread(docs.select("doc_id", "source", text)).select("doc_id", "source", F.sha2(F.col(text), 256).alias("text_key"), tokens.alias("tokens")))
