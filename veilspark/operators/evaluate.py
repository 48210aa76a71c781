"""Detection quality, latency quantiles, reports and roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import ENTITY_FLAGS, OTHER_TOOLS, QUALITY_CASES
from ..functions.running import running
from ..sources.sinks import at_most
from .scrub import scrub


def quality_cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *c) for i, c in enumerate(QUALITY_CASES)], "case_id int, text string, expected_token string, pii_class string")


def confusion(cases: DataFrame) -> DataFrame:
    """Per class true and false positives and negatives. A positive case needs its token; a negative one must not have a placeholder of its class."""
    done = scrub(cases, "case_id", "text")
    own = F.concat(F.lit("[REDACTED_"), F.when(F.col("pii_class").startswith("PCI"), F.lit("PAN")).otherwise(F.lit("SSN")), F.lit("]"))
    hit = F.when(F.col("expected_token").isNotNull(), F.col("clean_text").contains(F.col("expected_token"))).otherwise(F.col("clean_text").contains(own))
    pos = F.col("expected_token").isNotNull()
    n = lambda c, a: F.count_if(c).alias(a)
    return done.groupBy("pii_class").agg(n(pos & hit, "true_positives"), n(~pos & hit, "false_positives"), n(~pos & ~hit, "true_negatives"), n(pos & ~hit, "false_negatives"), F.count("*").alias("test_cases_run"))


def rates(counts: DataFrame) -> DataFrame:
    """Detection and false-positive rate, 0 where nothing could be counted, to four places."""
    rate = lambda a, b: F.round(F.coalesce(F.try_divide(F.col(a), F.col(a) + F.col(b)), F.lit(0.0)), 4)
    return counts.withColumn("detection_rate", rate("true_positives", "false_negatives")).withColumn("false_positive_rate", rate("false_positives", "true_negatives"))


def index_quantile(df: DataFrame, by: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per group the sorted values at place int(n * share), counted from 0, and the median p50. Exact, and nothing is collected:
    counts per value merge map-side, and their running sums go over ranges of values, so a group may hold all rows."""
    freq = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_c"))
    ranked = running(freq, by, [value], "_c", "_lo")
    n = ranked.groupBy(*[F.col(c).alias(f"_n{i}") for i, c in enumerate(by)]).agg(F.sum("_c").alias("_n"))
    same = F.lit(True)
    for i, c in enumerate(by):
        same = same & F.col(c).eqNullSafe(F.col(f"_n{i}"))
    ranked = ranked.join(n, same)
    at = lambda s: F.floor(F.col("_n") * s)
    covers = lambda place: (F.col("_lo") + F.col("_c") > place) & (F.col("_lo") <= place)
    pick = lambda place: F.max(F.when(covers(place), F.col(value)))
    median = (pick(F.floor((F.col("_n") - 1) / 2)) + pick(F.floor(F.col("_n") / 2))) / 2
    return ranked.groupBy(*by).agg(median.alias("p50"), *[pick(at(s)).alias(a) for a, s in shares.items()])


TOOL = "tool string, ssn_rate double, pan_rate double, p50_latency_ms double, note string, reversible boolean, receipts boolean, proxy boolean"


def other_tools(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OTHER_TOOLS, TOOL)


def leaves(note: Column) -> Column:
    """Whether a tool's note says that data leaves the place."""
    return F.lower(note).rlike("egress|cloud|network")


def _mark(c: Column) -> Column:
    return F.when(c, F.lit("✅")).otherwise(F.lit("❌"))


def report_rows(own: DataFrame, others: DataFrame) -> DataFrame:
    """One Markdown table row a tool: rates as whole per cent, latency, whether data stays inside (by the note), and two capabilities."""
    both = own.unionByName(others)
    return both.select("tool", F.format_string("| %s | %.0f%% | %.0f%% | %.0fms | %s | %s | %s |", "tool", F.col("ssn_rate") * 100, F.col("pan_rate") * 100, "p50_latency_ms", _mark(~leaves(F.col("note"))), _mark(F.col("reversible")), _mark(F.col("receipts"))).alias("line"))


CAPABILITIES = {"Reversible redaction": "reversible", "Signed receipts": "receipts", "Proxy mode": "proxy"}


def capability_rows(tools: DataFrame) -> DataFrame:
    """One row a capability: its name and a Markdown line with a mark for each tool, tools by name."""
    has = {**{k: F.col(v) for k, v in CAPABILITIES.items()}, "No data leaves": ~leaves(F.col("note"))}
    long = tools.select("tool", F.explode(F.map_from_arrays(F.array(*map(F.lit, has)), F.array(*has.values()))).alias("capability", "has"))
    per = long.groupBy("capability").agg(F.array_sort(F.collect_list(F.struct("tool", "has"))).alias("t"))
    return per.select("capability", F.concat(F.lit("| "), "capability", F.lit(" | "), F.array_join(F.transform("t", lambda x: _mark(x["has"])), " | "), F.lit(" |")).alias("line"))


def report(rows: DataFrame, capabilities: DataFrame | None = None, tools: list[str] | None = None, cases: int = len(QUALITY_CASES)) -> str:
    """The Markdown report: how it was measured, what is detected, one table row a tool (more than 1,000 are an error), and, with the
    rows of capability_rows and their tools by name, a table of capabilities."""
    lines = [
        "# Detection quality", "", "## Method", "", f"- {cases} sentences with numbers, cards or both; invalid ones among them must stay.", "- Rates are of numbers and cards only, on these sentences.",
        "- Other tools: their published figures. Latency: the median of a sentence.", "", "## Detected", "", "Numbers and cards (checked), " + ", ".join(p.lower().replace("_", " ") for _, p in ENTITY_FLAGS.values()) + ".", "",
        "## Comparison", "", "| Tool | SSN | PAN | p50 | Data stays | Reversible | Receipts |", "|---|---|---|---|---|---|---|"]
    lines += [r["line"] for r in at_most(rows.orderBy("tool"))]
    if capabilities is not None:
        names = sorted(tools or [])
        lines += ["", "## Capabilities", "", "| Capability | " + " | ".join(names) + " |", "|---" * (len(names) + 1) + "|"]
        lines += [r["line"] for r in at_most(capabilities.orderBy("capability"))]
    return "\n".join(lines) + "\n"


def flag_names(flags: Column) -> Column:
    """Names of the flags with a count, sorted and joined, or CLEAN."""
    names = F.array_sort(F.map_keys(F.map_filter(flags, lambda k, v: v > 0)))
    return F.when(F.size(names) == 0, F.lit("CLEAN")).otherwise(F.array_join(names, ", "))


def placeholder_classes(text: Column) -> Column:
    """Kind of each placeholder in a text, in order: ssn, pan or generic."""
    found = F.regexp_extract_all(text, F.lit(r"\[REDACTED_[A-Z_]+\]"), F.lit(0))
    return F.transform(found, lambda p: F.when(p.contains("SSN"), F.lit("ssn")).when(p.rlike("PAN|CARD|CC"), F.lit("pan")).otherwise(F.lit("generic")))
