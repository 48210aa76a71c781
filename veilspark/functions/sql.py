"""The scalar functions for use in SQL text."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..constants import CITATIONS
from ..operators.detect import PAN, SSN


def _quoted(text: str) -> str:
    return "r'" + text.replace("'", "''") + "'"


def register(spark: SparkSession) -> list[str]:
    """Temporary SQL functions, inlined into plans as the expressions they are: ssn_count, ssn_redact, luhn_valid, pan_count, citation."""
    digits = r"regexp_replace(translate(s, '٠١٢٣٤٥٦٧٨٩０１２３４５６７８９', '01234567890123456789'), r'\D', '')"
    luhn = f"""length({digits}) BETWEEN 13 AND 19 AND aggregate(transform(split(reverse({digits}), ''), (d, i) -> CASE WHEN i % 2 = 0 THEN int(d) WHEN int(d) > 4 THEN int(d) * 2 - 9 ELSE int(d) * 2 END), 0, (a, x) -> a + coalesce(x, 0)) % 10 = 0"""
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CITATIONS.items())
    made = {
        "ssn_count": ("INT", f"regexp_count(s, {_quoted(SSN)})"),
        "ssn_redact": ("STRING", f"regexp_replace(s, {_quoted(SSN)}, '[REDACTED_SSN]')"),
        "luhn_valid": ("BOOLEAN", luhn),
        "pan_count": ("INT", f"size(filter(regexp_extract_all(s, {_quoted(PAN)}, 0), c -> luhn_valid(c)))"),
        "citation": ("STRING", f"CASE s {cases} END"),
    }
    done = []
    for name, (kind, body) in made.items():
        if name == "pan_count":
            body = f"size(filter(regexp_extract_all(s, {_quoted(PAN)}, 0), c -> {luhn.replace('(s,', '(c,')}))"
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS {kind} RETURN {body}")
        done.append(name)
    return done
