"""All registered queries and the SQL they are checked against."""

from __future__ import annotations

from importlib import import_module

MODULES = ("data_queries", "scrub_queries", "ledger_queries", "report_queries")


def collect(kind: str) -> dict:
    """QUERIES or ORACLE of all modules; a name given twice is an error."""
    out: dict = {}
    for m in MODULES:
        own = getattr(import_module(f"veilspark.plans.{m}"), kind)
        if twice := out.keys() & own.keys():
            raise ValueError(f"registered twice: {sorted(twice)}")
        out |= own
    return out
