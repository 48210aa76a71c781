"""Keys and instants that are written in several ways."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The code points that str.isspace() holds true for (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x1c\x1d\x1e\x1f\x85\xa0                　"


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE_SPACE))


def norm_key(c: Column) -> Column:
    """The key without white space around it and in lower case; a blank key is null."""
    t = F.lower(trimmed(c))
    return F.when(t != "", t)


def instant(c: Column) -> Column:
    """ISO 8601 text, with T or a blank, with any fraction of a second and with Z, an offset or nothing (UTC), as a timestamp.

    What can't be read is null.
    """
    t = F.upper(trimmed(c))
    zoned = t.rlike(r"[0-9](Z|UTC|[+-][0-9]{2}:?[0-9]{2}|[+-][0-9]{2})$") & t.rlike("[T ][0-9]{2}:")
    full = F.regexp_replace(t, r"([+-][0-9]{2})([0-9]{2})$", "$1:$2")
    full = F.regexp_replace(full, r"([T ][0-9:.]+[+-][0-9]{2})$", "$1:00")
    timed = F.when(zoned, full).otherwise(F.concat(t, F.when(t.rlike("[T ][0-9]{2}:"), F.lit("Z")).otherwise(F.lit("T00:00:00Z"))))
    return F.when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), timed).try_cast("timestamp")


def utc(c: Column) -> Column:
    """A timestamp without zone, which is UTC, as an instant. The session's time zone must be UTC."""
    return c.cast("timestamp")
