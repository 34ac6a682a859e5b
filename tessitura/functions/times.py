"""Lenient time parsing that doesn't depend on the session's time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What an unreadable or missing time counts as: before every other.
FIRST_INSTANT = -(2**62)

_OFFSET = r"(?:[zZ]|[+-]\d{2}:?\d{2})$"


def parse_instant(text: Column) -> Column:
    """ISO date, date-time or date-time with offset to timestamp; without an
    offset it is UTC; null if unreadable."""
    t = F.regexp_replace(text, r"^\s+|\s+$", "")
    dated = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.concat(t, F.lit("T00:00:00Z")))
    return F.try_to_timestamp(dated.when(t.rlike(_OFFSET), t).otherwise(F.concat(t, F.lit("Z"))))


def instant_micros(text: Column) -> Column:
    """Microseconds since 1970 of ``parse_instant``; unreadable: ``FIRST_INSTANT``."""
    return F.coalesce(F.unix_micros(parse_instant(text)), F.lit(FIRST_INSTANT))


def ntz_micros(ts: Column) -> Column:
    """Microseconds of a timestamp without zone, read as UTC; null stays null."""
    return F.unix_micros(F.try_to_timestamp(F.concat(ts.cast("string"), F.lit("Z"))))


def month_of(ts: Column) -> Column:
    """``yyyy-MM`` of a timestamp without zone."""
    return F.substring(ts.cast("string"), 1, 7)
