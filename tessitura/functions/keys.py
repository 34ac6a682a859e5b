"""Normalised keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(text: Column) -> Column:
    """Without surrounding white space of any kind (Spark's trim drops U+0020 only)."""
    return F.regexp_replace(text, r"^[\s\p{Z}\x85\x1c-\x1f]+|[\s\p{Z}\x85\x1c-\x1f]+$", "")


def loose_id(text: Column) -> Column:
    """Lower case without surrounding white space."""
    return F.lower(strip(text))
