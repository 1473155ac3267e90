"""Text helpers with the missing-value and white-space rules the jobs rely on."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING_TEXT = "nan"  # fixed value: how a missing label reads once turned into text


def as_text(c: Column) -> Column:
    """Text of a value, with a missing one spelled out so that concatenation keeps the row."""
    return F.coalesce(c.cast("string"), F.lit(MISSING_TEXT))


def strip(c: Column) -> Column:
    """Remove all leading and trailing white space (``trim`` removes blanks only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normalised(c: Column) -> Column:
    return strip(F.lower(as_text(c)))
