"""Time helpers for zone-less timestamps; differences and days do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_DAY = 86_400.0


def parse_timestamp(c: Column, fmt: str | None = None) -> Column:
    """Timestamp without zone; text that does not parse becomes NULL instead of an error.

    A format goes through the session time zone: keep it at UTC, where every local hour exists.
    """
    if fmt is None:
        return c.try_cast("timestamp_ntz")
    return F.try_to_timestamp(c, F.lit(fmt)).cast("timestamp_ntz")


def day(c: Column) -> Column:
    return F.to_date(c)


def week_start(c: Column) -> Column:
    """Monday of the week as a DATE."""
    d = F.to_date(c)
    return F.date_sub(d, F.weekday(d))


def add_days(c: Column, days: int) -> Column:
    return c + F.make_dt_interval(F.lit(days))


def fractional_days(start: Column, end: Column) -> Column:
    """Length of [start, end] in days; a day has 24 hours whatever the session time zone does."""
    seconds = (end - start).cast("interval second").cast("decimal(20,6)")
    return seconds.cast("double") / F.lit(SECONDS_PER_DAY)


def whole_days(start: Column, end: Column) -> Column:
    """Days from start to end, floored, so that five minutes before the start is -1."""
    return F.floor(fractional_days(start, end))
