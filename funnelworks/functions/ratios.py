"""Arithmetic that yields NULL, never NaN or an ANSI error, when a value is not defined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def _double(c: ColumnLike) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("double")


def guarded_ratio(num: ColumnLike, den: ColumnLike, scale: int = 1) -> Column:
    """``scale * num / den`` where the denominator is positive, else NULL."""
    n, d = _double(num), _double(den)
    return F.when(d > 0, (n if scale == 1 else F.lit(float(scale)) * n) / d)


def plain_ratio(num: ColumnLike, den: ColumnLike) -> Column:
    """``num / den`` for any sign of the denominator; NULL on zero."""
    return F.try_divide(_double(num), _double(den))


def is_not(c: ColumnLike, value) -> Column:
    """``c != value`` that is true for NULL, so that rows without a value are kept."""
    return ~(F.col(c) if isinstance(c, str) else c).eqNullSafe(F.lit(value))


def fill(c: ColumnLike, value=0) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(value))


def clip(c: Column, low: float | None = None, high: float | None = None) -> Column:
    """Clip to [low, high]; a NULL stays NULL (``greatest`` and ``least`` alone would drop it)."""
    out = c
    if low is not None:
        out = F.greatest(out, F.lit(low))
    if high is not None:
        out = F.least(out, F.lit(high))
    return F.when(c.isNotNull(), out)
