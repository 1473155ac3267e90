"""Operators on day- or week-grain series: shifts move by row, as the series stands.

Their input is one row per period (and group), so the windows here are bounded by the calendar.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Literal

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.stats import safe_corr


def _ordered(by: Sequence[str], order: str):
    return Window.partitionBy(*by).orderBy(F.col(order).asc_nulls_last())


def lag_correlation(
    df: DataFrame,
    x: str,
    y: str,
    lags: Sequence[int],
    by: Sequence[str] = (),
    order: str = "event_date",
    direction: Literal["lag", "lead"] = "lag",
    diff: bool = False,
) -> DataFrame:
    """Correlation of ``x`` with ``y`` shifted by each number of rows, as (by…, lag_days, corr).

    ``lag`` pairs x with earlier y, ``lead`` with later y. ``diff`` correlates row-to-row changes.
    All lags are computed in one aggregation.
    """
    w = _ordered(by, order)
    series = df.select(*by, order, F.col(x).alias("_x"), F.col(y).alias("_y"))
    if diff:
        series = series.select(*by, order, *[(F.col(c) - F.lag(c, 1).over(w)).alias(c) for c in ("_x", "_y")])
    shift = F.lag if direction == "lag" else F.lead
    shifted = series.select(*by, "_x", *[shift("_y", k).over(w).alias(f"_y{k}") for k in lags])
    wide = shifted.groupBy(*by).agg(*[safe_corr(F.col("_x"), F.col(f"_y{k}")).alias(f"_c{k}") for k in lags])
    rows = F.array(*[F.struct(F.lit(k).alias("lag_days"), F.col(f"_c{k}").alias("corr")) for k in lags])
    return wide.select(*by, F.inline(rows))


def shift_fit(df: DataFrame, x: str, y: str, shifts: Sequence[int] = range(5), order: str = "event_date") -> DataFrame:
    """Correlation and mean absolute error of ``x`` moved down by each number of rows against ``y``."""
    w = _ordered((), order)
    shifted = df.select(F.col(y).alias("_y"), *[F.lag(x, k).over(w).alias(f"_x{k}") for k in shifts])
    wide = shifted.agg(
        *[safe_corr(F.col(f"_x{k}"), F.col("_y")).alias(f"_c{k}") for k in shifts],
        *[F.avg(F.abs(F.col(f"_x{k}") - F.col("_y")).cast("double")).alias(f"_m{k}") for k in shifts],
    )
    rows = [
        F.struct(F.lit(k).alias("shift_days"), F.col(f"_c{k}").alias("corr"), F.col(f"_m{k}").alias("mae"))
        for k in shifts
    ]
    return wide.select(F.inline(F.array(*rows)))


def rolling_zscore(
    df: DataFrame,
    col: str,
    by: Sequence[str],
    order: str = "event_date",
    window: int = 14,
    min_periods: int | None = None,
    name: str = "z",
) -> DataFrame:
    """Distance from the rolling mean in rolling sample deviations, current row included.

    NULL with fewer than ``min_periods`` values (default: half the window, at least 3) or no spread.
    """
    need = max(3, window // 2) if min_periods is None else min_periods
    w = _ordered(by, order).rowsBetween(-(window - 1), 0)
    score = F.try_divide(F.col(col) - F.avg(col).over(w), F.stddev_samp(col).over(w))
    return df.withColumn(name, F.when(F.count(col).over(w) >= need, score))


def top_extremes(df: DataFrame, score: str, by: Sequence[str], k: int = 10, order: str = "event_date") -> DataFrame:
    """The ``k`` rows with the largest absolute score per group, with that value as ``abs_z``."""
    scored = df.filter(F.col(score).isNotNull()).withColumn("abs_z", F.abs(F.col(score)))
    w = Window.partitionBy(*by).orderBy(F.col("abs_z").desc(), F.col(order).asc())
    return scored.withColumn("_rank", F.row_number().over(w)).filter(F.col("_rank") <= k).drop("_rank")
