"""Mergeable daily sketches: state that is written once a day and merged for any period.

An opt-in beside the exact reports. Distinct users are kept as HyperLogLog sketches and values as KLL quantile
sketches; a merge of days reads a few kilobytes per day and group and never goes back to events. Both are estimates:
the distinct count has a relative standard error of ``hll_error``, the rank of a quantile one of some ``kll_error``.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from math import sqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_LOG_SIZE = 12  # 2**12 registers
KLL_SIZE = 200


def hll_error(log_size: int = HLL_LOG_SIZE) -> float:
    """Relative standard error of a distinct count; merged sketches have the error of one sketch."""
    return 1.04 / sqrt(2 ** log_size)


def kll_error(size: int = KLL_SIZE) -> float:
    """Error of a quantile's rank, as a share of all values, that 99 of 100 sketches of this size keep."""
    return 2.446 / size ** 0.9433


def daily_state(
    df: DataFrame, date: Column, by: Sequence[str], distinct: Mapping[str, str] | None = None, values: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per day and group: ``n_rows`` and a named sketch per column of ``distinct`` and ``values``.

    NULLs are in no sketch; a group without values has an empty or NULL one. NULL days and groups are groups.
    """
    return df.groupBy(date.alias("day"), *by).agg(
        F.count(F.lit(1)).alias("n_rows"),
        *[F.hll_sketch_agg(c, F.lit(HLL_LOG_SIZE)).alias(name) for name, c in (distinct or {}).items()],
        *[F.kll_sketch_agg_double(F.col(c).cast("double"), F.lit(KLL_SIZE)).alias(name) for name, c in (values or {}).items()],
    )


def merged(
    state: DataFrame, by: Sequence[str | Column], distinct: Sequence[str] = (), values: Mapping[str, Mapping[str, float]] | None = None
) -> DataFrame:
    """Estimates per group ``by`` of daily state: each distinct count under its sketch's name, and for each sketch of values
    the named quantiles."""
    sketches = values or {}
    out = state.groupBy(*by).agg(
        F.sum("n_rows").alias("n_rows"),
        *[F.hll_sketch_estimate(F.hll_union_agg(c)).alias(c) for c in distinct],
        *[F.kll_merge_agg_double(c).alias(c) for c in sketches],
    )
    return out.withColumns({
        name: F.kll_sketch_get_quantile_double(F.col(c), F.lit(float(p))) for c, ps in sketches.items() for name, p in ps.items()
    }).drop(*sketches)
