"""Aggregate expressions that stay NULL where a statistic is undefined."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation over complete pairs; NULL for a constant, one-row or empty input.

    The built-in ``corr`` raises a division error on a constant column in ANSI mode.
    """
    both = x.isNotNull() & y.isNotNull()
    xx, yy = F.when(both, x.cast("double")), F.when(both, y.cast("double"))
    return F.try_divide(F.covar_samp(xx, yy), F.stddev_samp(xx) * F.stddev_samp(yy))


def r2(truth: Column, predicted: Column) -> Column:
    """Coefficient of determination as one aggregate; NULL when the truth is constant."""
    sse = F.sum((truth - predicted) * (truth - predicted))
    return F.lit(1.0) - F.try_divide(sse, F.var_pop(truth) * F.count(truth))
