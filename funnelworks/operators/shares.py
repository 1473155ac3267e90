"""Shares within groups and of grand totals, on already aggregated tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.ratios import guarded_ratio, plain_ratio


def mix_share(df: DataFrame, group: Sequence[str], measure: str, name: str = "share") -> DataFrame:
    """Each row's part of its group's total."""
    return df.withColumn(name, plain_ratio(F.col(measure), F.sum(measure).over(Window.partitionBy(*group))))


def share_of_total(df: DataFrame, measure: str, name: str) -> DataFrame:
    """Each row's part of the grand total, when that total is positive.

    For report tables (one row per channel): the window runs in one task.
    """
    return df.withColumn(name, guarded_ratio(F.col(measure), F.sum(measure).over(Window.partitionBy())))


def organic_paid_ratio(users: DataFrame, by: str) -> DataFrame:
    """Distinct users in total, from organic and from any other source per ``by``.

    Expects one row per event with ``user_id`` and ``source``. Users are reduced to two flags first,
    so that the three distinct counts share one shuffle.
    """
    organic = F.col("source").eqNullSafe(F.lit("Organic"))
    per_user = (
        users.filter(F.col(by).isNotNull())
        .groupBy(by, "user_id")
        .agg(F.max(organic.cast("int")).alias("organic"), F.max((~organic).cast("int")).alias("paid"))
    )
    known = F.col("user_id").isNotNull()
    return per_user.groupBy(by).agg(
        F.count("user_id").alias("installs_total"),
        F.count_if(known & (F.col("organic") == 1)).alias("installs_organic"),
        F.count_if(known & (F.col("paid") == 1)).alias("installs_paid"),
    ).withColumns({
        "organic_share": plain_ratio("installs_organic", "installs_total"),
        "organic_to_paid_ratio": guarded_ratio("installs_organic", "installs_paid"),
    })
