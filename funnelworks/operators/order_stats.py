"""Exact order statistics that no single task has to hold."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.operators.events import null_safe_join
from funnelworks.sources.storage import materialise


def _sorted_table(df: DataFrame, order: Sequence[Column], label: str) -> DataFrame:
    """Range-partitioned sort, written once, with ``_task`` and ``_position`` (order within the task).

    Writing makes positions stay the same however often, or after whatever loss, they are read.
    """
    running = df.orderBy(*order).withColumn("_id", F.monotonically_increasing_id())
    # The running id holds the task number above the row number.
    task = F.shiftright("_id", 33)
    return materialise(running, label).withColumns({"_task": task, "_position": F.col("_id") - F.shiftleft(task, 33)}).drop("_id")


def _task_starts(ordered: DataFrame, weight: Column) -> DataFrame:
    """Total weight ahead of each sort task: one row per task, so bounded by the shuffle partitions."""
    before = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    return (
        ordered.groupBy("_task").agg(F.sum(weight).alias("_weight"))
        .select("_task", F.coalesce(F.sum("_weight").over(before), F.lit(0)).alias("_start"))
    )


def with_row_index(df: DataFrame, order: Sequence[Column], name: str = "row_index") -> DataFrame:
    """Add the dense 0-based position of each row in ``order``, without a one-task window.

    End ``order`` with a unique column: rows equal on all of it land in one sort task.
    """
    ordered = _sorted_table(df, order, name)
    starts = F.broadcast(_task_starts(ordered, F.lit(1)))
    return (
        ordered.join(starts, "_task")
        .withColumn(name, F.col("_start") + F.col("_position"))
        .select(*df.columns, name)
    )


def exact_quantiles(
    df: DataFrame,
    by: Sequence[str],
    value: str,
    probs: Mapping[str, float],
) -> DataFrame:
    """Exact, linearly interpolated quantiles of ``value`` per group; NULLs are skipped.

    Distinct values are counted, sorted across the cluster, and read off at the wanted cumulative
    counts, so no task holds a group, whatever its size.
    """
    if not by:
        return exact_quantiles(df.withColumn("_all", F.lit(0)), ["_all"], value, probs).drop("_all")
    rows = df.select(*by, F.col(value).cast("double").alias("_value")).filter(F.col("_value").isNotNull())
    # Counting first makes a value that fills a large part of a group a single row.
    counted = rows.groupBy(*by, "_value").agg(F.count(F.lit(1)).alias("_count"))
    ordered = _sorted_table(counted, [F.col(c) for c in [*by, "_value"]], "quantiles")
    in_task = Window.partitionBy("_task").orderBy("_position")
    running = ordered.withColumn("_upto", F.sum("_count").over(in_task))
    ranked = running.join(F.broadcast(_task_starts(ordered, F.col("_count"))), "_task").withColumns({
        "_upto": F.col("_start") + F.col("_upto"),
        "_from": F.col("_start") + F.col("_upto") - F.col("_count"),
    })
    groups = ranked.groupBy(*by).agg(F.min("_from").alias("_first"), F.sum("_count").alias("_n"))
    placed = null_safe_join(ranked, groups, by)

    def at(position: Column, weight: Column) -> Column:
        wanted = F.col("_first") + position
        return F.sum(F.when((F.col("_from") <= wanted) & (wanted < F.col("_upto")), F.col("_value") * weight))

    out = []
    for name, p in probs.items():
        k = F.lit(float(p)) * (F.col("_n") - 1)
        part = k - F.floor(k)
        out.append((at(F.floor(k), F.lit(1.0) - part) + at(F.ceil(k), part)).alias(name))
    return placed.groupBy(*by).agg(*out)


def modes(levels: DataFrame, by: Sequence[str], value: str, count: str) -> DataFrame:
    """Most frequent value (smallest on a tie) and number of values per group, from counted values."""
    return levels.filter(F.col(value).isNotNull()).groupBy(*by).agg(
        F.min_by(value, F.struct(-F.col(count), F.col(value))).alias("mode"), F.count(F.lit(1)).alias("levels")
    )
