"""Operators on attribution events."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.time import day

CONVERSIONS = ("install", "registration")
DAY_GRAIN = ("event_name", "user_id", "event_date", "source", "campaign_id", "platform", "country")
SALTS = 64  # parts that a hot key is split into
HOT_KEYS = 100
HOT_SHARE = 0.01  # of the larger side's rows
KEYS_TRACKED = 4_096


def tie_columns(df: DataFrame, tie: str, fallback: Sequence[str]) -> list[str]:
    """The row id when the table has one, else columns that make the order deterministic."""
    return [tie] if tie in df.columns else [c for c in fallback if c in df.columns]


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left") -> DataFrame:
    """Equi-join in which NULL keys match each other; keeps the left side's key columns.

    Each ``<=>`` is planned as a hash key on (coalesced value, is-null flag), so the join stays
    distributed. Only for left and inner joins.
    """
    renamed = right.withColumnsRenamed({k: f"__r_{k}" for k in on})
    condition = reduce(lambda a, b: a & b, [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in on])
    return left.join(renamed, condition, how).drop(*[f"__r_{k}" for k in on])


def hot_keys(df: DataFrame, on: Sequence[str], share: float = HOT_SHARE) -> list[int]:
    """Hashes of the keys, NULLs included, that hold more than ``share`` of the rows: at most a hundred.

    A frequent-items sketch of one column of hashes, so only the key columns are read.
    """
    sketch = F.expr(f"approx_top_k(_key, {HOT_KEYS}, {KEYS_TRACKED})")
    found = df.select(F.xxhash64(*on).alias("_key")).agg(sketch.alias("top"), F.count("*").alias("n")).first()
    return [r["item"] for r in found["top"] or [] if r["count"] > share * found["n"]]


def salted_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", hot: Sequence[int] | None = None) -> DataFrame:
    """``null_safe_join`` in which rows of a hot key of ``left`` are spread over many tasks.

    Rows of a hot key get one of ``SALTS`` salts by the hash of the whole row, which a repeated task repeats; the
    matching rows of ``right`` are copied to every salt. All other keys have salt 0, so nothing else is copied.
    ``hot`` names the hashes of the hot keys; by default a sketch of ``left`` finds them.
    """
    hot = list(hot_keys(left, on) if hot is None else hot)
    if not hot:
        return null_safe_join(left, right, on, how)
    is_hot = F.xxhash64(*on).isin(hot)
    every = F.sequence(F.lit(0), F.lit(SALTS - 1))
    salted = left.withColumn("_salt", F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")).otherwise(0))
    copied = right.withColumn("_salt", F.explode(F.when(is_hot, every).otherwise(F.array(F.lit(0)))))
    return null_safe_join(salted, copied, [*on, "_salt"], how).drop("_salt")


def user_days(events: DataFrame, tie: str = "event_id", kinds: Sequence[str] = CONVERSIONS) -> DataFrame:
    """The first event of each user, day, kind, source, campaign, platform and country, and ``n_events`` of them.

    It has the columns of events, so whatever counts distinct users or looks for first events can read it in their
    place; written once, it serves all such reports from one scan of events. A table that is one already is returned
    as it is. The first event is the one of the smallest (time, ``tie``): a number in one aggregation buffer, which
    Spark sums up by hashing, where a structure would make it sort all rows.
    """
    if "n_events" in events.columns:
        return events
    ts = F.col("event_timestamp")
    keys = [c for c in DAY_GRAIN if c in events.columns or c == "event_date"]
    rows = events.filter(F.col("event_name").isin(*kinds)).withColumn("event_date", day(ts))
    counted = F.count(F.lit(1)).alias("n_events")
    if tie not in events.columns:
        return rows.groupBy(*keys).agg(F.min(ts).alias("event_timestamp"), counted)
    if events.schema[tie].dataType.simpleString() != "bigint":
        first = F.min(F.struct(ts, F.col(tie))).alias("first")
        return rows.groupBy(*keys).agg(first, counted).select(*keys, "first.*", "n_events")
    # Times of one day count from its start, or from 0 where there is no time; ids are shifted to be positive.
    passed = F.coalesce(F.timestamp_diff("MICROSECOND", day(ts).cast("timestamp_ntz"), ts), F.lit(0))
    width, shift = F.lit(str(2 ** 64)).cast("decimal(20,0)"), F.lit(str(2 ** 63)).cast("decimal(20,0)")
    packed = (passed.cast("decimal(17,0)") * width + (F.col(tie).cast("decimal(20,0)") + shift)).cast("decimal(38,0)")
    least = rows.groupBy(*keys).agg(F.min(ts).alias("event_timestamp"), F.min(packed).alias("_least"), counted)
    return least.withColumn(tie, (F.col("_least") - passed.cast("decimal(17,0)") * width - shift).cast("bigint")).drop("_least")


def first_event(
    events: DataFrame,
    event_name: str,
    key: str = "user_id",
    ts: str = "event_timestamp",
    tie: str = "event_id",
) -> DataFrame:
    """Earliest event of one kind per key; missing timestamps come last.

    ``row_number() = 1`` is pruned to one row per key inside every map task before the shuffle,
    so a key with very many events costs no more than any other.
    """
    rest = [c for c in events.columns if c not in (key, ts)]
    order = [F.col(ts).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_columns(events, tie, rest)]]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return events.filter(F.col("event_name") == event_name).withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def daily_users(
    events: DataFrame,
    event_name: str,
    measure: str,
    by: Sequence[str] = ("source", "campaign_id"),
    period: Column | None = None,
    period_name: str = "event_date",
    keep_null_keys: bool = True,
) -> DataFrame:
    """Distinct users of one event kind per period and key.

    A single distinct count is planned as two aggregations, the first spread over (keys, user).
    """
    when = day(F.col("event_timestamp")) if period is None else period
    rows = events.filter(F.col("event_name") == event_name).select(when.alias(period_name), *by, "user_id")
    keys = [period_name, *by]
    if not keep_null_keys:
        rows = rows.dropna(subset=keys)
    return rows.groupBy(*keys).agg(F.count_distinct("user_id").alias(measure))
