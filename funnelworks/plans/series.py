"""Time series tests: organic share, spend lags, SKAN against last click, halo, share of voice."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.ratios import fill, is_not, plain_ratio
from funnelworks.functions.stats import safe_corr
from funnelworks.functions.time import day, week_start
from funnelworks.operators.events import daily_users
from funnelworks.operators.series import lag_correlation, rolling_zscore, shift_fit, top_extremes
from funnelworks.operators.shares import mix_share

# Fixed values.
LAGS = range(15)
LEADS = (0, 1, 3, 7)
ROLLING_DAYS = 14
Z_THRESHOLD = 3.0


def daily_installs(events: DataFrame) -> DataFrame:
    """Distinct installers per day, platform and source."""
    return daily_users(events, "install", "installs", by=("platform", "source"), keep_null_keys=False)


def _named_spend(spend: DataFrame) -> DataFrame:
    rows = spend.select(day(F.col("date")).alias("event_date"), "channel", "spend", "impressions", "clicks")
    return rows.dropna(subset=["event_date", "channel"])


def spend_daily_channel(spend: DataFrame) -> DataFrame:
    """Spend, impressions and clicks per day and named channel."""
    return _named_spend(spend).groupBy("event_date", "channel").agg(
        *[fill(F.sum(m)).alias(m) for m in ("spend", "impressions", "clicks")]
    )


def daily_spend(spend: DataFrame) -> DataFrame:
    """Total spend per day over the named channels."""
    return _named_spend(spend).groupBy("event_date").agg(fill(F.sum("spend")).alias("paid_spend_total"))


def daily_installs_pivot(daily: DataFrame, sources: Sequence[str] | None = None) -> DataFrame:
    """One row per day and platform, one column per source, 0 where there was none.

    Name the sources to save the extra job that finds them. A source that is not among them, or NULL, is an
    error, since its installs would have no column.
    """
    if sources:
        unlisted = F.raise_error(F.concat(F.lit("installs of a source that is not listed: "), F.coalesce("source", F.lit("NULL"))))
        daily = daily.withColumn("source", F.when(F.col("source").isin(list(sources)), F.col("source")).otherwise(unlisted.cast("string")))
    pivoted = daily.groupBy("event_date", "platform").pivot("source", list(sources) if sources else None)
    wide = pivoted.agg(F.sum("installs"))
    return wide.fillna(0, subset=[c for c in wide.columns if c not in ("event_date", "platform")])


def organic_share_from_pivot(pivot: DataFrame, organic_in_paid: bool = True) -> DataFrame:
    """Organic and paid totals of a pivoted day, by adding up its source columns."""
    sources = [c for c in pivot.columns if c not in ("event_date", "platform")]
    organic = F.col("Organic") if "Organic" in sources else F.lit(0)
    paid = reduce(lambda a, b: a + b, [F.col(f"`{c}`") for c in sources if c != "Organic"], F.lit(0))
    totals = pivot.select("event_date", "platform", organic.cast("bigint").alias("organic_installs"), paid.cast("bigint").alias("_paid"))
    return _with_share(totals, organic_in_paid)


def organic_share_daily(daily: DataFrame, organic_in_paid: bool = True) -> DataFrame:
    """Organic and paid installs and the organic share per day and platform.

    By default ``paid_installs`` includes the organic ones, so that share = organic / (2·organic + paid):
    the definition the published analysis uses. ``organic_in_paid=False`` gives organic / all.
    """
    organic = F.col("source") == "Organic"
    totals = daily.groupBy("event_date", "platform").agg(
        fill(F.sum(F.when(organic, F.col("installs")))).alias("organic_installs"),
        fill(F.sum(F.when(~organic, F.col("installs")))).alias("_paid"),
    )
    return _with_share(totals, organic_in_paid)


def _with_share(totals: DataFrame, organic_in_paid: bool) -> DataFrame:
    organic = F.col("organic_installs")
    paid = F.col("_paid") + organic if organic_in_paid else F.col("_paid")
    return totals.withColumn("paid_installs", paid).drop("_paid").withColumn(
        "organic_share", plain_ratio(organic, organic + F.col("paid_installs"))
    )


def organic_series(events: DataFrame, spend: DataFrame, organic_in_paid: bool = True) -> DataFrame:
    """Daily organic share per platform next to that day's total spend."""
    share = organic_share_daily(daily_installs(events), organic_in_paid)
    return share.join(daily_spend(spend), "event_date", "left").withColumn(
        "paid_spend_total", fill(F.col("paid_spend_total").cast("double"), 0.0)
    )


def lag_corr_spend_organic(series: DataFrame, lags: Sequence[int] = LAGS, forward: bool = False) -> DataFrame:
    """Spend against organic installs ``lag_days`` rows earlier, or later when ``forward``."""
    return lag_correlation(
        series, "paid_spend_total", "organic_installs", lags, by=["platform"], direction="lead" if forward else "lag"
    )


def organic_share_scores(series: DataFrame, window: int = ROLLING_DAYS) -> DataFrame:
    scored = rolling_zscore(series, "organic_share", ["platform"], window=window, name="z_organic_share")
    return scored.select("event_date", "platform", "organic_share", "z_organic_share", "paid_spend_total")


def organic_share_anomalies(series: DataFrame, threshold: float = Z_THRESHOLD, limit: int | None = None) -> DataFrame:
    """Days whose organic share lies at least ``threshold`` rolling deviations away, highest first."""
    flagged = organic_share_scores(series).filter(F.abs("z_organic_share") >= threshold)
    ordered = flagged.orderBy(F.col("z_organic_share").desc(), "event_date", "platform")
    return ordered if limit is None else ordered.limit(limit)


def organic_share_extremes(series: DataFrame, per_platform: int = 10, limit: int | None = None) -> DataFrame:
    """The most extreme days per platform, whether or not they pass a threshold."""
    top = top_extremes(organic_share_scores(series), "z_organic_share", ["platform"], per_platform)
    ordered = top.orderBy(F.col("abs_z").desc(), "event_date", "platform")
    return ordered if limit is None else ordered.limit(limit)


def skan_daily_network(skan: DataFrame) -> DataFrame:
    return (
        skan.select(day(F.col("postback_date")).alias("event_date"), "network", "install_count")
        .dropna(subset=["event_date", "network"])
        .groupBy("event_date", "network").agg(fill(F.sum("install_count")).alias("install_count"))
    )


def skan_series(skan: DataFrame, events: DataFrame, platform: str = "ios") -> DataFrame:
    """Aggregated-postback installs and last-click paid installs per day; 0 where one side has none."""
    skan_total = skan_daily_network(skan).groupBy("event_date").agg(F.sum("install_count").alias("skan_installs_total"))
    paid = daily_users(
        events.filter((F.col("platform") == platform) & is_not("source", "Organic")),
        "install", "lastclick", by=("source",), keep_null_keys=False,
    )
    paid_total = paid.groupBy("event_date").agg(F.sum("lastclick").alias("lastclick_paid_installs_total"))
    return skan_total.join(paid_total, "event_date", "full").fillna(0)


def skan_vs_lastclick(series: DataFrame, limit: int | None = None) -> DataFrame:
    """Days with the largest surplus of postback installs over last-click installs first."""
    gap = F.col("skan_installs_total") - F.col("lastclick_paid_installs_total")
    ordered = series.withColumn("skan_minus_lastclick", gap).orderBy(F.col("skan_minus_lastclick").desc(), "event_date")
    return ordered if limit is None else ordered.limit(limit)


def skan_shift_fit(series: DataFrame, shifts: Sequence[int] = range(5)) -> DataFrame:
    """How well postbacks moved by 0..4 rows match last-click installs."""
    return shift_fit(series, "skan_installs_total", "lastclick_paid_installs_total", shifts)


def halo_series(events: DataFrame, spend: DataFrame) -> DataFrame:
    """Spend and organic installs per day over all platforms, on the days with spend."""
    organic = daily_users(
        events.filter(F.col("source") == "Organic"), "install", "organic_installs", by=(), keep_null_keys=False
    )
    total = (
        spend.select(day(F.col("date")).alias("event_date"), "spend").dropna(subset=["event_date"])
        .groupBy("event_date").agg(fill(F.sum("spend")).cast("double").alias("paid_spend_total"))
    )
    return total.join(organic, "event_date", "left").withColumn("organic_installs", fill("organic_installs"))


def halo_lag_corr(series: DataFrame, leads: Sequence[int] = LEADS) -> DataFrame:
    """Spend against later organic installs, on levels (raw) and on day-to-day changes (diff)."""
    def corr(diff: bool) -> DataFrame:
        return lag_correlation(series, "paid_spend_total", "organic_installs", leads, direction="lead", diff=diff)

    return corr(False).withColumn("kind", F.lit("raw")).unionByName(corr(True).withColumn("kind", F.lit("diff")))


def weekly_spend_share(spend: DataFrame) -> DataFrame:
    weekly = (
        spend.select(week_start(F.col("date")).alias("week"), "channel", "spend")
        .dropna(subset=["week", "channel"])
        .groupBy("week", "channel").agg(fill(F.sum("spend")).alias("spend"))
    )
    return mix_share(weekly, ["week"], "spend", "spend_share")


def weekly_installs(events: DataFrame) -> DataFrame:
    """Distinct installers per week and source."""
    return daily_users(
        events, "install", "installs", by=("source",),
        period=week_start(F.col("event_timestamp")), period_name="week", keep_null_keys=False,
    )


def weekly_paid_install_share(weekly: DataFrame) -> DataFrame:
    return mix_share(weekly.filter(is_not("source", "Organic")), ["week"], "installs", "paid_install_share")


def weekly_organic_share(weekly: DataFrame) -> DataFrame:
    return weekly.groupBy("week").agg(
        F.sum("installs").alias("total_installs"),
        fill(F.sum(F.when(F.col("source") == "Organic", F.col("installs")))).alias("organic_installs"),
    ).withColumn("organic_share_all", plain_ratio("organic_installs", "total_installs"))


def share_of_voice(spend: DataFrame, events: DataFrame, channel: str = "TikTok") -> DataFrame:
    """One channel's spend share and paid install share per week, with the organic share of all installs."""
    weekly = weekly_installs(events)
    voice = weekly_spend_share(spend).filter(F.col("channel") == channel).select("week", "spend_share")
    paid = weekly_paid_install_share(weekly).filter(F.col("source") == channel).select("week", "paid_install_share")
    organic = weekly_organic_share(weekly).select("week", "organic_share_all")
    return voice.join(paid, "week", "full").join(organic, "week", "left").fillna(0.0)


def share_of_voice_delta_corr(voice: DataFrame) -> DataFrame:
    """Correlation of week-to-week changes of spend share with those of the two install shares."""
    w = Window.partitionBy().orderBy("week")
    columns = ["spend_share", "paid_install_share", "organic_share_all"]
    d = voice.select(*[(F.col(c) - F.lag(c, 1).over(w)).alias(c) for c in columns])
    return d.agg(
        safe_corr(F.col("spend_share"), F.col("organic_share_all")).alias("corr_spend_organic"),
        safe_corr(F.col("spend_share"), F.col("paid_install_share")).alias("corr_spend_install"),
    )
