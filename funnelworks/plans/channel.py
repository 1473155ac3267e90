"""Channel performance: daily panel, campaign and channel KPIs, 30-day revenue of registered users."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.ratios import fill, guarded_ratio, is_not
from funnelworks.functions.time import add_days, day
from funnelworks.operators.events import daily_users, first_event, null_safe_join
from funnelworks.operators.intervals import FEE_RATE, fee_revenue_interval
from funnelworks.operators.shares import share_of_total

# Fixed values.
NO_CAMPAIGN = "__NO_CAMPAIGN__"
WINDOW_DAYS = 30

PANEL_KEYS = ["event_date", "channel", "campaign_id"]
MEASURES = ["spend", "impressions", "clicks", "installs", "registrations"]


def media_ratios(spend: str, impressions: str, clicks: str, prefix: str = "", ctr_scale: int = 1) -> dict[str, Column]:
    """CTR (as a fraction unless scaled), cost per click and cost per thousand impressions."""
    return {
        f"{prefix}CTR": guarded_ratio(clicks, impressions, ctr_scale),
        f"{prefix}CPC": guarded_ratio(spend, clicks),
        f"{prefix}CPM": guarded_ratio(spend, impressions, 1000),
    }


def installs_daily(events: DataFrame) -> DataFrame:
    return daily_users(events, "install", "installs")


def registrations_daily(events: DataFrame) -> DataFrame:
    return daily_users(events, "registration", "registrations")


def _spend_rows(spend: DataFrame) -> DataFrame:
    return spend.select(
        day(F.col("date")).alias("event_date"), "channel", "campaign_id", "campaign_name", "spend", "impressions", "clicks"
    )


def _with_smallest_name(rows: DataFrame, measures: Sequence[str]) -> DataFrame:
    """Sums per panel key, with the smallest campaign name standing for the key.

    Summing per name first keeps the large step a hash aggregation: a text minimum would make
    Spark sort all rows instead.
    """
    per_name = rows.groupBy(*PANEL_KEYS, "campaign_name").agg(*[F.sum(m).alias(m) for m in measures])
    return per_name.groupBy(*PANEL_KEYS).agg(
        *[fill(F.sum(m)).alias(m) for m in measures], F.min("campaign_name").alias("campaign_name")
    )


def spend_daily_campaign(spend: DataFrame) -> DataFrame:
    """Spend, impressions and clicks per day and campaign."""
    return _with_smallest_name(_spend_rows(spend), ["spend", "impressions", "clicks"])


def _conversion_rows(events: DataFrame) -> DataFrame:
    """One row per converting user, day, campaign and kind, flagged 1 as an install or a registration."""
    kind = F.col("event_name")
    users = (
        events.filter(kind.isin("install", "registration"))
        .select(day(F.col("event_timestamp")).alias("event_date"), F.col("source").alias("channel"), "campaign_id", "event_name", "user_id")
        .distinct()
    )
    known = F.col("user_id").isNotNull()
    return users.select(
        *PANEL_KEYS,
        (known & (kind == "install")).cast("bigint").alias("installs"),
        (known & (kind == "registration")).cast("bigint").alias("registrations"),
    )


def panel_keys(events: DataFrame, spend: DataFrame) -> DataFrame:
    """Distinct (day, channel, campaign) seen in spend, installs or registrations; NULL is a value."""
    converted = events.filter(F.col("event_name").isin("install", "registration")).select(
        day(F.col("event_timestamp")).alias("event_date"), F.col("source").alias("channel"), "campaign_id"
    )
    return _spend_rows(spend).select(*PANEL_KEYS).unionByName(converted).distinct()


def panel_rows(events: DataFrame, spend: DataFrame) -> DataFrame:
    """Spend rows and distinct converting users stacked on the panel's columns, not yet summed.

    Stacking replaces the joins of the three measure sets: NULL keys group together by themselves,
    and any grain needs one shuffle with a map-side combine.
    """
    return _spend_rows(spend).unionByName(_conversion_rows(events), allowMissingColumns=True)


def panel_daily_kpi(events: DataFrame, spend: DataFrame) -> DataFrame:
    """Measures and unit costs per (day, channel, campaign); CTR is in percent here."""
    return _with_smallest_name(panel_rows(events, spend), MEASURES).withColumns({
        "CPI": guarded_ratio("spend", "installs"),
        "CAC": guarded_ratio("spend", "registrations"),
        **media_ratios("spend", "impressions", "clicks", ctr_scale=100),
    })


def first_registration(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """One row per registered user with the channel and campaign of the earliest registration."""
    return first_event(events, "registration", tie=tie).select(
        "user_id",
        F.col("event_timestamp").alias("reg_date"),
        F.col("source").alias("channel"),
        fill("campaign_id", NO_CAMPAIGN).alias("campaign_id"),
    )


def user_revenue(
    registrations: DataFrame, tx: DataFrame, days: int = WINDOW_DAYS, fee_rate: float = FEE_RATE, tie: str = "tx_id"
) -> DataFrame:
    """Fee revenue in the first days after registration, for users with a transaction in that time."""
    windows = registrations.select("user_id", "reg_date", add_days(F.col("reg_date"), days).alias("window_end"))
    return fee_revenue_interval(tx, windows, "reg_date", {f"revenue_{days}d": "window_end"}, fee_rate, tie)


def registered_revenue(registrations: DataFrame, revenue: DataFrame) -> DataFrame:
    """Every registered user with its revenue; users without transactions count as 0."""
    return registrations.select("user_id", "channel", "campaign_id").join(revenue, "user_id", "left").withColumn(
        "revenue_30d", fill("revenue_30d", 0.0)
    )


def revenue_by_campaign(reg_revenue: DataFrame) -> DataFrame:
    """Registered users, their total and their average revenue per (channel, campaign)."""
    return reg_revenue.groupBy("channel", "campaign_id").agg(
        F.count(F.lit(1)).alias("reg_users"),
        F.avg("revenue_30d").alias("avg_rev_30d_per_reg"),
        F.sum("revenue_30d").alias("revenue_30d_total"),
    )


def _efficiency() -> dict[str, Column]:
    return {
        "CPI": guarded_ratio("spend", "installs"),
        "CAC": guarded_ratio("spend", "registrations"),
        "install_to_reg_rate": guarded_ratio("registrations", "installs"),
        **media_ratios("spend", "impressions", "clicks"),
    }


def _with_value(stats: DataFrame) -> DataFrame:
    """Payback in 30-day periods, and 30-day revenue over spend."""
    return stats.withColumns({
        "payback_months": guarded_ratio("CAC", "avg_rev_30d_per_reg"),
        "roas_30d": guarded_ratio("revenue_30d_total", "spend"),
    })


def campaign_stats(panel: DataFrame, campaign_revenue: DataFrame) -> DataFrame:
    """KPIs per (channel, campaign) over the full period, from the daily panel or its unsummed rows.

    ``installs`` sums daily distinct users, so a user installing on two days counts twice.
    """
    totals = (
        panel.withColumn("campaign_id", fill("campaign_id", NO_CAMPAIGN))
        .groupBy("channel", "campaign_id")
        .agg(*[fill(F.sum(m)).alias(m) for m in MEASURES])
    )
    kpis = totals.withColumns({
        **_efficiency(),
        "click_to_install": guarded_ratio("installs", "clicks"),
        "click_to_reg": guarded_ratio("registrations", "clicks"),
    })
    return _with_value(null_safe_join(kpis, campaign_revenue, ["channel", "campaign_id"]).withColumns({
        "reg_users": fill("reg_users"),
        "avg_rev_30d_per_reg": fill("avg_rev_30d_per_reg", 0.0),
        "revenue_30d_total": fill("revenue_30d_total", 0.0),
    }))


def channel_stats(campaigns: DataFrame) -> DataFrame:
    """KPIs per channel, with each channel's share of spend and of registrations."""
    totals = campaigns.groupBy("channel").agg(*[F.sum(m).alias(m) for m in [*MEASURES, "reg_users", "revenue_30d_total"]])
    # The mean per registered user follows from campaign totals, without another pass over users.
    mean = fill(guarded_ratio("revenue_30d_total", "reg_users"), 0.0)
    valued = _with_value(totals.withColumns({**_efficiency(), "avg_rev_30d_per_reg": mean}))
    shared = share_of_total(share_of_total(valued, "spend", "spend_share"), "registrations", "reg_share")
    return shared.withColumn("reg_minus_spend_share", F.col("reg_share") - F.col("spend_share"))


def paid_channel_ranking(channels: DataFrame, by: str = "CAC", keep: Sequence[str] = ("CAC", "payback_months")) -> DataFrame:
    """Channels other than organic, cheapest first by ``by``."""
    return channels.filter(is_not("channel", "Organic")).select("channel", *keep).orderBy(
        F.col(by).asc_nulls_last(), F.col("channel").asc_nulls_last()
    )
