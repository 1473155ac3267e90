"""Methods the published study describes in words only; the definitions here are this library's own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.ratios import fill, is_not, plain_ratio
from funnelworks.functions.time import add_days, day, week_start
from funnelworks.operators.events import daily_users, null_safe_join
from funnelworks.operators.series import lag_correlation
from funnelworks.operators.sketches import daily_state, hll_error, merged
from funnelworks.plans.channel import NO_CAMPAIGN
from funnelworks.plans.ltv import EARLY_DAYS, H_DAYS
from funnelworks.plans.model import channel_value
from funnelworks.plans.series import LAGS, LEADS, skan_daily_network

MAX_CONVERSION_VALUE = 63  # fixed value: postbacks carry six bits
DAYS_PER_MONTH = 30.0
EVENT_KINDS = ("impression", "click", "install", "registration")


def skan_ios_value(
    users: DataFrame,
    skan: DataFrame,
    revenue_per_value: float = 1.0,
    calibrate_on: str = "android",
) -> DataFrame:
    """Value of anonymous iOS installs per network, calibrated on users of the other platform.

    ``users`` has ``platform, rev_0_14, rev_0_H``. Early revenue in steps of ``revenue_per_value``
    gives each calibration user a conversion value; postbacks take the mean 180-day revenue of
    their value. Postbacks with a value no calibration user has are counted apart.
    """
    value = F.least(F.lit(MAX_CONVERSION_VALUE), F.floor(F.greatest(F.col("rev_0_14"), F.lit(0.0)) / F.lit(revenue_per_value)))
    calibration = (
        users.filter(F.col("platform") == calibrate_on)
        .groupBy(value.cast("int").alias("conversion_value"))
        .agg(F.avg("rev_0_H").alias("mean_value"))
    )
    installs = skan.groupBy("network", "conversion_value").agg(F.sum("install_count").alias("installs"))
    matched = F.col("mean_value").isNotNull()
    joined = installs.join(calibration, "conversion_value", "left")
    return joined.groupBy("network").agg(
        F.sum("installs").alias("installs"),
        fill(F.sum(F.when(matched, F.col("installs")))).alias("calibrated_installs"),
        F.sum(F.col("installs") * F.col("mean_value")).alias("estimated_value"),
    ).withColumn("value_per_install", plain_ratio("estimated_value", "calibrated_installs"))


def halo_regression(series: DataFrame, leads: Sequence[int] = LEADS) -> DataFrame:
    """Line of organic installs ``lag_days`` rows later on spend."""
    w = Window.partitionBy().orderBy("event_date")
    x = F.col("paid_spend_total")
    later = series.select(x, *[F.lead("organic_installs", k).over(w).cast("double").alias(f"_y{k}") for k in leads])
    wide = later.agg(*[
        F.struct(
            F.lit(k).alias("lag_days"),
            F.regr_slope(F.col(f"_y{k}"), x).alias("slope"),
            F.regr_intercept(F.col(f"_y{k}"), x).alias("intercept"),
            F.regr_r2(F.col(f"_y{k}"), x).alias("r2"),
            F.regr_count(F.col(f"_y{k}"), x).alias("n"),
        ).alias(f"_r{k}")
        for k in leads
    ])
    return wide.select(F.inline(F.array(*[F.col(f"_r{k}") for k in leads])))


def predicted_payback(ltv_cac: DataFrame, horizon_days: int = H_DAYS - EARLY_DAYS) -> DataFrame:
    """Months until predicted revenue repays the acquisition cost, at an even pace over the horizon."""
    monthly = F.col("pred_mean") / F.lit(horizon_days / DAYS_PER_MONTH)
    return ltv_cac.select("channel", "CAC", "pred_mean", plain_ratio(F.col("CAC"), monthly).alias("predicted_payback_months"))


def channel_funnel_role(channels: DataFrame) -> DataFrame:
    """Funnel position of paid channels from CPM, CTR and clicks that become registrations.

    Intent rises down the funnel, and all three rise with it: the mean of a channel's percentile
    ranks puts it in the bottom, middle or top third.
    """
    paid = channels.filter(is_not("channel", "Organic")).select(
        "channel", "CPM", "CTR", F.when(F.col("clicks") > 0, F.col("registrations") / F.col("clicks")).alias("click_to_reg")
    )
    metrics = ["CPM", "CTR", "click_to_reg"]
    # One row per channel: an unpartitioned window is fine.
    ranked = paid.withColumns({
        f"_{m}": F.percent_rank().over(Window.partitionBy().orderBy(F.col(m).asc_nulls_first())) for m in metrics
    })
    intent = (F.col("_CPM") + F.col("_CTR") + F.col("_click_to_reg")) / F.lit(3.0)
    role = F.when(intent >= 2 / 3, "bottom").when(intent >= 1 / 3, "mid").otherwise("top")
    return ranked.select("channel", *metrics, intent.alias("intent_score"), role.alias("funnel_role"))


def campaign_triage(scored: DataFrame, campaigns: DataFrame) -> DataFrame:
    """Campaigns by predicted value over acquisition cost, best first; campaigns without cost data are left out."""
    value = (
        scored.withColumn("campaign_id", fill("campaign_id", NO_CAMPAIGN))
        .groupBy("channel", "campaign_id")
        .agg(F.avg("y_pred").alias("pred_mean"), F.count(F.lit(1)).alias("n"))
    )
    costs = campaigns.select("channel", "campaign_id", "CAC")
    return (
        null_safe_join(value, costs, ["channel", "campaign_id"])
        .filter(F.col("CAC") > 0)
        .withColumn("LTV_over_CAC", plain_ratio("pred_mean", "CAC"))
        .orderBy(F.col("LTV_over_CAC").desc_nulls_last(), "channel", "campaign_id")
    )


def skan_by_network(skan: DataFrame, events: DataFrame, platform: str = "ios") -> DataFrame:
    """Postback installs next to last-click installers of the same network, per day, and what last click misses.

    A source belongs to the network its first word names, so "Google Brand Search" is Google's. An installer counts once
    a day and network; a side without rows is 0.
    """
    network = F.split(F.col("source"), " ")[0]
    installs = events.filter((F.col("platform") == platform) & is_not("source", "Organic")).withColumn("network", network)
    lastclick = daily_users(installs, "install", "lastclick_installs", by=("network",), keep_null_keys=False)
    reported = skan_daily_network(skan).withColumnRenamed("install_count", "skan_installs")
    both = reported.join(lastclick, ["event_date", "network"], "full").fillna(0, ["skan_installs", "lastclick_installs"])
    return both.withColumn("hidden_installs", F.col("skan_installs") - F.col("lastclick_installs"))


def skan_network_gap(by_network: DataFrame) -> DataFrame:
    """Totals per network, largest gap first, and the share of postback installs that last click does not see."""
    return by_network.groupBy("network").agg(
        *[F.sum(c).alias(c) for c in ("skan_installs", "lastclick_installs", "hidden_installs")]
    ).withColumn("hidden_share", plain_ratio("hidden_installs", "skan_installs")).orderBy(F.col("hidden_installs").desc(), "network")


def mislabelled_organic(by_network: DataFrame, events: DataFrame, platform: str = "ios") -> DataFrame:
    """Organic installers per day, and how many of them the networks' own counts claim as paid, at most all of them."""
    organic = daily_users(
        events.filter((F.col("platform") == platform) & (F.col("source") == "Organic")), "install", "organic_installs", by=(), keep_null_keys=False)
    hidden = by_network.groupBy("event_date").agg(F.sum(F.greatest("hidden_installs", F.lit(0))).alias("hidden_installs"))
    claimed = F.least("organic_installs", "hidden_installs")
    return organic.join(hidden, "event_date", "left").fillna(0, ["hidden_installs"]).withColumns({
        "mislabelled_installs": claimed, "mislabelled_share": plain_ratio(claimed, F.col("organic_installs"))})


def early_engagement(events: DataFrame, users: DataFrame, days: int = EARLY_DAYS, kinds: Sequence[str] = EVENT_KINDS) -> DataFrame:
    """Events of each kind within ``days`` of the install, both ends included, per user of ``users`` (user_id, install_date).

    Windows are laid out on days and met by (user, day), so a user with very many events is spread over the window's days, and
    what goes on to the user is one row per day. Users without events have zeros; a NULL user meets no events.
    """
    end = add_days(F.col("install_date"), days)
    spread = users.select("user_id", "install_date", end.alias("_end")).withColumn(
        "_day", F.explode(F.sequence(day(F.col("install_date")), day(F.col("_end")))))
    rows = events.filter(F.col("event_name").isin(*kinds)).select("user_id", "event_name", F.col("event_timestamp").alias("_ts"), day(F.col("event_timestamp")).alias("_day"))
    met = rows.join(spread, ["user_id", "_day"]).filter(F.col("_ts").between(F.col("install_date"), F.col("_end")))
    names = {k: f"{k}s_{days}d" for k in kinds}
    per_day = met.groupBy("user_id", "_day").agg(*[F.count_if(F.col("event_name") == k).alias(n) for k, n in names.items()])
    counts = per_day.groupBy("user_id").agg(*[F.sum(n).alias(n) for n in names.values()])
    return users.select("user_id").join(counts, "user_id", "left").fillna(0, list(names.values()))


def lag_corr_by_channel(series: DataFrame, channel_spend: DataFrame, lags: Sequence[int] = LAGS, forward: bool = False) -> DataFrame:
    """The test of spend against organic installs for each paid channel, per platform, over the days on which it spends."""
    spent = channel_spend.filter(is_not("channel", "Organic")).select("event_date", "channel", F.col("spend").cast("double").alias("spend"))
    joined = series.select("event_date", "platform", "organic_installs").join(spent, "event_date")
    return lag_correlation(joined, "spend", "organic_installs", lags, by=["platform", "channel"], direction="lead" if forward else "lag")


def paid_install_drops(daily: DataFrame, channel_spend: DataFrame, window: int = 7, min_days: int = 3, steady: float = 0.25, drop: float = 0.25) -> DataFrame:
    """Days on which a channel's spend holds but its attributed installs fall, against the mean of the days before.

    Changes are relative to the mean of the ``window`` days with spend before, where there are at least ``min_days``. A day is flagged when
    spend moves by at most ``steady`` either way and installs fall by at least ``drop``.
    """
    installs = daily.filter(is_not("source", "Organic")).groupBy("event_date", F.col("source").alias("channel")).agg(F.sum("installs").alias("installs"))
    spent = channel_spend.select("event_date", "channel", F.col("spend").cast("double").alias("spend"))
    both = spent.join(installs, ["event_date", "channel"], "left").fillna(0, ["installs"])
    before = Window.partitionBy("channel").orderBy("event_date").rowsBetween(-window, -1)  # a row per day

    def change(c: str) -> Column:
        mean = F.avg(c).over(before)
        return F.when((F.count(c).over(before) >= min_days) & (mean > 0), F.col(c) / mean - 1)

    out = both.withColumns({"spend_change": change("spend"), "installs_change": change("installs")})
    flagged = (F.abs("spend_change") <= steady) & (F.col("installs_change") <= -drop)
    return out.withColumn("is_drop", fill(flagged, False))


def registered_value(scored: DataFrame) -> DataFrame:
    """Predicted value per user who registers early, by channel, instead of per install."""
    return channel_value(scored.filter("reg_within_14d"))


def ltv_over_cac_by_platform(scored: DataFrame, channels: DataFrame) -> DataFrame:
    """Predicted value per install and platform over the channel's acquisition cost, best first.

    Spend is not known per platform, so both platforms of a channel share its cost.
    """
    value = scored.dropna(subset=["channel", "platform"]).groupBy("channel", "platform").agg(
        F.avg("y_pred").alias("pred_mean"), F.count(F.lit(1)).alias("n"))
    return value.join(channels.select("channel", "CAC"), "channel").filter(F.col("CAC") > 0).withColumn(
        "LTV_over_CAC", plain_ratio("pred_mean", "CAC")).orderBy(F.col("LTV_over_CAC").desc(), "channel", "platform")


def installer_estimates(state: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Distinct installers per week and source, merged from daily sketches, with the bound they keep to."""
    weeks = state.filter(F.col("day").isNotNull()).withColumn("week", week_start(F.col("day")))
    return merged(weeks, ["week", *by], ["installers"]).withColumn("three_errors", F.lit(3 * hll_error()) * F.col("installers"))


def installer_state(events: DataFrame, by: Sequence[str] = ("source",)) -> DataFrame:
    """Daily sketches of installers per source."""
    installs = events.filter(F.col("event_name") == "install").dropna(subset=list(by))
    return daily_state(installs, day(F.col("event_timestamp")), by, distinct={"installers": "user_id"})


def amount_state(tx: DataFrame) -> DataFrame:
    """Daily sketches of transaction amounts per type."""
    return daily_state(tx, day(F.col("transaction_timestamp")), ["transaction_type"], values={"amounts": "amount_usd"})


def amount_estimates(state: DataFrame) -> DataFrame:
    """Quantiles of transaction amounts per month and type, merged from daily sketches."""
    month = F.trunc("day", "month").alias("month")
    return merged(state.filter(F.col("day").isNotNull()), [month, "transaction_type"], values={"amounts": {"p50": 0.5, "p75": 0.75, "p90": 0.9}})
