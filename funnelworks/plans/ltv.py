"""Lifetime-value data set: labels from days 14 to 180, features from the first 14 days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from funnelworks.functions.ratios import clip, fill
from funnelworks.functions.text import as_text, normalised
from funnelworks.functions.time import add_days, day, whole_days
from funnelworks.operators.events import CONVERSIONS, hot_keys, null_safe_join, salted_join, tie_columns, user_days
from funnelworks.operators.intervals import FEE_RATE, SUMS, BalanceIndex, balance_index, window_fee, within
from funnelworks.operators.order_stats import with_row_index
from funnelworks.plans.channel import WINDOW_DAYS, media_ratios

# Fixed values.
H_DAYS = 180
EARLY_DAYS = 14
TRAIN_FRACTION = 0.8

TX_FEATURES = ["tx_count", "dep_sum", "dep_cnt", "wdr_sum", "wdr_cnt", "bal_max", "bal_mean", "bal_last", "net_flow"]
KEYS = ["user_id", "install_date"]
TARGET = "y_rev_14_H"
FEATURES = [
    "platform", "channel", "campaign_id", "country", "reg_within_14d", "days_to_reg",
    "camp_CTR", "camp_CPM", "camp_CPC", "platform_norm", "channel_platform",
    *TX_FEATURES, "age", "gender", "tracking_enabled", "rev_0_14",
]


def user_times(events: DataFrame) -> DataFrame:
    """Times of the first install and the first registration of each user with either; NULL where there is none."""
    ts, kind = F.col("event_timestamp"), F.col("event_name")
    return events.filter(kind.isin(*CONVERSIONS)).groupBy("user_id").agg(
        F.min(F.when(kind == "install", ts)).alias("install_date"), F.min(F.when(kind == "registration", ts)).alias("reg_date"))


def user_journeys(events: DataFrame, tie: str = "event_id") -> DataFrame:
    """First install of each user, with the time of the first registration if there is one.

    Events are reduced to user-days first; the first install and the registration then come from one window over
    the few rows of a user, so no aggregation carries text.
    """
    days = user_days(events, tie)
    ts, installed = F.col("event_timestamp"), F.col("event_name") == "install"
    ties = tie_columns(days, tie, ["platform", "source", "campaign_id", "country"])
    # Missing timestamps come last.
    order = [(~installed).cast("int"), ts.asc_nulls_last(), *[F.col(c) for c in ties]]
    of_user = Window.partitionBy("user_id").orderBy(*order)
    whole = of_user.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    registered = F.min(F.when(F.col("event_name") == "registration", ts)).over(whole)
    ranked = days.withColumns({"_rank": F.row_number().over(of_user), "reg_date": registered})
    return ranked.filter((F.col("_rank") == 1) & installed).select(
        "user_id", ts.alias("install_date"), "platform", F.col("source").alias("channel"), "campaign_id", "country", "reg_date")


def last_instant(tx: DataFrame) -> DataFrame:
    """The time of the last transaction, as one row; reads that column only."""
    return tx.agg(F.max("transaction_timestamp").alias("last_instant"))


def with_whole_window(users: DataFrame, last: DataFrame, h_days: int = H_DAYS) -> DataFrame:
    """Users whose whole label window lies before the last transaction seen, the one row of ``last``."""
    return users.filter(F.col("install_date") <= last.select(add_days(F.col("last_instant"), -h_days)).scalar())


def eligible_installs(journeys: DataFrame, tx: DataFrame, h_days: int = H_DAYS) -> DataFrame:
    return with_whole_window(journeys, last_instant(tx), h_days)


def label_windows(users: DataFrame, h_days: int = H_DAYS, early_days: int = EARLY_DAYS) -> DataFrame:
    """Both windows of each user: from the install to ``end_14`` and to ``end_H``."""
    start = F.col("install_date")
    return users.withColumns({"end_14": add_days(start, early_days), "end_H": add_days(start, h_days)})


def summary_of(index: BalanceIndex, fee_rate: float = FEE_RATE) -> DataFrame:
    """Revenue of both windows and early account activity per user with a transaction in the long window."""
    early, known = within("install_date", "end_14"), F.col("known_balance")
    rows = index.chained().filter(within("install_date", "end_H"))
    return rows.groupBy("user_id", "install_date").agg(
        window_fee("install_date", "end_14", fee_rate).alias("rev_0_14"),
        window_fee("install_date", "end_H", fee_rate).alias("rev_0_H"),
        *[fill(F.sum(F.when(early, F.col(c)))).alias(c) for c in SUMS],
        F.max(F.when(early, F.col("bal_max"))).alias("bal_max"),
        F.max_by(known, F.when(early & known.isNotNull(), F.col("last_ts"))).alias("bal_last"),
    ).withColumns({
        "bal_mean": F.try_divide(F.col("bal_sum").cast("double"), F.col("bal_cnt").cast("double")),
        "net_flow": F.col("dep_sum") - F.col("wdr_sum"),
    }).select("user_id", "install_date", "rev_0_14", "rev_0_H", *TX_FEATURES)


def account_summary(
    tx: DataFrame,
    eligible: DataFrame,
    h_days: int = H_DAYS,
    early_days: int = EARLY_DAYS,
    fee_rate: float = FEE_RATE,
    tie: str = "tx_id",
    heavy: Sequence | None = None,
) -> DataFrame:
    """Revenue of both windows and early account activity per user, from one pass over ``tx``."""
    windows = label_windows(eligible.select("user_id", "install_date"), h_days, early_days)
    index = balance_index(tx, windows, ["install_date"], ["end_14", "end_H"], tie, heavy=heavy)
    return summary_of(index, fee_rate).drop("install_date")


def account_windows(events: DataFrame, days: int = WINDOW_DAYS) -> DataFrame:
    """All windows the reports ask for, one row per user: 30 days from the registration, and the label windows."""
    return label_windows(user_times(events)).withColumn("reg_end", add_days(F.col("reg_date"), days))


def account_index(tx: DataFrame, events: DataFrame, tie: str = "tx_id", heavy: Sequence | None = None) -> BalanceIndex:
    """One index for 14, 30 and 180 days: transactions are scanned and shuffled once for all of them."""
    return balance_index(tx, account_windows(events), ["reg_date", "install_date"], ["reg_end", "end_14", "end_H"], tie, heavy=heavy)


def ltv_labels(eligible: DataFrame, summary: DataFrame) -> DataFrame:
    """Revenue of both windows and the label between them, 0 for users without transactions."""
    rows = eligible.select("user_id").join(summary.select("user_id", "rev_0_14", "rev_0_H"), "user_id", "left")
    return _with_label(rows)


def _with_label(rows: DataFrame) -> DataFrame:
    filled = rows.withColumns({c: fill(c, 0.0) for c in ("rev_0_14", "rev_0_H")})
    return filled.withColumn(TARGET, clip(F.col("rev_0_H") - F.col("rev_0_14"), low=0.0))


def campaign_media_features(spend: DataFrame) -> DataFrame:
    return spend.groupBy("channel", "campaign_id").agg(
        *[F.sum(m).alias(f"camp_{m}") for m in ("spend", "impressions", "clicks")]
    ).withColumns(media_ratios("camp_spend", "camp_impressions", "camp_clicks", prefix="camp_"))


def registration_features(eligible: DataFrame, early_days: int = EARLY_DAYS) -> DataFrame:
    """Whether and when the user registered early. A registration before the install counts, with negative days."""
    within = fill(F.col("reg_date") <= add_days(F.col("install_date"), early_days), False)
    return eligible.withColumn("reg_within_14d", within).withColumn(
        "days_to_reg", F.when(F.col("reg_within_14d"), whole_days(F.col("install_date"), F.col("reg_date")))
    )


def tx_features_14d(summary: DataFrame) -> DataFrame:
    """Early account activity of users with at least one transaction in the first days."""
    return summary.filter(F.col("tx_count") > 0).select("user_id", *TX_FEATURES)


def ltv_features(eligible: DataFrame, spend: DataFrame, summary: DataFrame, profiles: DataFrame,
                 hot_campaigns: Sequence[int] | None = None) -> DataFrame:
    """One wide row per user (per profile row, should a user have several), with both revenues and the label.

    ``hot_campaigns`` are the hashes of (channel, campaign) keys with many users; by default a sketch finds them.
    """
    if hot_campaigns is None:
        hot_campaigns = hot_keys(eligible, ["channel", "campaign_id"])
    camp = campaign_media_features(spend).select("channel", "campaign_id", "camp_CTR", "camp_CPM", "camp_CPC")
    # Both joins by user deal rows out by the same null-safe key, so the second one finds them in place.
    feat = null_safe_join(registration_features(eligible), summary, ["user_id"])
    feat = _with_label(feat.withColumns({c: fill(c) for c in TX_FEATURES}))
    feat = null_safe_join(feat, profiles.select("user_id", "age", "gender", "tracking_enabled"), ["user_id"])
    # Organic users have no campaign and may be most of all: a key like that is split.
    feat = salted_join(feat, camp, ["channel", "campaign_id"], hot=hot_campaigns)
    return feat.withColumns({
        "platform_norm": normalised(F.col("platform")),
        "channel_platform": F.concat(as_text(F.col("channel")), F.lit("__"), normalised(F.col("platform"))),
    }).select(*KEYS, *FEATURES, "rev_0_H", TARGET)


def time_split(df: DataFrame, order: str = "install_date", tie: str = "user_id", frac: float = TRAIN_FRACTION) -> DataFrame:
    """Add ``is_train`` for the first ``frac`` of rows in time order; missing times come last.

    Counts per day find the day the split falls into, and only that day's rows are sorted, by time, ``tie`` and a hash of
    the row; all other rows are told apart by their day. ``df`` is read three times: pass a written table.
    """
    rest = F.xxhash64(*[c for c in df.columns if c not in (order, tie)])
    place = F.struct(*[x for c in (F.col(order), F.col(tie)) for x in (c.isNull(), c)], rest)  # missing values last
    date = day(F.col(order))
    per_day = sorted(df.groupBy(date.alias("day")).count().collect(), key=lambda r: (r["day"] is None, r["day"]))  # a row per day
    left = int(sum(r["count"] for r in per_day) * frac)
    for r in per_day:
        if left < r["count"]:
            break
        left -= r["count"]
    else:
        return df.withColumn("is_train", F.lit(True))
    of_day = date.isNull() if r["day"] is None else date.eqNullSafe(F.lit(r["day"]))
    earlier = date.isNotNull() if r["day"] is None else fill(date < F.lit(r["day"]), False)
    if left == 0:
        return df.withColumn("is_train", earlier)
    sorted_day = with_row_index(df.filter(of_day).select(place.alias("place")), [F.col("place")])
    last = sorted_day.filter(F.col("row_index") == left - 1).select("place").scalar()
    return df.withColumn("is_train", earlier | (of_day & (place <= last)))
