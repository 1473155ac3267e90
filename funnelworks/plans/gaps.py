"""Attribution gaps: organic against paid installs by platform and tracking consent."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.ratios import fill, is_not, plain_ratio
from funnelworks.operators.events import null_safe_join
from funnelworks.operators.shares import mix_share, organic_paid_ratio

# Fixed values.
TRACKING_ON, TRACKING_OFF, UNKNOWN = "Tracking ON", "Tracking OFF", "Unknown"
TRACKING_BUCKETS = [TRACKING_OFF, TRACKING_ON, UNKNOWN]


def organic_paid_by_platform(events: DataFrame) -> DataFrame:
    """Organic and paid installers per platform; an installer may be both."""
    return organic_paid_ratio(events.filter(F.col("event_name") == "install"), "platform")


def install_users(events: DataFrame, profiles: DataFrame) -> DataFrame:
    """Install rows per (user, platform, source, tracking bucket), as a left join with profiles gives them.

    Both sides are counted per key first and the counts multiplied, so a user with many installs
    and many profile rows never has all their pairs written out. NULL keys match each other.
    """
    rows = F.sum("n_events") if "n_events" in events.columns else F.count(F.lit(1))  # user-days stand for several events
    installs = events.filter(F.col("event_name") == "install").groupBy("user_id", "platform", "source").agg(rows.alias("rows"))
    consent = F.col("tracking_enabled")
    bucket = F.when(consent, TRACKING_ON).when(~consent, TRACKING_OFF).otherwise(UNKNOWN)
    known = (
        profiles.groupBy("user_id", "platform", bucket.alias("tracking_bucket"))
        .agg(F.count(F.lit(1)).alias("profile_rows"))
    )
    return null_safe_join(installs, known, ["user_id", "platform"]).select(
        "user_id", "platform", "source",
        fill("tracking_bucket", UNKNOWN).alias("tracking_bucket"),
        (F.col("rows") * fill("profile_rows", 1)).alias("install_rows"),
    )


def organic_share_by_tracking(users: DataFrame) -> DataFrame:
    """Organic install rows over distinct installers per platform and tracking bucket; may exceed 1."""
    per_user = (
        users.dropna(subset=["platform"])
        .groupBy("platform", "tracking_bucket", "user_id")
        .agg(F.sum(F.when(F.col("source") == "Organic", F.col("install_rows")).otherwise(0)).alias("organic"))
    )
    return per_user.groupBy("platform", "tracking_bucket").agg(
        F.count("user_id").alias("installs"), F.sum("organic").alias("organic_installs")
    ).withColumn("organic_share", plain_ratio("organic_installs", "installs"))


def organic_share_pivot(by_tracking: DataFrame) -> DataFrame:
    """One row per platform, one column per tracking bucket; an absent pair is 0."""
    return (
        by_tracking.groupBy("platform").pivot("tracking_bucket", TRACKING_BUCKETS)
        .agg(F.first("organic_share")).fillna(0.0)
    )


def paid_mix_share(users: DataFrame, limit: int | None = None) -> DataFrame:
    """Paid installers per source and their share within platform and tracking bucket, largest first."""
    counts = (
        users.filter(is_not("source", "Organic")).dropna(subset=["platform", "source"])
        .groupBy("platform", "tracking_bucket", "source")
        .agg(F.count("user_id").alias("installs_paid"))  # one row per user on these keys
    )
    shares = mix_share(counts, ["platform", "tracking_bucket"], "installs_paid", "share_within_group").orderBy(
        "platform", "tracking_bucket", F.col("installs_paid").desc(), "source"
    )
    return shares if limit is None else shares.limit(limit)
