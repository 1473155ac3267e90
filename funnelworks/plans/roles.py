"""Campaign roles from names, and media profiles per role."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from funnelworks.functions.ratios import clip, guarded_ratio
from funnelworks.operators.events import null_safe_join
from funnelworks.operators.shares import mix_share
from funnelworks.plans.channel import media_ratios

# Role labels and the name patterns they are recognised by, in rule order.
BRAND = "Brand / demand-capture"
RETARGETING = "Retargeting / re-engagement"
PROSPECTING = "Prospecting / upper-funnel"
NON_BRAND = "Non-brand intent"
AUTOMATED = "Automated app acquisition"
UNCLEAR = "Unclear / mixed"
BRAND_NAMES = r"\bbrand\b|branded"
RETARGETING_NAMES = r"retarget|remarket|re-engage|reengage|crm"
PROSPECTING_NAMES = r"prospect|acq|acquisition|upper|awareness|reach|video|view"
NON_BRAND_NAMES = r"non[- ]brand|generic|competitor"
AUTOMATED_NAMES = r"app campaign|uac|app|install"
MIN_REGISTRATIONS = 200


def campaign_media(spend: DataFrame) -> DataFrame:
    """Media totals and unit costs per (channel, campaign, name); NULL keys are groups."""
    return spend.groupBy("channel", "campaign_id", "campaign_name").agg(
        *[F.sum(m).alias(m) for m in ("spend", "impressions", "clicks")]
    ).withColumns(media_ratios("spend", "impressions", "clicks"))


def campaign_funnel(campaigns: DataFrame, media: DataFrame, min_registrations: int = MIN_REGISTRATIONS) -> DataFrame:
    """Campaign KPIs with campaign names, for campaigns with enough registrations.

    Campaigns without an id carry a sentinel on one side only and so get no name; a campaign with
    several names appears once per name.
    """
    # The threshold is on campaign totals, so it goes before the join that may multiply rows.
    stable = campaigns.filter(F.col("registrations") >= min_registrations)
    names = media.filter(F.col("campaign_id").isNotNull()).select("channel", "campaign_id", "campaign_name")
    return null_safe_join(stable, names, ["channel", "campaign_id"]).withColumns({
        "install_rate_per_click": guarded_ratio("installs", "clicks"),
        "reg_rate_per_click": guarded_ratio("registrations", "clicks"),
    })


def campaign_role(name: Column, channel: Column, own_names: Sequence[str] = ()) -> Column:
    """Role of a campaign: the first rule that matches wins.

    ``own_names`` are the advertiser's own brand words, which mark a brand campaign like "brand" does.
    The brand rule comes before the non-brand one, and the word "brand" inside "non-brand" counts.
    """
    n, c = F.lower(F.coalesce(name, F.lit(""))), F.lower(F.coalesce(channel, F.lit("")))
    on_google = c.contains("google")
    brand = "|".join([BRAND_NAMES, *[re.escape(w.lower()) for w in own_names]])
    return (
        F.when(on_google & n.rlike(brand), BRAND)
        .when(n.rlike(RETARGETING_NAMES), RETARGETING)
        .when(n.rlike(PROSPECTING_NAMES), PROSPECTING)
        .when(c.contains("non-brand") | n.rlike(NON_BRAND_NAMES), NON_BRAND)
        .when(on_google & n.rlike(AUTOMATED_NAMES), AUTOMATED)
        .otherwise(UNCLEAR)
    )


def campaign_roles(funnel: DataFrame, own_names: Sequence[str] = ()) -> DataFrame:
    return funnel.withColumn("campaign_role", campaign_role(F.col("campaign_name"), F.col("channel"), own_names))


def role_mix(roles: DataFrame) -> DataFrame:
    """Spend per role and its share within the channel, largest first."""
    spent = roles.dropna(subset=["channel"]).groupBy("channel", "campaign_role").agg(F.sum("spend").alias("role_spend"))
    return mix_share(spent, ["channel"], "role_spend", "role_spend_share").orderBy(
        "channel", F.col("role_spend_share").desc_nulls_last(), "campaign_role"
    )


def role_profile(roles: DataFrame) -> DataFrame:
    """Campaign count, spend and mean KPIs per role within the channel, largest spend first."""
    return roles.dropna(subset=["channel"]).groupBy("channel", "campaign_role").agg(
        F.count_distinct("campaign_id").alias("campaigns"),
        F.sum("spend").alias("spend"),
        F.avg("CAC").alias("CAC"),
        F.avg("payback_months").alias("payback"),
        F.avg("CPM").alias("CPM"),
        F.avg("CTR").alias("CTR"),
        F.avg("install_to_reg_rate").alias("install_to_reg"),
        F.avg("roas_30d").alias("roas_30d"),
    ).orderBy("channel", F.col("spend").desc_nulls_last(), "campaign_role")


def media_bubble(roles: DataFrame) -> DataFrame:
    """CPM against CTR with a marker size that grows with spend."""
    return roles.dropna(subset=["CPM", "CTR"]).select(
        "channel", "campaign_id", "campaign_name", "CPM", "CTR",
        clip(F.col("spend").cast("double") / F.lit(2000.0), 10.0, 200.0).alias("bubble_size"),
    )
