from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from funnelworks.plans import roles
from tests.frames import rows, spend


@pytest.mark.parametrize(("name", "channel", "expected"), [
    ("Brand search NL", "Google Brand Search", roles.BRAND),
    ("Rebranded", "google", roles.BRAND),
    ("non-brand search", "Google Non-Brand Search", roles.BRAND),   # the word "brand" is found first
    ("brand video", "Meta", roles.PROSPECTING),                     # brand counts on Google only
    ("brand", "Meta", roles.UNCLEAR),
    ("CRM retarget reach", "Meta", roles.RETARGETING),              # before prospecting
    ("Upper funnel VIDEO", "TikTok", roles.PROSPECTING),
    ("search generic", "Meta", roles.NON_BRAND),
    ("search", "Google Non-Brand Search", roles.NON_BRAND),
    ("UAC NL", "Google App Campaigns", roles.AUTOMATED),
    ("install", "Meta", roles.UNCLEAR),
    (None, "Google App Campaigns", roles.UNCLEAR),
    (None, None, roles.UNCLEAR),
])
def test_first_matching_rule_wins(spark, name, channel, expected):
    df = spark.createDataFrame([(name, channel)], "n string, c string")
    assert df.select(roles.campaign_role(F.col("n"), F.col("c"))).first()[0] == expected


def test_own_names_mark_brand_campaigns_literally(spark):
    df = spark.createDataFrame([("Summit+ search", "Google")], "n string, c string")
    assert df.select(roles.campaign_role(F.col("n"), F.col("c"))).first()[0] == roles.UNCLEAR
    assert df.select(roles.campaign_role(F.col("n"), F.col("c"), ["Summit+"])).first()[0] == roles.BRAND


def test_names_multiply_rows_and_missing_campaigns_get_none(spark):
    s = spend(spark, [("2024-01-01", "Meta", "m", "one", 1, 10, 1), ("2024-01-01", "Meta", "m", "two", 1, 10, 1),
                      ("2024-01-01", "Referral", None, "ref", 1, 10, 1)])
    kpis = ["CAC", "payback_months", "CPM", "CTR", "install_to_reg_rate", "roas_30d"]
    stats = spark.createDataFrame(
        [("Meta", "m", 2.0, 1, 5, 300, *[1.0] * 6), ("Referral", "__NO_CAMPAIGN__", 1.0, 1, 5, 300, *[None] * 6), ("Meta", "tiny", 9.0, 1, 5, 3, *[1.0] * 6)],
        "channel string, campaign_id string, spend double, clicks long, installs long, registrations long, " + ", ".join(f"{k} double" for k in kpis),
    )
    out = roles.campaign_roles(roles.campaign_funnel(stats, roles.campaign_media(s)))
    assert rows(out, "channel", "campaign_id", "campaign_name") == [
        ("Meta", "m", "one"), ("Meta", "m", "two"), ("Referral", "__NO_CAMPAIGN__", None),
    ]
    mix = roles.role_mix(out)
    assert rows(mix, "channel", "role_spend", "role_spend_share") == [("Meta", 4.0, 1.0), ("Referral", 1.0, 1.0)]
    assert rows(roles.role_profile(out), "channel", "campaigns", "spend", "CAC") == [("Meta", 1, 4.0, 1.0), ("Referral", 1, 1.0, None)]
    assert rows(roles.media_bubble(out), "campaign_name", "bubble_size") == [("one", 10.0), ("two", 10.0)]
