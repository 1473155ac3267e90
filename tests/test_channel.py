from __future__ import annotations

import pytest

from funnelworks.plans import channel
from funnelworks.sources import Tables
from funnelworks.study import Study
from tests.frames import events, rows, spend, tx


def study(e, s, t):
    return Study(Tables(e, s, None, t, None))


@pytest.fixture(scope="module")
def e(spark):
    return events(spark, [
        (1, "2024-01-01 08:00", "install", "Organic", None),
        (1, "2024-01-01 09:00", "install", "Organic", None),      # same user, same day: once
        (1, "2024-01-02 09:00", "install", "Organic", None),      # next day: counts again
        (2, "2024-01-01 10:00", "install", "Meta", "m1"),
        (2, "2024-01-01 11:00", "registration", "Meta", "m1"),
        (1, "2024-01-02 11:00", "registration", "Organic", None),
        (None, "2024-01-01 12:00", "install", "Meta", "m2"),       # no user: the key exists, the count is 0
        (3, "2024-01-01 12:00", "click", "Meta", "m9"),            # other kinds do not make keys
        (4, "2024-01-03 12:00", "registration", None, None),
    ])


@pytest.fixture(scope="module")
def s(spark):
    return spend(spark, [
        ("2024-01-01", "Meta", "m1", "Zeta", 10, 1000, 10), ("2024-01-01", "Meta", "m1", None, 5.5, 500, 0),
        ("2024-01-01", "Meta", "m1", "Alpha", 0, 0, 0), ("2024-01-02", "Referral", None, "R", 4, 0, 0),
        ("2024-01-02", "TikTok", "t1", None, None, None, None),
    ])


def test_daily_counts_keep_null_keys(e):
    out = [(str(d), *rest) for d, *rest in rows(channel.installs_daily(e), "event_date", "source", "campaign_id", "installs")]
    assert out == [
        ("2024-01-01", "Meta", "m1", 1), ("2024-01-01", "Meta", "m2", 0),
        ("2024-01-01", "Organic", None, 1), ("2024-01-02", "Organic", None, 1),
    ]


def test_spend_per_campaign(s):
    out = {(r["channel"], r["campaign_id"]): r for r in channel.spend_daily_campaign(s).collect()}
    meta = out["Meta", "m1"]
    assert (float(meta["spend"]), meta["impressions"], meta["clicks"], meta["campaign_name"]) == (15.5, 1500, 10, "Alpha")
    assert out["Referral", None]["campaign_name"] == "R"
    assert float(out["TikTok", "t1"]["spend"]) == 0.0 and out["TikTok", "t1"]["clicks"] == 0


def test_panel_equals_null_safe_join_of_its_parts(e, s):
    out = {(str(r["event_date"]), r["channel"], r["campaign_id"]): r for r in channel.panel_daily_kpi(e, s).collect()}
    assert set(out) == {tuple(str(v) if i == 0 else v for i, v in enumerate(k)) for k in rows(channel.panel_keys(e, s))}
    meta = out["2024-01-01", "Meta", "m1"]
    assert (float(meta["spend"]), meta["installs"], meta["registrations"], meta["campaign_name"]) == (15.5, 1, 1, "Alpha")
    assert (meta["CPI"], meta["CAC"], meta["CTR"], meta["CPC"]) == (15.5, 15.5, pytest.approx(100 * 10 / 1500), 1.55)
    organic = out["2024-01-02", "Organic", None]
    assert (organic["installs"], organic["registrations"], organic["CPI"], organic["CTR"]) == (1, 1, 0.0, None)
    assert out["2024-01-02", "Referral", None]["CPI"] is None
    assert out["2024-01-01", "Meta", "m2"]["installs"] == 0
    assert out["2024-01-03", None, None]["registrations"] == 1
    assert sum(float(r["spend"]) for r in out.values()) == 19.5


def test_stats_and_payback(spark, e, s):
    t = tx(spark, [(1, 2, "2024-01-01 11:00", "deposit", 1000, 1000), (2, 9, "2024-01-01", "deposit", 1, 1)])
    campaigns = study(e, s, t).campaigns
    channels = channel.channel_stats(campaigns)
    c = {(r["channel"], r["campaign_id"]): r for r in campaigns.collect()}
    m1 = c["Meta", "m1"]
    revenue = 1000 * 30 * 0.005 / 365
    assert m1["revenue_30d_total"] == pytest.approx(revenue) and m1["payback_months"] == pytest.approx(15.5 / revenue)
    assert m1["roas_30d"] == pytest.approx(revenue / 15.5) and m1["CTR"] == pytest.approx(10 / 1500)
    organic = c["Organic", "__NO_CAMPAIGN__"]
    assert organic["installs"] == 2  # daily distinct users, summed
    assert organic["CAC"] == 0.0 and organic["payback_months"] is None and organic["roas_30d"] is None
    assert (None, "__NO_CAMPAIGN__") in c
    ch = {r["channel"]: r for r in channels.collect()}
    assert ch["Meta"]["spend_share"] == pytest.approx(15.5 / 19.5) and ch["Meta"]["reg_share"] == pytest.approx(1 / 3)
    assert sum(r["spend_share"] for r in ch.values()) == pytest.approx(1.0)
    assert sum(r["reg_share"] for r in ch.values()) == pytest.approx(1.0)
    assert ch["Meta"]["avg_rev_30d_per_reg"] == pytest.approx(revenue) and ch["Referral"]["CAC"] is None
    ranked = [r["channel"] for r in channel.paid_channel_ranking(channels).collect()]
    assert "Organic" not in ranked and None in ranked and ranked.index("Meta") < ranked.index("Referral")


def test_mean_revenue_counts_users_without_transactions(spark):
    e = events(spark, [(u, "2024-01-01", "registration", "Meta", "m") for u in (1, 2, 3, 4)])
    t = tx(spark, [(1, 1, "2024-01-01", "deposit", 1000, 1000)])
    registrations = channel.first_registration(e)
    out = channel.revenue_by_campaign(channel.registered_revenue(registrations, channel.user_revenue(registrations, t))).first()
    assert out["reg_users"] == 4 and out["avg_rev_30d_per_reg"] == pytest.approx(out["revenue_30d_total"] / 4)


def test_no_spend_at_all_gives_null_shares(spark, e):
    none = spend(spark, [("2024-01-01", "Meta", "m1", "A", 0, 0, 0)])
    channels = study(e, none, tx(spark, [(1, 1, "2024-01-01", "deposit", 1, 1)])).channels
    assert {r["spend_share"] for r in channels.collect()} == {None}


def test_partitioning_of_the_input_does_not_matter(spark, e, s):
    t = tx(spark, [(i, i % 4, f"2024-01-0{1 + i % 5}", "deposit", 1, i) for i in range(40)])
    one = study(e.coalesce(1), s.coalesce(1), t.coalesce(1)).channels.collect()
    many = study(e.repartition(5), s.repartition(3), t.repartition(7)).channels.collect()
    key = lambda r: str(r["channel"])
    for a, b in zip(sorted(one, key=key), sorted(many, key=key)):
        assert a.asDict() == pytest.approx(b.asDict())
