from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from funnelworks.plans import gaps, series
from tests.frames import events, profiles, rows, spend, ts


def test_left_join_with_profiles_fans_out_in_counts_only(spark):
    e = events(spark, [
        (1, "2024-01-01", "install", "Organic", None), (1, "2024-01-02", "install", "Organic", None),
        (1, "2024-01-03", "install", "Meta", "m"), (2, "2024-01-01", "install", "Organic", None),
        (3, "2024-01-01", "install", None, None), (None, "2024-01-01", "install", "Organic", None),
    ])
    p = profiles(spark, [(1, "ios", True, 30, "male"), (1, "ios", True, 31, "male"), (1, "ios", None, 1, None),
                         (1, "android", False, 1, None), (3, "ios", False, 1, None), (None, "ios", False, 1, None)])
    users = gaps.install_users(e, p)
    expected = e.filter("event_name = 'install'").alias("e").join(
        p.alias("p"), F.expr("e.user_id <=> p.user_id AND e.platform <=> p.platform"), "left"
    ).withColumn("b", F.expr("CASE WHEN tracking_enabled THEN 'Tracking ON' WHEN NOT tracking_enabled THEN 'Tracking OFF' ELSE 'Unknown' END"))
    plain = expected.groupBy("e.platform", "b").agg(
        F.count_distinct("e.user_id").alias("n"), F.sum(F.expr("int(coalesce(source = 'Organic', false))")).alias("o")
    )
    out = gaps.organic_share_by_tracking(users)
    assert rows(out, "platform", "tracking_bucket", "installs", "organic_installs") == rows(plain)
    assert out.filter("tracking_bucket = 'Tracking ON'").first()["organic_share"] == 4.0  # row count over users: above 1


def test_pivot_fills_absent_buckets(spark):
    e = events(spark, [(1, "2024-01-01", "install", "Organic", None)])
    users = gaps.install_users(e, profiles(spark, [(1, "ios", True, 30, "male")]))
    assert rows(gaps.organic_share_pivot(gaps.organic_share_by_tracking(users))) == [("ios", 0.0, 1.0, 0.0)]


def test_paid_mix_drops_missing_sources_and_keeps_referral(spark):
    e = events(spark, [(u, "2024-01-01", "install", src, None) for u, src in
                       ((1, "Referral"), (2, "Meta"), (3, "Meta"), (4, None), (5, "Organic"), (2, "Meta"))])
    users = gaps.install_users(e, profiles(spark, [(9, "ios", True, 1, None)]))
    assert [tuple(r) for r in gaps.paid_mix_share(users).collect()] == [
        ("ios", "Unknown", "Meta", 2, pytest.approx(2 / 3)), ("ios", "Unknown", "Referral", 1, pytest.approx(1 / 3)),
    ]


@pytest.fixture(scope="module")
def e(spark):
    return events(spark, [
        (1, "2024-01-01", "install", "Organic", None), (2, "2024-01-01", "install", "Organic", None),
        (3, "2024-01-01", "install", "Meta", "m"), (4, "2024-01-02", "install", "Meta", "m"),
        (5, "2024-01-02", "install", None, None), (6, None, "install", "Organic", None),
        (7, "2024-01-09", "install", "TikTok", "t"), (8, "2024-01-09", "install", "Organic", None),
    ])


@pytest.fixture(scope="module")
def s(spark):
    return spend(spark, [
        ("2024-01-01", "Meta", "m", "a", 10, 1, 1), ("2024-01-01", "TikTok", "t", "b", 30, 1, 1),
        ("2024-01-02", None, "x", "c", 99, 1, 1), ("2024-01-15", "TikTok", "t", "b", 5, 1, 1),
    ])


def test_published_and_plain_organic_share(e):
    daily = series.daily_installs(e)
    published = rows(series.organic_share_daily(daily), "organic_installs", "paid_installs", "organic_share")
    plain = rows(series.organic_share_daily(daily, organic_in_paid=False), "organic_installs", "paid_installs", "organic_share")
    assert published == [(0, 1, 0.0), (1, 2, pytest.approx(1 / 3)), (2, 3, pytest.approx(0.4))]
    assert plain == [(0, 1, 0.0), (1, 1, 0.5), (2, 1, pytest.approx(2 / 3))]


@pytest.mark.parametrize("organic_in_paid", [True, False])
def test_share_from_pivot_equals_share_from_long_table(e, organic_in_paid):
    daily = series.daily_installs(e)
    wide = series.daily_installs_pivot(daily)
    assert wide.columns == ["event_date", "platform", "Meta", "Organic", "TikTok"]
    columns = ["event_date", "platform", "organic_installs", "paid_installs", "organic_share"]
    assert rows(series.organic_share_from_pivot(wide, organic_in_paid), *columns) == rows(series.organic_share_daily(daily, organic_in_paid), *columns)


@pytest.mark.parametrize("other", ["Snap", None])
def test_pivot_refuses_sources_that_are_not_listed(spark, other):
    days = [("2024-01-01", "ios", "Meta", 2), ("2024-01-01", "ios", other, 5)]
    daily = spark.createDataFrame(days, "event_date string, platform string, source string, installs bigint")
    listed = series.daily_installs_pivot(daily.filter("source = 'Meta'"), ["Meta", "Organic"])
    assert rows(listed) == [("2024-01-01", "ios", 2, 0)]
    with pytest.raises(Exception, match=f"not listed: {other or 'NULL'}"):
        series.daily_installs_pivot(daily, ["Meta", "Organic"]).collect()
    with pytest.raises(Exception, match="not listed"):
        series.organic_share_from_pivot(series.daily_installs_pivot(daily, ["Meta", "Organic"])).collect()


def test_pivot_without_organic_column(spark):
    daily = series.daily_installs(events(spark, [(1, "2024-01-01", "install", "Meta", "m")]))
    out = series.organic_share_from_pivot(series.daily_installs_pivot(daily)).first()
    assert (out["organic_installs"], out["paid_installs"], out["organic_share"]) == (0, 1, 0.0)


def test_spend_of_unnamed_channels_is_left_out_of_the_series_but_not_of_halo(e, s):
    assert rows(series.organic_series(e, s), "paid_spend_total") == [(0.0,), (0.0,), (40.0,)]
    assert rows(series.halo_series(e, s), "paid_spend_total", "organic_installs") == [(5.0, 0), (40.0, 2), (99.0, 0)]


def test_weekly_shares(e, s):
    assert rows(series.weekly_spend_share(s), "channel", "spend_share") == [("Meta", 0.25), ("TikTok", 0.75), ("TikTok", 1.0)]
    weekly = series.weekly_installs(e)
    assert rows(series.weekly_organic_share(weekly), "total_installs", "organic_installs") == [(2, 1), (4, 2)]
    voice = rows(series.share_of_voice(s, e), "week", "spend_share", "paid_install_share", "organic_share_all")
    assert [r[1:] for r in voice] == [(0.75, 0.0, 0.5), (0.0, 1.0, 0.5), (1.0, 0.0, 0.0)]


def test_skan_gap_is_a_full_join_filled_with_zero(spark, e):
    skan = spark.createDataFrame([(ts("2024-01-01").date(), "Meta", 1, 7), (ts("2024-01-05").date(), "Meta", 1, 2), (ts("2024-01-05").date(), None, 1, 50)],
                                 "postback_date date, network string, conversion_value int, install_count long")
    out = [(str(r[0]), *r[1:]) for r in series.skan_vs_lastclick(series.skan_series(skan, e)).collect()]
    assert out == [("2024-01-01", 7, 1, 6), ("2024-01-05", 2, 0, 2), ("2024-01-02", 0, 1, -1), ("2024-01-09", 0, 1, -1)]


def test_constant_series_give_null_correlations(spark):
    df = spark.createDataFrame([(ts(f"2024-01-0{d}").date(), 5.0, 2) for d in range(1, 8)], "event_date date, paid_spend_total double, organic_installs long")
    assert {r["corr"] for r in series.halo_lag_corr(df).collect()} == {None}
