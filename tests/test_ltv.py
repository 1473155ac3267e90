from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from funnelworks.plans import ltv
from funnelworks.sources import Tables
from funnelworks.study import Study
from tests.frames import events, profiles, rows, spend, ts, tx

FEE = 0.005 / 365.0


@pytest.fixture(scope="module")
def inputs(spark):
    e = events(spark, [
        (1, "2024-01-01 12:00", "install", "Meta", "m", " iOS\t", "NL"),
        (1, "2024-01-05 11:00", "registration", "Meta", "m"),
        (1, "2024-01-03", "install", "TikTok", "t"),               # later install: ignored
        (2, "2024-01-02", "install", "Organic", None, "android", "DE"),
        (2, "2024-01-01 23:00", "registration", "Organic", None),  # before the install
        (3, "2024-01-02", "install", "Referral", None, None, "DE"),
        (3, "2024-02-02", "registration", "Referral", None),       # too late to count
        (4, "2024-12-01", "install", "Meta", "m"),                 # label window not complete
        (5, "2024-01-02", "click", "Meta", "m"),                   # never installed
        (6, None, "install", "Meta", "m"),                         # unknown time
        (None, "2024-01-01", "install", "Meta", "m"),
        (None, "2024-01-02", "registration", "Meta", "m"),
    ])
    t = tx(spark, [
        (1, 1, "2024-01-01 12:00", "deposit", 100, 100),
        (3, 1, "2024-01-11 12:00", "withdrawal", 40, 60),
        (2, 1, "2024-01-11 12:00", "deposit", 0, 55),
        (4, 1, "2024-01-15 12:00", "transfer", 7, None),  # on the end of day 14; unknown balance
        (5, 1, "2024-02-01 12:00", "deposit", 40, 100),
        (6, 4, "2024-12-31", "deposit", 1, 1),
    ])
    s = spend(spark, [("2024-01-01", "Meta", "m", "a", 10, 1000, 20), ("2024-01-01", "Referral", None, "r", 8, 400, 4)])
    p = profiles(spark, [(1, "ios", True, 30, "male"), (2, "android", None, 40, "female"), (2, "android", False, 41, "female"),
                         (None, "ios", True, 99, "male")])
    return e, s, t, p


@pytest.fixture(scope="module")
def built(inputs):
    e, s, t, p = inputs
    eligible = ltv.eligible_installs(ltv.user_journeys(e), t)
    summary = ltv.account_summary(t, eligible)
    return eligible, summary, ltv.ltv_features(eligible, s, summary, p)


def test_eligible_users_have_a_complete_window(built):
    assert rows(built[0], "user_id", "channel") == [(None, "Meta"), (1, "Meta"), (2, "Organic"), (3, "Referral")]


def test_labels(built):
    out = {r["user_id"]: r for r in ltv.ltv_labels(*built[:2]).collect()}
    early = (100 * 10 + 60 * 4) * FEE                      # the unknown balance of day 14 earns nothing
    late = early + 100 * (180 - 31) * FEE
    assert out[1]["rev_0_14"] == pytest.approx(early) and out[1]["rev_0_H"] == pytest.approx(late)
    assert out[1]["y_rev_14_H"] == pytest.approx(late - early)
    assert (out[2]["rev_0_14"], out[2]["y_rev_14_H"]) == (0.0, 0.0) and None in out


def test_falling_revenue_is_clipped_to_zero(spark):
    t = tx(spark, [(1, 1, "2024-01-01", "deposit", 1, 100), (2, 1, "2024-01-20", "withdrawal", 1, -500), (3, 9, "2024-12-31", "deposit", 1, 1)])
    eligible = ltv.eligible_installs(ltv.user_journeys(events(spark, [(1, "2024-01-01", "install", "Meta", "m")])), t)
    out = ltv.ltv_labels(eligible, ltv.account_summary(t, eligible)).first()
    assert out["rev_0_H"] < out["rev_0_14"] and out["y_rev_14_H"] == 0.0


def test_early_activity(built):
    assert [tuple(None if v is None else float(v) for v in r) for r in ltv.tx_features_14d(built[1]).collect()] == [
        # tx_count dep_sum dep_cnt wdr_sum wdr_cnt bal_max bal_mean bal_last net_flow
        (1.0, 4.0, 100.0, 2.0, 40.0, 1.0, 100.0, pytest.approx((100 + 60 + 55) / 3), 60.0, 60.0),
    ]


def test_registration_features(built):
    out = rows(ltv.registration_features(built[0]), "user_id", "reg_within_14d", "days_to_reg")
    assert out == [(None, True, 1), (1, True, 3), (2, True, -1), (3, False, None)]


def test_features(built):
    out = {(r["user_id"], r["age"]): r for r in built[2].collect()}
    assert set(out) == {(1, 30), (2, 40), (2, 41), (3, None), (None, 99)}  # one row per profile row; NULL ids match
    assert out[1, 30]["platform_norm"] == "ios" and out[1, 30]["channel_platform"] == "Meta__ios"
    assert out[3, None]["platform_norm"] == "nan" and out[3, None]["channel_platform"] == "Referral__nan"
    assert out[1, 30]["camp_CTR"] == 0.02 and out[1, 30]["camp_CPM"] == 10.0 and out[1, 30]["camp_CPC"] == 0.5
    assert out[3, None]["camp_CTR"] == 0.01  # campaign NULL matches the NULL campaign of spend
    assert out[2, 40]["camp_CTR"] is None and out[2, 40]["tx_count"] == 0 and float(out[2, 40]["bal_max"]) == 0.0


@pytest.mark.parametrize(("n", "frac"), [(23, 0.8), (23, 0.0), (23, 1.0), (1, 0.8), (0, 0.8), (40, 0.5), (23, 0.1)])
def test_split_is_by_time(spark, n, frac):
    """Days with several rows, several rows of one instant, rows without a time or an id."""
    data = [(None if u == 7 else u, None if u % 11 == 5 else ts(f"2024-01-{1 + u % 4:02d} {u % 3:02d}:00"), u % 2) for u in range(n)]
    df = spark.createDataFrame(data, "user_id long, install_date timestamp_ntz, x int")
    out = ltv.time_split(df.repartition(5), frac=frac).collect()
    ordered = sorted(data, key=lambda r: (r[1] is None, r[1] or ts("2024-01-01"), r[0] is None, r[0] or 0))
    train = {r[:2] for r in ordered[:int(n * frac)]}
    assert len(out) == n and {(r["user_id"], r["install_date"]) for r in out if r["is_train"]} == train
    assert sum(r["is_train"] for r in out) == int(n * frac)


def test_dataset_columns(inputs):
    e, s, t, p = inputs
    study = Study(Tables(e, s, p, t, None))
    out = study.data
    assert out.columns == [*ltv.KEYS, *ltv.FEATURES, ltv.TARGET, "is_train"]
    assert out.count() == 5 and out.filter("is_train").count() == 4
    assert out.filter(F.col("reg_within_14d").isNull()).count() == 0
    assert [r["row_index"] for r in study.numbered_test.collect()] == [0]


def test_rows_without_ids_still_work(inputs):
    e, s, t, p = inputs
    eligible = ltv.eligible_installs(ltv.user_journeys(e.drop("event_id")), t.drop("tx_id"))
    out = {r["user_id"]: r["rev_0_H"] for r in ltv.ltv_labels(eligible, ltv.account_summary(t.drop("tx_id"), eligible)).collect()}
    assert set(out) == {None, 1, 2, 3} and out[1] > 0
