from __future__ import annotations

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import (
    exact_quantiles, first_event, hot_keys, lag_correlation, mix_share, modes, null_safe_join, organic_paid_ratio,
    rolling_zscore, salted_join, shift_fit, top_extremes, user_days, with_row_index,
)
from tests.frames import events, rows, ts


def test_first_event_takes_missing_times_last_and_breaks_ties_by_id(spark):
    e = events(spark, [
        (1, None, "install", "Meta", "a"), (1, "2024-01-05", "install", "TikTok", "b"), (1, "2024-01-05", "install", "Referral", "c"),
        (1, "2024-01-01", "click", "Organic", None), (2, None, "install", "Meta", "d"), (None, "2024-01-02", "install", "Meta", "e"),
    ])
    assert rows(first_event(e, "install"), "user_id", "campaign_id") == [(None, "e"), (1, "b"), (2, "d")]


def test_first_event_prunes_rows_before_the_shuffle(spark):
    plan = first_event(events(spark, [(1, "2024-01-05", "install", "Meta", "a")]), "install")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_first_event_without_row_id_is_deterministic(spark):
    e = events(spark, [(1, "2024-01-05", "install", s, None) for s in ("Meta", "Google", "TikTok")]).drop("event_id")
    picked = {rows(first_event(e.repartition(n), "install"), "source")[0] for n in (1, 2, 3)}
    assert len(picked) == 1


def test_null_keys_match_in_null_safe_join(spark):
    left = spark.createDataFrame([(None, "x"), ("a", None), ("b", "y")], "k string, l string")
    right = spark.createDataFrame([(None, "x", 1), ("a", None, 2), ("b", None, 3)], "k string, l string, v int")
    assert rows(null_safe_join(left, right, ["k", "l"])) == [(None, "x", 1), ("a", None, 2), ("b", "y", None)]


def test_salted_join_spreads_a_hot_null_key_and_keeps_the_rows(spark):
    """Nine of ten rows lie on (Organic, NULL)."""
    left = spark.range(20_000).select(
        "id", F.when(F.col("id") % 10 > 0, "Organic").otherwise(F.concat(F.lit("c"), F.col("id") % 977)).alias("channel"),
        F.when(F.col("id") % 10 > 0, None).otherwise((F.col("id") % 31).cast("string")).alias("campaign"))
    right = left.select("channel", "campaign").distinct().filter("channel <> 'c5'").withColumn("v", F.xxhash64("channel", "campaign"))
    for key, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "16"}.items():
        spark.conf.set(key, value)
    try:
        assert len(hot_keys(left, ["channel", "campaign"])) == 1
        out = salted_join(left, right, ["channel", "campaign"])
        per_task = sorted(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect())
        assert len(per_task) == 16 and per_task[-1] < 3 * per_task[8]
        plain = null_safe_join(left, right, ["channel", "campaign"])
        assert out.columns == plain.columns
        assert out.exceptAll(plain).count() == 0 and plain.exceptAll(out).count() == 0
    finally:
        for key in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(key)
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_salted_join_without_hot_keys_is_a_plain_one(spark):
    left = spark.createDataFrame([(None, 1)], "k string, a int")
    assert rows(salted_join(left, spark.createDataFrame([(None, 2)], "k string, b int"), ["k"], hot=[])) == [(None, 1, 2)]
    assert hot_keys(left.limit(0), ["k"]) == []


@pytest.mark.parametrize("tie", ["bigint", "string", None])
def test_user_days_keep_first_events_and_counts(spark, tie):
    rng = random.Random(8)
    base = datetime(1969, 12, 30)
    data = []
    for i in range(400):
        at = None if rng.random() < 0.1 else base + timedelta(minutes=rng.randrange(0, 4 * 1440, 180), microseconds=rng.choice([0, 1]))
        data.append((i - 200, rng.choice([1, 2, None]), at, rng.choice(["install", "registration", "click"]), rng.choice(["Meta", None]), None, "ios", "NL"))
    rng.shuffle(data)
    e = spark.createDataFrame(data, "event_id long, user_id long, event_timestamp timestamp_ntz, event_name string, source string, campaign_id string, platform string, country string")
    e = e.drop("event_id") if tie is None else e.withColumn("event_id", F.col("event_id").cast(tie))
    days = user_days(e.repartition(3))
    expected: dict = {}
    n: Counter = Counter()
    for i, user, at, kind, source, *_ in data:
        if kind == "click":
            continue
        key = (kind, user, at and at.date(), source)
        first = (at or base, i if tie == "bigint" else str(i) if tie else 0)
        expected[key], n[key] = min(expected.get(key, first), first), n[key] + 1
    got = {(r["event_name"], r["user_id"], r["event_date"], r["source"]): (r["event_timestamp"] or base, r["event_id"] if tie else 0, r["n_events"]) for r in days.collect()}
    assert got == {k: (*v, n[k]) for k, v in expected.items()}
    assert user_days(days) is days


def series(spark, values, group="g"):
    data = [(group, ts(f"2024-01-{i + 1:02d}").date(), x, y) for i, (x, y) in enumerate(values)]
    return spark.createDataFrame(data, "platform string, event_date date, x double, y double")


def test_lag_pairs_with_earlier_rows_and_lead_with_later_ones(spark):
    xs = [1.0, 5.0, 2.0, 8.0, 3.0, 9.0]
    df = series(spark, list(zip(xs, [0.0, *xs[:-1]])))  # y follows x by one row
    lead = {r["lag_days"]: r["corr"] for r in lag_correlation(df, "x", "y", [0, 1], by=["platform"], direction="lead").collect()}
    assert lead[1] == pytest.approx(1.0) and lead[0] != pytest.approx(1.0)
    back = {r["lag_days"]: r["corr"] for r in lag_correlation(df, "y", "x", [0, 1], by=["platform"]).collect()}
    assert back[1] == pytest.approx(1.0)


def test_differences_remove_a_trend(spark):
    df = series(spark, [(float(i), float(2 * i)) for i in range(6)])
    assert lag_correlation(df, "x", "y", [0]).first()["corr"] == pytest.approx(1.0)
    assert lag_correlation(df, "x", "y", [0], diff=True).first()["corr"] is None  # constant steps


def test_shift_longer_than_the_series_is_null(spark):
    out = {r["shift_days"]: (r["corr"], r["mae"]) for r in shift_fit(series(spark, [(1.0, 2.0), (2.0, 1.0)]), "x", "y", [0, 1, 5]).collect()}
    assert out[0] == (pytest.approx(-1.0), 1.0) and out[1] == (None, 0.0) and out[5] == (None, None)


def test_rolling_score_needs_enough_rows_and_some_spread(spark):
    flat = rolling_zscore(series(spark, [(1.0, 1.0)] * 10), "x", ["platform"], window=14)
    assert {r["z"] for r in flat.collect()} == {None}
    values = [1.0, 2.0, 1.0, 2.0, 1.0, 2.0, 1.0, 9.0]
    out = [r["z"] for r in rolling_zscore(series(spark, [(v, 0.0) for v in values]), "x", ["platform"]).orderBy("event_date").collect()]
    assert out[:6] == [None] * 6 and out[6] is not None
    mean = sum(values) / 8
    sd = (sum((v - mean) ** 2 for v in values) / 7) ** 0.5
    assert out[7] == pytest.approx((9.0 - mean) / sd)


def test_rolling_score_skips_missing_values(spark):
    out = [r["z"] for r in rolling_zscore(series(spark, [(None, 0.0), (1.0, 0.0), (2.0, 0.0), (4.0, 0.0)]), "x", ["platform"], min_periods=3).orderBy("event_date").collect()]
    assert out[:3] == [None] * 3 and out[3] == pytest.approx((4 - 7 / 3) / (((1 - 7 / 3) ** 2 + (2 - 7 / 3) ** 2 + (4 - 7 / 3) ** 2) / 2) ** 0.5)


def test_top_extremes_per_group(spark):
    df = series(spark, [(1.0, 0.0), (-5.0, 0.0), (3.0, 0.0), (None, 0.0)]).union(series(spark, [(0.5, 0.0), (-0.1, 0.0)], "h"))
    assert rows(top_extremes(df, "x", ["platform"], k=2), "platform", "x") == [("g", -5.0), ("g", 3.0), ("h", -0.1), ("h", 0.5)]


def test_shares_sum_to_one_and_zero_total_is_null(spark):
    df = spark.createDataFrame([("a", 1), ("a", 3), ("b", 0)], "g string, v int")
    assert rows(mix_share(df, ["g"], "v"), "g", "share") == [("a", 0.25), ("a", 0.75), ("b", None)]


def test_organic_and_paid_may_overlap(spark):
    e = events(spark, [
        (1, "2024-01-01", "install", "Organic", None), (1, "2024-01-02", "install", "Meta", "m"), (2, "2024-01-01", "install", None, None),
        (3, "2024-01-01", "install", "Organic", None, "android"), (None, "2024-01-01", "install", "Organic", None, "android"),
        (4, "2024-01-01", "install", "Organic", None, None),
    ])
    out = rows(organic_paid_ratio(e, "platform"), "platform", "installs_total", "installs_organic", "installs_paid", "organic_share", "organic_to_paid_ratio")
    assert out == [("android", 1, 1, 0, 1.0, None), ("ios", 2, 1, 2, 0.5, 0.5)]


def test_row_index_is_dense_and_ordered(spark):
    data = [(i * 37 % 1000, i) for i in range(1000)]
    df = spark.createDataFrame(data, "a int, b int").repartition(7)
    out = with_row_index(df, [F.col("a")]).orderBy("row_index").collect()
    assert [r["row_index"] for r in out] == list(range(1000)) and [r["a"] for r in out] == sorted(a for a, _ in data)


def test_exact_quantiles(spark):
    rng = random.Random(5)
    # One group holds most rows and most of them share one value.
    data = [("hot", 0.0 if rng.random() < 0.7 else rng.uniform(-5, 5)) for _ in range(900)]
    data += [("small", v) for v in (1.0, 2.0, 3.0, 10.0)] + [("one", 4.0), ("empty", None), (None, 1.0), (None, 3.0)]
    df = spark.createDataFrame(data, "g string, v double")
    probs = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    out = {r["g"]: [r[p] for p in probs] for r in exact_quantiles(df, ["g"], "v", probs).collect()}

    def interpolated(values, p):
        values = sorted(values)
        k = p * (len(values) - 1)
        low = int(k)
        return values[low] + (k - low) * (values[min(low + 1, len(values) - 1)] - values[low])

    groups = {}
    for g, v in data:
        if v is not None:
            groups.setdefault(g, []).append(v)
    assert set(out) == set(groups) and out["small"][1] == 2.5
    for g, values in groups.items():
        assert out[g] == pytest.approx([interpolated(values, p) for p in probs.values()])


def test_exact_quantiles_without_groups(spark):
    df = spark.createDataFrame([(float(v),) for v in (5, 1, 9, 3)], "v double")
    assert exact_quantiles(df, [], "v", {"m": 0.5}).first()["m"] == 4.0


def test_mode_takes_the_smallest_on_ties(spark):
    df = spark.createDataFrame([("f", "b", 2), ("f", "a", 2), ("f", "c", 1), ("f", None, 9)], "f string, v string, n long")
    assert rows(modes(df, ["f"], "v", "n")) == [("f", "a", 3)]
