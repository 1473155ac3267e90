from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from funnelworks.functions import add_days
from funnelworks.operators import fee_revenue_interval, heavy_users
from tests.frames import tx, ts

FEE = 0.005 / 365.0


def windows(spark, *rows):
    df = spark.createDataFrame([(u, ts(s)) for u, s in rows], "user_id long, start timestamp_ntz")
    return df.withColumns({"end_14": add_days(F.col("start"), 14), "end_30": add_days(F.col("start"), 30)})


def fees(df):
    return {r["user_id"]: (r["short"], r["long"]) for r in df.collect()}


ENDS = {"short": "end_14", "long": "end_30"}


def brute_force(tx_rows, start, end):
    """Balance-days of one user's (instant, id, balance) rows inside [start, end], times the fee."""
    inside = sorted(r for r in tx_rows if start <= r[0] <= end)
    total = 0.0
    for this, following in zip(inside, [*inside[1:], (end,)]):
        total += this[2] * (following[0] - this[0]).total_seconds() / 86400.0
    return total * FEE


def test_balances_hold_until_the_next_transaction_or_the_end(spark):
    t = tx(spark, [
        (1, 1, "2024-01-01 00:00", "deposit", 100, 100),   # on the start: counts
        (2, 1, "2024-01-11 00:00", "deposit", 100, 200),
        (3, 1, "2024-01-31 00:00", "deposit", 100, 300),   # on the long end: counts, earns nothing
        (4, 1, "2023-12-31 23:59", "deposit", 900, 900),   # before the start: not carried in
        (5, 2, "2024-01-15 00:00", "deposit", 50, 50),     # on the short end
    ])
    out = fees(fee_revenue_interval(t, windows(spark, (1, "2024-01-01"), (2, "2024-01-01"), (3, "2024-01-01")), "start", ENDS))
    assert out[1] == pytest.approx(((100 * 10 + 200 * 4) * FEE, (100 * 10 + 200 * 20) * FEE))
    assert out[2] == pytest.approx((0.0, 50 * 16 * FEE))
    assert 3 not in out  # no transaction at all


def test_rows_of_one_instant_count_in_id_order(spark):
    t = tx(spark, [
        (7, 1, "2024-01-02", "deposit", 5, 70), (9, 1, "2024-01-02", "deposit", 5, 90), (8, 1, "2024-01-02", "deposit", 5, 80),
    ])
    out = fees(fee_revenue_interval(t, windows(spark, (1, "2024-01-01")), "start", ENDS))
    assert out[1] == pytest.approx((90 * 13 * FEE, 90 * 29 * FEE))


def test_unknown_balance_earns_nothing(spark):
    t = tx(spark, [(1, 1, "2024-01-01", "deposit", 5, None), (2, 1, "2024-01-03", "deposit", 5, 10)])
    out = fees(fee_revenue_interval(t, windows(spark, (1, "2024-01-01")), "start", ENDS))
    assert out[1] == pytest.approx((10 * 12 * FEE, 10 * 28 * FEE))


def test_missing_user_or_time_is_ignored(spark):
    t = tx(spark, [(1, None, "2024-01-02", "deposit", 5, 5), (2, 1, None, "deposit", 5, 5), (3, 1, "2024-01-02", "deposit", 5, 5)])
    out = fees(fee_revenue_interval(t, windows(spark, (1, "2024-01-01"), (None, "2024-01-01")), "start", ENDS))
    assert set(out) == {1}


@pytest.mark.parametrize(("bucket_hours", "heavy"), [(1, []), (168, None), (168, [1, 5]), (9600, [1])])
def test_against_brute_force_with_a_user_that_owns_most_rows(spark, bucket_hours, heavy):
    rng = random.Random(3)
    base = datetime(2024, 1, 1)
    raw, by_user = [], {}
    for i in range(3000):
        user = 1 if i % 3 else rng.randrange(2, 60)  # user 1 holds two thirds
        at = base + timedelta(minutes=rng.randrange(0, 60 * 24 * 60, 7))
        balance = rng.randrange(-50, 500)
        raw.append((i, user, at.isoformat(), "deposit", 1, balance))
        by_user.setdefault(user, []).append((at, i, balance))
    starts = {u: base + timedelta(hours=rng.randrange(0, 24 * 40)) for u in by_user}
    w = windows(spark, *[(u, s.isoformat()) for u, s in starts.items()])
    out = fees(fee_revenue_interval(tx(spark, raw), w, "start", ENDS, bucket_hours=bucket_hours, heavy=heavy))
    for user, start in starts.items():
        expected = tuple(brute_force(by_user[user], start, start + timedelta(days=d)) for d in (14, 30))
        assert out.get(user, (0.0, 0.0)) == pytest.approx(expected, abs=1e-9), user


def test_a_transaction_that_keeps_the_balance_changes_nothing(spark):
    rows = [(1, 1, "2024-01-02", "deposit", 5, 50), (2, 1, "2024-01-20", "deposit", 5, 80)]
    w = windows(spark, (1, "2024-01-01"))
    before = fees(fee_revenue_interval(tx(spark, rows), w, "start", ENDS))
    after = fees(fee_revenue_interval(tx(spark, [*rows, (3, 1, "2024-01-09 13:00", "deposit", 0, 50)]), w, "start", ENDS))
    assert after[1] == pytest.approx(before[1])


def test_a_longer_window_never_earns_less_on_positive_balances(spark):
    rng = random.Random(11)
    raw = [(i, rng.randrange(20), (datetime(2024, 1, 1) + timedelta(hours=rng.randrange(1400))).isoformat(), "deposit", 1, rng.randrange(100)) for i in range(500)]
    w = windows(spark, *[(u, "2024-01-05") for u in range(20)])
    out = fees(fee_revenue_interval(tx(spark, raw), w, "start", ENDS))
    assert len(out) == 20 and all(0 <= short <= long for short, long in out.values())


def test_heavy_users_are_found(spark):
    t = tx(spark, [(i, 1 if i % 3 else 10 + i, "2024-01-02", "deposit", 5, 50) for i in range(300)] + [(999, None, "2024-01-02", "deposit", 5, 50)])
    assert heavy_users(t, min_rows=100) == [1] and heavy_users(t.limit(0), min_rows=1) == []


def test_hot_user_is_spread_before_any_per_user_step(spark):
    """No exchange by user alone may carry transaction rows."""
    t = tx(spark, [(1, 1, "2024-01-02", "deposit", 5, 50)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = fee_revenue_interval(t, windows(spark, (1, "2024-01-01")), "start", ENDS)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    lines = plan.splitlines()
    by_user = [i for i, line in enumerate(lines) if "Exchange hashpartitioning(user_id#" in line and line.split("hashpartitioning(")[1].count("#") == 1]
    assert len(by_user) == 1
    assert "HashAggregate(keys=[user_id" in lines[by_user[0] + 1] and "bucket" in lines[by_user[0] + 1]
