"""Merged daily sketches against exact results, within their stated errors."""

from __future__ import annotations

from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import daily_state, hll_error, kll_error, merged
from funnelworks.sources import materialise

QUANTILES = {"p10": 0.1, "p50": 0.5, "p99": 0.99}


@pytest.fixture(scope="module")
def rows(spark):
    """40 days, two groups of which one holds nine tenths, users that come back, values with a long tail, NULLs."""
    draw = F.pmod(F.xxhash64("id"), F.lit(1_000_003)) / 1_000_003
    return spark.range(120_000).select(
        F.date_add(F.lit(date(2024, 1, 1)), F.pmod(F.xxhash64("id", F.lit(2)), F.lit(40)).cast("int")).alias("d"),
        F.when(F.col("id") % 10 > 0, "big").alias("g"),
        F.when(F.col("id") % 97 > 0, F.pmod(F.xxhash64("id", F.lit(1)), F.lit(30_000))).alias("user"),
        F.when(F.col("id") % 89 > 0, F.exp(8 * draw)).alias("v"))


@pytest.fixture(scope="module")
def state(rows):
    return materialise(daily_state(rows, F.col("d"), ["g"], {"users": "user"}, {"values": "v"}), "state")


def test_state_has_a_row_per_day_and_group(state):
    assert state.count() == 80 and set(state.columns) == {"day", "g", "n_rows", "users", "values"}


@pytest.mark.parametrize("days", [1, 7, 40])
def test_any_period_keeps_its_bound(rows, state, days):
    last = F.lit(date(2024, 1, 1) + timedelta(days=days - 1))
    got = {r["g"]: r for r in merged(state.filter(F.col("day") <= last), ["g"], ["users"], {"values": QUANTILES}).collect()}
    exact = rows.filter(F.col("d") <= last)
    assert set(got) == {"big", None}
    for g, r in got.items():
        own = exact.filter(F.col("g").eqNullSafe(F.lit(g)))
        n, users = own.agg(F.count("*"), F.count_distinct("user")).first()
        assert r["n_rows"] == n
        assert abs(r["users"] - users) <= 4 * hll_error() * users
        ranks = own.agg(*[F.avg((F.col("v") <= r[q]).cast("double")).alias(q) for q in QUANTILES]).first()
        assert all(abs(ranks[q] - p) <= kll_error() + 1 / n for q, p in QUANTILES.items())


def test_errors_fall_with_size():
    assert hll_error(14) == hll_error(12) / 2 and 0.01 < kll_error(200) < 0.02 and kll_error(400) < kll_error(200)


def test_state_of_nothing(spark):
    none = spark.createDataFrame([], "d date, g string, user bigint, v double")
    state = daily_state(none, F.col("d"), ["g"], {"users": "user"}, {"values": "v"})
    assert merged(state, ["g"], ["users"], {"values": QUANTILES}).count() == 0
    blank = spark.createDataFrame([(date(2024, 1, 1), "a", None, None)], "d date, g string, user bigint, v double")
    r = merged(daily_state(blank, F.col("d"), ["g"], {"users": "user"}), ["g"], ["users"]).first()
    assert (r["n_rows"], r["users"]) == (1, 0)
