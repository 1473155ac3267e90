from __future__ import annotations

import math
from datetime import date

import pytest
from pyspark.sql import functions as F

from funnelworks.functions import (
    clip, fractional_days, guarded_ratio, is_not, normalised, parse_timestamp, plain_ratio, r2, safe_corr, week_start, whole_days,
)
from tests.frames import ts


def one(spark, column, **values):
    schema = ", ".join(f"{k} {v[1]}" for k, v in values.items())
    df = spark.createDataFrame([tuple(v[0] for v in values.values())], schema)
    return df.select(column).first()[0]


def test_guarded_ratio_is_null_without_positive_denominator(spark):
    for den in (0, -1, None):
        assert one(spark, guarded_ratio("a", "b"), a=(5, "int"), b=(den, "int")) is None
    assert one(spark, guarded_ratio("a", "b", 1000), a=(1, "int"), b=(4, "int")) == 250.0


def test_plain_ratio_by_zero_is_null_not_an_error(spark):
    assert one(spark, plain_ratio("a", "b"), a=(5, "int"), b=(0, "int")) is None
    assert one(spark, plain_ratio("a", "b"), a=(0, "int"), b=(7, "int")) == 0.0


def test_is_not_keeps_null(spark):
    df = spark.createDataFrame([("Organic",), (None,), ("Meta",)], "c string")
    assert {r[0] for r in df.filter(is_not("c", "Organic")).collect()} == {None, "Meta"}


def test_clip_keeps_null(spark):
    assert one(spark, clip(F.col("x"), 10.0, 200.0), x=(None, "double")) is None
    assert one(spark, clip(F.col("x"), 10.0, 200.0), x=(1.0, "double")) == 10.0
    assert one(spark, clip(F.col("x"), low=0.0), x=(-1.0, "double")) == 0.0


@pytest.mark.parametrize("pairs", [[], [(1.0, 2.0)], [(1.0, 2.0), (1.0, 5.0)], [(None, 1.0), (2.0, None)]])
def test_correlation_is_null_where_undefined(spark, pairs):
    df = spark.createDataFrame(pairs, "x double, y double")
    assert df.agg(safe_corr(F.col("x"), F.col("y"))).first()[0] is None


def test_correlation_uses_complete_pairs(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, None), (None, 9.0), (4.0, 7.0)], "x double, y double")
    xs, ys = [1, 2, 4], [2, 4, 7]
    mx, my = sum(xs) / 3, sum(ys) / 3
    expected = sum((a - mx) * (b - my) for a, b in zip(xs, ys)) / math.sqrt(
        sum((a - mx) ** 2 for a in xs) * sum((b - my) ** 2 for b in ys)
    )
    assert df.agg(safe_corr(F.col("x"), F.col("y"))).first()[0] == pytest.approx(expected)


def test_r2(spark):
    df = spark.createDataFrame([(1.0, 1.0), (2.0, 2.5), (3.0, 3.0)], "t double, p double")
    assert df.agg(r2(F.col("t"), F.col("p"))).first()[0] == pytest.approx(1 - 0.25 / 2)


def test_bad_timestamp_text_becomes_null(spark):
    assert one(spark, parse_timestamp(F.col("s")), s=("not a date", "string")) is None
    assert one(spark, parse_timestamp(F.col("s")), s=("2024-02-30", "string")) is None
    assert one(spark, parse_timestamp(F.col("s")), s=("2024-02-29 01:02:03", "string")) == ts("2024-02-29 01:02:03")
    assert one(spark, parse_timestamp(F.col("s"), "dd/MM/yyyy"), s=("29/02/2024", "string")) == ts("2024-02-29")


def test_weeks_start_on_monday(spark):
    for text, monday in (("2024-01-01 00:00", 1), ("2024-01-07 23:59", 1), ("2024-01-08 00:00", 8)):
        assert one(spark, week_start(F.col("t")), t=(ts(text), "timestamp_ntz")) == date(2024, 1, monday)


def test_whole_days_floor_below_zero(spark):
    c = whole_days(F.col("a"), F.col("b"))
    at = (ts("2024-01-10 12:00"), "timestamp_ntz")
    assert one(spark, c, a=at, b=(ts("2024-01-10 11:55"), "timestamp_ntz")) == -1
    assert one(spark, c, a=at, b=(ts("2024-01-11 11:59"), "timestamp_ntz")) == 0
    assert one(spark, c, a=at, b=(ts("2024-01-11 12:00"), "timestamp_ntz")) == 1


def test_durations_ignore_daylight_saving(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Amsterdam")
    try:
        for a, b, hours in (("2024-03-31 01:30", "2024-03-31 02:30", 1), ("2024-03-31 02:30", "2024-03-31 03:30", 1),
                            ("2024-10-26 12:00", "2024-10-27 12:00", 24), ("2024-10-27 02:30:00.000001", "2024-10-27 02:30", 0)):
            c = fractional_days(F.col("a"), F.col("b"))
            got = one(spark, c, a=(ts(a), "timestamp_ntz"), b=(ts(b), "timestamp_ntz"))
            assert got == pytest.approx(hours / 24, abs=1e-9) and (hours or got < 0)
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_normalised_strips_all_white_space_and_spells_missing(spark):
    assert one(spark, normalised(F.col("s")), s=("\t iOS\n", "string")) == "ios"
    assert one(spark, normalised(F.col("s")), s=(None, "string")) == "nan"
