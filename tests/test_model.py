from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from funnelworks.operators import with_row_index
from funnelworks.plans import model
from funnelworks.plans.forest import Forest, Split
from funnelworks.sources import materialise
from tests.frames import rows

FEATURES = ["driver", "noise", "constant", "kind", "flag"]
SCHEMA = "user_id long, channel string, campaign_id string, driver double, noise double, constant double, kind string, flag boolean, y double"


def invented(spark, n, seed):
    rng = random.Random(seed)
    data = []
    for i in range(n):
        driver, kind = rng.uniform(0, 5), rng.choice("abc")
        y = 10 * driver + (20 if kind == "a" else 0)
        data.append((i, rng.choice(["Meta", "TikTok"]), None, None if i % 50 == 0 else driver, rng.random(), 1.0, kind, rng.random() < 0.5, y))
    return spark.createDataFrame(data, SCHEMA)


@pytest.fixture(scope="module")
def study(spark):
    train = materialise(invented(spark, 400, 1), "train")
    test = with_row_index(invented(spark, 120, 2), [F.col("user_id")])
    return train, test, model.fit_ltv(train, FEATURES, "y", max_iter=12)


def test_column_kinds(spark, study):
    assert model.column_kinds(study[0], FEATURES) == (["driver", "noise", "constant"], ["kind", "flag"])


def test_fill_values(spark):
    df = spark.createDataFrame(
        [(1.0, "b", True, None, None), (2.0, "a", False, None, None), (3.0, "b", None, None, None), (10.0, "a", None, None, None), (None, None, False, None, None)],
        "x double, c string, f boolean, void double, blank string",
    )
    fills, levels = model.fill_values(df, ["x", "void"], ["c", "f", "blank"])
    assert fills == {"x": 2.5, "c": "a", "f": "false", "void": 0.0, "blank": ""}
    assert levels == {"c": 2, "f": 2, "blank": 0}


def test_every_level_is_one_hot(spark, study):
    train, test, fitted = study
    levels = train.agg(*[F.count_distinct(F.coalesce(F.col(c).cast("string"), F.lit(fitted.fills[c]))) for c in fitted.categorical]).first()
    assert fitted.pipeline.stages[-1].numFeatures == len(fitted.numeric) + sum(levels)
    odd = test.limit(1).withColumn("kind", F.lit("never seen"))
    assert model.score(fitted, odd, "y").first()["y_pred"] is not None
    assert model.model_metrics(model.score(fitted, test, "y")).first()["r2_log"] > 0.5


def test_model_beats_the_mean_and_repeats(spark, study):
    train, test, fitted = study
    metrics = model.model_metrics(model.score(fitted, test, "y")).first()
    assert metrics["r2_log"] > 0.5 and metrics["n"] == 120 and metrics["mae"] <= metrics["rmse"]
    again = model.model_metrics(model.score(model.fit_ltv(train, FEATURES, "y", max_iter=12), test, "y")).first()
    assert again == metrics


def test_unseen_levels_and_missing_values_are_scored(spark, study):
    odd = spark.createDataFrame([(1, None, None, None, None, None, "never seen", None, 3.0)], SCHEMA)
    out = model.score(study[2], odd, "y").first()
    assert out["channel"] is None and out["y_pred"] is not None and out["residual"] == pytest.approx(3.0 - out["y_pred"])


@pytest.mark.parametrize("size", [1, 2, 3, 24, 50, 97, 1000])
def test_permutations_are_one_to_one_and_differ(size):
    maps = []
    for factor, inverse, offset in model.permutations(size, repeats=4):
        donor = [(factor * s + offset) % size for s in range(size)]
        assert sorted(donor) == list(range(size))
        assert all((d + size - offset) * inverse % size == s for s, d in enumerate(donor))
        maps.append(tuple(donor))
    if size >= 50:
        assert len(set(maps)) == 4 and all(sum(s == d for s, d in enumerate(m)) < size / 4 for m in maps)


def test_importance_of_driver_noise_and_constant(spark, study):
    _, test, fitted = study
    out = {r["feature"]: r for r in model.permutation_importance(fitted, test, FEATURES, "y").collect()}
    assert set(out) == set(FEATURES)
    assert out["driver"]["importance_mean"] > 0.3 and out["driver"]["importance_std"] > 0
    assert out["constant"]["importance_mean"] == 0.0 and out["constant"]["importance_std"] == 0.0
    assert out["driver"]["importance_mean"] > out["kind"]["importance_mean"] > abs(out["noise"]["importance_mean"])


def test_importance_is_scored_by_slot_and_sends_no_rows_to_the_driver(spark, study):
    _, test, fitted = study
    plan = model.permutation_importance(fitted, test, FEATURES, "y")._jdf.queryExecution().toString()
    to_rows = [x for x in plan.splitlines() if "Join" in x and "_slot" in x]
    assert to_rows and any("SortMergeJoin" in x for x in to_rows) and not any("BroadcastHashJoin" in x for x in to_rows)


def test_boosting_runs_in_no_more_tasks_than_rows_fill(spark, monkeypatch):
    many = spark.range(1_000, numPartitions=37)
    assert model.in_full_tasks(many).rdd.getNumPartitions() == 1
    cores = spark.sparkContext.defaultParallelism
    few = model.in_full_tasks(many, rows=10)
    assert few.rdd.getNumPartitions() == cores and few.count() == 1_000
    assert model.in_full_tasks(many.filter("id < 0")).count() == 0

    seen = []
    monkeypatch.setattr(model, "in_full_tasks", lambda train, real=model.in_full_tasks: seen.append(real(train)) or seen[-1])
    train = materialise(invented(spark, 200, 1).repartition(16), "train")
    model.fit_ltv(train, FEATURES, "y", max_iter=1)
    assert [x.rdd.getNumPartitions() for x in seen] == [1] and seen[0].count() == 200


def test_median_model_reaches_the_median_of_a_skewed_target(spark):
    """Six of ten labels are 0 whatever the features say, the others are large."""
    rng = random.Random(7)
    data = [(i, "Meta", None, rng.uniform(0, 5), rng.random(), 1.0, rng.choice("abc"), True, 0.0 if rng.random() < 0.6 else rng.uniform(20, 900)) for i in range(1500)]
    train = materialise(spark.createDataFrame(data, SCHEMA), "skewed")
    fitted = model.fit_ltv(train, FEATURES, "y", loss="absolute", max_iter=15)
    out = fitted.predict_log(train).select(F.log1p("y").alias("t"), "prediction").agg(
        F.median("prediction").alias("median"), F.avg((F.col("t") >= F.col("prediction") - 1e-9).cast("double")).alias("above"),
        F.avg((F.col("t") <= F.col("prediction") + 1e-9).cast("double")).alias("below")).first()
    assert abs(out["median"]) < 0.05
    assert out["above"] >= 0.5 and out["below"] >= 0.5


def test_median_model_follows_its_features(spark, study):
    train, test, _ = study
    fitted = model.fit_ltv(train, FEATURES, "y", loss="absolute", max_iter=12)
    error = model.mean_absolute_error(model.score(fitted, test, "y")).first()["mae"]
    median = test.agg(F.median("y").alias("m")).first()["m"]
    assert error < 0.4 * test.agg(F.avg(F.abs(F.col("y") - F.lit(median))).alias("e")).first()["e"]


def test_forest_is_the_model_as_a_column_and_as_sql(spark, study):
    import duckdb

    train, test, fitted = study
    odd = spark.createDataFrame([(1000, None, None, None, None, None, "never seen", None, 3.0), (1001, None, None, 2.0, 0.5, 1.0, None, True, 3.0)], SCHEMA)
    rows_ = test.drop("row_index").unionByName(odd)
    forest = fitted.forest()
    assert len(forest.trees) == 12 and {s.level for t in forest.trees for s in splits(t)} - {None}
    again = Forest.from_json(forest.to_json())
    assert again == forest
    theirs = {r["user_id"]: r["prediction"] for r in fitted.predict_log(rows_).collect()}
    mine = {r["user_id"]: r["prediction"] for r in model.ForestModel(again).predict_log(rows_).collect()}
    assert mine == pytest.approx(theirs, abs=1e-12)
    scored = rows_.toArrow()
    got = duckdb.connect().execute(f"SELECT user_id, {forest.sql()} FROM scored").fetchall()
    assert dict(got) == pytest.approx(theirs, abs=1e-12) and len(scored) == len(got)


def splits(node):
    if isinstance(node, Split):
        yield node
        yield from splits(node.yes)
        yield from splits(node.no)


def test_too_many_levels_are_refused_before_they_are_collected(spark, monkeypatch):
    monkeypatch.setattr(model, "MAX_LEVELS", 2)
    with pytest.raises(ValueError, match="kind"):
        model.fit_ltv(invented(spark, 30, 1), FEATURES, "y", max_iter=1)


def test_reports_from_scores(spark):
    scored = model.with_residual(spark.createDataFrame(
        [(1, "Meta", None, 5.0, 1.0), (2, "Meta", None, 5.0, 3.0), (3, "Free", None, 1.0, 0.0), (4, None, None, 1.0, 1.0), (5, "NoCost", None, 1.0, 1.0)],
        "user_id long, channel string, campaign_id string, y_true double, y_pred double",
    ))
    assert rows(model.residuals_by_channel(scored)) == [("Free", 1.0, 1.0, 1), ("Meta", 3.0, 3.0, 2), ("NoCost", 0.0, 0.0, 1)]
    value = model.channel_value(scored)
    assert rows(value)[1] == ("Meta", 2.0, 2.0, 2.5, pytest.approx(2.8), 0.0, 2) and rows(value)[0] == ("Free", 0.0, 0.0, 0.0, 0.0, 1.0, 1)
    channels = spark.createDataFrame([("Meta", 4.0), ("Free", 0.0), ("NoCost", None)], "channel string, CAC double")
    out = model.ltv_over_cac(value, channels).select("channel", "LTV_over_CAC", "is_free_channel").collect()
    assert [tuple(r) for r in out] == [("Free", None, True), ("Meta", 0.5, False)]
