"""Every report as a query over the bound test tables."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.fixture.bindings import SOURCES, bound_tables
from funnelworks.operators import kll_error
from funnelworks.plans import extensions, ltv, model
from funnelworks.plans.forest import Forest
from funnelworks.study import MODELLED, RELATIONAL, Report, Settings, Study

Query = Callable[[SparkSession, str], DataFrame]

# Thresholds that suit the test tables, where campaigns are small and series short.
SETTINGS = Settings(min_registrations=20, z_threshold=2.0, sources=SOURCES)


def comparable(df: DataFrame) -> DataFrame:
    """Money and rates as DOUBLE rounded half up to 6 digits, counts as BIGINT, so that two engines agree."""
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DecimalType, T.FractionalType)):
            # Plain arithmetic: rounding functions of two engines differ on an exact half.
            c = F.floor(c.cast("double") * F.lit(1e6) + F.lit(0.5)).cast("double") / F.lit(1e6)
        elif isinstance(field.dataType, T.IntegralType):
            c = c.cast("bigint")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def _fixed_score(s: Study) -> DataFrame:
    """Test rows with a score that SQL can repeat: twice the early revenue."""
    return model.with_residual(s.test.select(
        "user_id", *model.GROUPING, F.col(ltv.TARGET).alias("y_true"), (F.col("rev_0_14") * 2).alias("y_pred")
    ))


def _installer_bounds(s: Study) -> DataFrame:
    """Weekly installers exactly and whether the merged sketches keep their bound; the estimate itself is no other engine's."""
    estimates = extensions.installer_estimates(extensions.installer_state(s.events))
    kept = F.abs(F.col("installers") - F.col("installs")) <= F.greatest(F.col("three_errors"), F.lit(1.0))
    return s.weekly_installs.join(estimates, ["week", "source"], "left").select("week", "source", "installs", kept.alias("within_bound"))


def _amount_bounds(s: Study) -> DataFrame:
    """Monthly counts of amounts, and whether the share of values up to each merged quantile is what was asked for."""
    estimates = extensions.amount_estimates(extensions.amount_state(s.tx))
    month = F.trunc("transaction_timestamp", "month").alias("month")
    rows = s.tx.filter(F.col("transaction_timestamp").isNotNull()).select(month, "transaction_type", F.col("amount_usd").cast("double").alias("amount"))
    asked = {"p50": 0.5, "p75": 0.75, "p90": 0.9}

    def kept(name: str, p: float):
        below, upto = (F.avg(x.cast("double")) for x in (F.col("amount") < F.col(name), F.col("amount") <= F.col(name)))
        return ((below <= p + kll_error()) & (upto >= p - kll_error())).alias(f"{name}_within_bound")

    return rows.join(estimates, ["month", "transaction_type"]).groupBy("month", "transaction_type").agg(
        F.count("amount").alias("n"), *[kept(name, p) for name, p in asked.items()])


def _fixed_over_cac(s: Study) -> DataFrame:
    return model.ltv_over_cac(model.channel_value(_fixed_score(s)), s.channels)


def fixed_forest() -> Forest:
    """A small saved forest whose scores SQL can repeat."""
    return Forest.from_json((Path(__file__).parent / "forest.json").read_text())


def _forest_scored(s: Study) -> DataFrame:
    return model.score(model.ForestModel(fixed_forest()), s.test)


# What is read off a model, fed with the fixed score or the saved forest so that it can be checked.
FIXED_SCORE: dict[str, Report] = {
    "installer_sketch_bounds": _installer_bounds,
    "amount_sketch_bounds": _amount_bounds,
    "registered_value_fixed_score": lambda s: extensions.registered_value(_fixed_score(s)),
    "ltv_over_cac_by_platform_fixed_score": lambda s: extensions.ltv_over_cac_by_platform(_fixed_score(s), s.channels),
    "ltv_scores_fixed_forest": _forest_scored,
    "ltv_model_metrics_fixed_score": lambda s: model.model_metrics(_forest_scored(s)),
    "median_model_mae_fixed_score": lambda s: model.mean_absolute_error(_forest_scored(s)),
    "ltv_feature_importance_fixed_score": lambda s: model.permutation_importance(model.ForestModel(fixed_forest()), s.numbered_test),
    "residuals_by_channel_fixed_score": lambda s: model.residuals_by_channel(_fixed_score(s)),
    "channel_value_fixed_score": lambda s: model.channel_value(_fixed_score(s)),
    "ltv_over_cac_fixed_score": _fixed_over_cac,
    "predicted_payback_fixed_score": lambda s: extensions.predicted_payback(_fixed_over_cac(s)),
    "campaign_triage_fixed_score": lambda s: extensions.campaign_triage(_fixed_score(s), s.campaigns),
}

_fitted: dict[tuple[str, str], Study] = {}


def _fitted_study(spark: SparkSession, sf_dir: str) -> Study:
    """One study per session and folder, so that the model is fitted once for all queries on it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _fitted:
        _fitted[key] = Study(bound_tables(spark, sf_dir), SETTINGS)
    return _fitted[key]


def all_queries() -> dict[str, Query]:
    def fresh(report: Report) -> Query:
        return lambda spark, sf_dir: comparable(report(Study(bound_tables(spark, sf_dir), SETTINGS)))

    def fitted(report: Report) -> Query:
        return lambda spark, sf_dir: comparable(report(_fitted_study(spark, sf_dir)))

    return {n: fresh(r) for n, r in (RELATIONAL | FIXED_SCORE).items()} | {n: fitted(r) for n, r in MODELLED.items()}
