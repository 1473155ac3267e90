"""Lifetime-value model on Spark ML: boosted trees on the log target, and what is read off it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from math import gcd
from typing import Literal

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from funnelworks.functions.ratios import plain_ratio
from funnelworks.functions.stats import r2
from funnelworks.operators.order_stats import exact_quantiles, modes
from funnelworks.plans.forest import Forest, Leaf, from_description, leaves
from funnelworks.plans.ltv import FEATURES, TARGET
from funnelworks.sources.storage import checkpoint_root, materialise

# Tree depth, learning rate and seed; the others mirror the usual histogram-boosting defaults.
MAX_DEPTH, LEARNING_RATE, SEED = 6, 0.08, 42
MAX_ITER, MAX_BINS, MIN_LEAF_ROWS = 100, 255, 20
REFIT_TREES, REFIT_STEP = 20, 0.3  # of the median model
MAX_LEVELS = 100_000  # of all categorical features: they come to the driver, one vector position each
TASK_ROWS = 16_384  # of training rows: boosting runs two stages a level and tree, so smaller tasks are mostly overhead
REPEATS = 5
ZERO_PREDICTION = 1e-6
GROUPING = ("channel", "campaign_id", "platform", "reg_within_14d")  # columns of scored rows


def column_kinds(df: DataFrame, features: Sequence[str]) -> tuple[list[str], list[str]]:
    """(numeric, categorical): text and boolean columns are categorical."""
    categorical = [f for f in features if isinstance(df.schema[f].dataType, (T.StringType, T.BooleanType))]
    return [f for f in features if f not in categorical], categorical


def fill_table(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> DataFrame:
    """(feature, median, mode, levels): what stands in for missing values, one row per feature with a value.

    Exact median per numeric feature; most frequent level, the smallest of a tie, and number of levels per categorical one.
    """
    out = train.sparkSession.createDataFrame([], "feature string, median double, mode string, levels bigint")
    if numeric:
        long = train.select(*[F.col(c).cast("double").alias(c) for c in numeric]).unpivot([], list(numeric), "feature", "value")
        out = out.unionByName(exact_quantiles(long, ["feature"], "value", {"median": 0.5}), allowMissingColumns=True)
    if categorical:
        long = train.select(*[F.col(c).cast("string").alias(c) for c in categorical]).unpivot([], list(categorical), "feature", "level")
        counted = long.groupBy("feature", "level").agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(modes(counted, ["feature"], "level", "n"), allowMissingColumns=True)
    return out


def fill_values(train: DataFrame, numeric: Sequence[str], categorical: Sequence[str]) -> tuple[dict, dict[str, int]]:
    """(fills, levels) by feature. One row per feature comes back to the driver; a feature without values gets 0 or ''."""
    fills: dict = {c: 0.0 for c in numeric} | {c: "" for c in categorical}
    levels = {c: 0 for c in categorical}
    for row in fill_table(train, numeric, categorical).collect():
        if row["feature"] in levels:
            fills[row["feature"]], levels[row["feature"]] = row["mode"], row["levels"]
        else:
            fills[row["feature"]] = row["median"]
    return fills, levels


def in_full_tasks(train: DataFrame, rows: int = TASK_ROWS) -> DataFrame:
    """``train`` in no more partitions than the cluster has cores, or than hold ``rows`` rows each.

    Every task of every level and tree reports to the driver, so their number must not follow the files of the table.
    """
    full = -(-train.count() // rows)
    return train.coalesce(max(1, min(full, train.sparkSession.sparkContext.defaultParallelism)))


@dataclass(frozen=True)
class LtvModel:
    numeric: list[str]
    categorical: list[str]
    fills: dict
    pipeline: PipelineModel

    def prepare(self, df: DataFrame) -> DataFrame:
        return _prepare(df, self.numeric, self.categorical, self.fills)

    def predict_log(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` on the log scale; keeps ``df``'s columns with features filled in."""
        return self.pipeline.transform(self.prepare(df))

    def forest(self) -> Forest:
        """The whole model as plain trees, without the library."""
        slots: list[tuple[str, str | None]] = [(c, None) for c in self.numeric]
        if self.categorical:
            labels = self.pipeline.stages[0].labelsArray
            slots += [(c, level) for c, levels in zip(self.categorical, labels) for level in levels]
        return from_description(self.pipeline.stages[-1].toDebugString, slots, self.fills)


@dataclass(frozen=True)
class ForestModel:
    """A refitted or saved forest, to be used wherever a fitted model is."""

    trees: Forest

    def predict_log(self, df: DataFrame) -> DataFrame:
        return df.withColumn("prediction", self.trees.prediction())

    def forest(self) -> Forest:
        return self.trees


def _prepare(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], fills: dict) -> DataFrame:
    return df.withColumns({
        **{c: F.coalesce(F.col(c).cast("double"), F.lit(float(fills[c]))) for c in numeric},
        **{c: F.coalesce(F.col(c).cast("string"), F.lit(fills[c])) for c in categorical},
    })


def fit_ltv(
    train: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    target: str = TARGET,
    loss: Literal["squared", "absolute"] = "squared",
    max_iter: int = MAX_ITER,
    seed: int = SEED,
) -> LtvModel | ForestModel:
    """Impute, encode and boost trees on ``log1p(target)``.

    Categorical features are one-hot encoded whatever their number of levels, and a level unseen in
    training becomes all zeros; vectors are sparse. Levels are counted before any comes to the driver, and more than
    ``MAX_LEVELS`` are an error. ``absolute`` loss is for the conditional median: boosting itself starts from a mean tree
    and moves by the learning rate a tree at most, so its trees get new leaves (``median_forest``). ``train`` is read
    many times: pass a materialised table.
    """
    checkpoint_root(train.sparkSession)
    numeric, categorical = column_kinds(train, features)
    fills, levels = fill_values(train, numeric, categorical)
    if sum(levels.values()) > MAX_LEVELS:
        raise ValueError(f"categorical features have {sum(levels.values())} levels, more than {MAX_LEVELS}; most of them: {max(levels, key=levels.get)}")

    index = {c: f"{c}__index" for c in categorical}
    onehot = [f"{c}__levels" for c in categorical]
    stages = []
    if categorical:
        stages.append(StringIndexer(
            inputCols=categorical, outputCols=list(index.values()), handleInvalid="keep", stringOrderType="alphabetAsc"
        ))
        stages.append(OneHotEncoder(inputCols=list(index.values()), outputCols=onehot, dropLast=True))
    stages += [
        VectorAssembler(inputCols=[*numeric, *onehot], outputCol="features"),
        GBTRegressor(
            labelCol="label", lossType=loss, maxDepth=MAX_DEPTH, stepSize=LEARNING_RATE, maxIter=max_iter,
            maxBins=MAX_BINS, minInstancesPerNode=MIN_LEAF_ROWS, seed=seed,
            checkpointInterval=10, maxMemoryInMB=512,
        ),
    ]
    prepared = _prepare(in_full_tasks(train), numeric, categorical, fills).withColumn("label", F.log1p(target))
    fitted = LtvModel(numeric, categorical, fills, Pipeline(stages=stages).fit(prepared))
    return fitted if loss == "squared" else ForestModel(median_forest(fitted.forest(), train, F.log1p(target)))


def median_forest(grown: Forest, train: DataFrame, label: Column, trees: int = REFIT_TREES, step: float = REFIT_STEP) -> Forest:
    """A forest for the conditional median: its first tree is the median of all labels, the others are ``trees`` of the
    ``grown`` trees, evenly spaced, with new leaf values.

    Tree after tree, a leaf gets ``step`` times the exact median of the residuals in it, and the whole median in the last
    tree, whose leaves thus have half of their residuals on each side. Leaf numbers are computed once per row;
    medians are sorted across the cluster, and one number per leaf comes to the driver.
    """
    n = min(trees, len(grown.trees))
    chosen = [grown.trees[(k + 1) * len(grown.trees) // n - 1] for k in range(n)]
    out = replace(grown, trees=(Leaf(0, 0.0), *chosen))
    leaf_of = [out.leaf(k).alias(f"_leaf{k}") for k in range(n + 1)]
    placed = materialise(train.select(label.alias("_label"), *leaf_of), "leaves")
    rest = F.col("_label")
    for k in range(n + 1):
        rows = placed.select(F.col(f"_leaf{k}").alias("leaf"), rest.alias("residual"))
        medians = {r["leaf"]: r["median"] for r in exact_quantiles(rows, ["leaf"], "residual", {"median": 0.5}).collect()}
        rate = step if 0 < k < n else 1.0
        values = [rate * medians.get(x.number, 0.0) for x in sorted(leaves(out.trees[k]), key=lambda x: x.number)]
        out = out.with_values(k, lambda x: values[x.number])
        rest = rest - F.get(F.array(*map(F.lit, values)), F.col(f"_leaf{k}"))
    return out


def score(model: LtvModel | ForestModel, test: DataFrame, target: str = TARGET) -> DataFrame:
    """True and predicted revenue per test row, with the residual and what reports group by."""
    # Identifiers are taken aside first: filling in features would replace missing campaign ids.
    kept = [c for c in GROUPING if c in test.columns]
    ids = test.withColumns({f"_{c}": F.col(c) for c in kept})
    return with_residual(model.predict_log(ids).select(
        "user_id", *[F.col(f"_{c}").alias(c) for c in kept], F.col(target).alias("y_true"), F.expm1("prediction").alias("y_pred"),
    ))


def with_residual(scored: DataFrame) -> DataFrame:
    return scored.withColumn("residual", F.col("y_true") - F.col("y_pred"))


def model_metrics(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.avg(F.abs("residual")).alias("mae"),
        F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"),
        r2(F.log1p("y_true"), F.log1p("y_pred")).alias("r2_log"),
        F.count(F.lit(1)).alias("n"),
    )


def mean_absolute_error(scored: DataFrame) -> DataFrame:
    return scored.agg(F.avg(F.abs("residual")).alias("mae"), F.count(F.lit(1)).alias("n"))


def permutations(size: int, repeats: int = REPEATS, seed: int = SEED) -> list[tuple[int, int, int]]:
    """For each repeat (factor, its inverse, offset): slot s takes the values of slot (factor * s + offset) modulo ``size``.

    A factor without a common divisor with ``size`` makes this one-to-one, so no rows are sorted or ranked for it,
    and any engine can repeat it. Factors lie near the golden section of ``size`` and its multiples, which scatters neighbours.
    """
    out = []
    for r in range(repeats):
        factor = max(1, int(size * ((seed + r) * 0.6180339887498949 % 1)))
        while gcd(factor, size) != 1:
            factor += 1
        factor = factor % size if size > 1 else 0
        out.append((factor, pow(factor, -1, size) if size > 1 else 0, (seed + 7919 * (r + 1)) % max(size, 1)))
    return out


def permutation_importance(
    model: LtvModel | ForestModel,
    test: DataFrame,
    features: Sequence[str] = tuple(FEATURES),
    target: str = TARGET,
    repeats: int = REPEATS,
    seed: int = SEED,
    limit: int | None = None,
) -> DataFrame:
    """Loss of R² (log scale) when one raw feature at a time is shuffled between test rows.

    ``test`` needs a dense ``row_index``. Every row computes which slots take its values and meets them in one join; the
    variants (feature x repeat) are then unfolded, scored and summed up without another shuffle of rows. The join deals
    rows out by slot: a broadcast would send them all through the driver and leave the scoring to the tasks that read them.
    Every feature uses the same permutations.
    """
    bounds = test.agg(F.min("row_index").alias("first"), F.count(F.lit(1)).alias("size")).first()
    size, truth = bounds["size"], F.log1p(F.col(target))
    rows = test.select((F.col("row_index") - F.lit(bounds["first"])).alias("_slot"), truth.alias("_truth"), *features)
    base = model.predict_log(rows).agg(r2(F.col("_truth"), F.col("prediction")).alias("base"))

    # Wide enough for the product of any two slots.
    slot = F.col("_slot").cast("decimal(19,0)")
    taker = [F.struct(
        F.lit(k).alias("_repeat"),
        F.pmod((slot + F.lit(size - offset)) * F.lit(inverse).cast("decimal(18,0)"), F.lit(max(size, 1)).cast("decimal(18,0)")).cast("bigint").alias("_slot"),
    ) for k, (_, inverse, offset) in enumerate(permutations(size, repeats, seed))]
    donors = rows.select(F.explode(F.array(*taker)).alias("_to"), *[F.col(f).alias(f"_d_{f}") for f in features])
    pairs = rows.hint("merge").join(donors.select("_to.*", *[f"_d_{f}" for f in features]), "_slot")
    unfolded = pairs.withColumn("_feature", F.explode(F.array(*[F.lit(f) for f in features])))
    variants = unfolded.select(
        "_feature", "_repeat", "_truth",
        *[F.when(F.col("_feature") == f, F.col(f"_d_{f}")).otherwise(F.col(f)).alias(f) for f in features],
    )
    per_repeat = model.predict_log(variants).groupBy("_feature", "_repeat").agg(
        r2(F.col("_truth"), F.col("prediction")).alias("shuffled")
    )
    drops = per_repeat.withColumn("drop", base.scalar() - F.col("shuffled"))
    out = drops.groupBy(F.col("_feature").alias("feature")).agg(
        F.avg("drop").alias("importance_mean"), F.stddev_pop("drop").alias("importance_std")
    ).orderBy(F.col("importance_mean").desc_nulls_last(), "feature")
    return out if limit is None else out.limit(limit)


def residuals_by_channel(scored: DataFrame) -> DataFrame:
    """Systematic over- or underprediction per channel, lowest mean residual first."""
    known = scored.dropna(subset=["channel"])
    means = known.groupBy("channel").agg(F.avg("residual").alias("mean_resid"), F.count(F.lit(1)).alias("n"))
    return means.join(exact_quantiles(known, ["channel"], "residual", {"median_resid": 0.5}), "channel", "left").select(
        "channel", "mean_resid", "median_resid", "n"
    ).orderBy("mean_resid", "channel")


def channel_value(scored: DataFrame) -> DataFrame:
    """Distribution of predicted future revenue per install and channel, highest mean first."""
    known = scored.dropna(subset=["channel"])
    means = known.groupBy("channel").agg(
        F.avg("y_pred").alias("pred_mean"),
        F.avg((F.col("y_pred") <= ZERO_PREDICTION).cast("double")).alias("share_zero_pred"),
        F.count(F.lit(1)).alias("n"),
    )
    spread = exact_quantiles(known, ["channel"], "y_pred", {"pred_median": 0.5, "pred_p75": 0.75, "pred_p90": 0.9})
    return means.join(spread, "channel", "left").select(
        "channel", "pred_mean", "pred_median", "pred_p75", "pred_p90", "share_zero_pred", "n"
    ).orderBy(F.col("pred_mean").desc(), "channel")


def ltv_over_cac(value: DataFrame, channels: DataFrame) -> DataFrame:
    """Predicted value per install over acquisition cost, best first.

    A channel that costs nothing has no finite ratio: it is flagged and comes first.
    """
    return (
        value.join(channels.select("channel", "CAC"), "channel", "left")
        .filter(F.col("CAC").isNotNull())
        .withColumn("LTV_over_CAC", plain_ratio("pred_mean", "CAC"))
        .withColumn("is_free_channel", F.col("CAC") == 0)
        .orderBy(F.col("is_free_channel").desc(), F.col("LTV_over_CAC").desc_nulls_last(), "channel")
    )
