"""Spark ML fits behind one small interface, and the parameter search."""

from __future__ import annotations

import math
import random
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import partial

from pyspark.ml.classification import (
    GBTClassifier,
    LogisticRegression,
    MultilayerPerceptronClassifier,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.folds import col
from riftline.operators.boosting import BoostedTrees, fit_hist_boosting
from riftline.operators.evaluate import average_precision
from riftline.operators.forest import Forest, fit_hist_forest
from riftline.operators.split import stratified_folds
from riftline.operators.vectors import features_array

VECTOR, TARGET = "_features", "_target"


def assemble(df: DataFrame, cols: Sequence[str], out: str = VECTOR) -> DataFrame:
    return df.withColumn(out, array_to_vector(features_array(cols)))


def training_rows(df: DataFrame, cols: Sequence[str], label: str, extra: Sequence[str] = ()) -> DataFrame:
    """Only what a fit reads: the vector, the label as a double and the named extra columns."""
    return assemble(df, cols).select(VECTOR, col(label).cast("double").alias(TARGET), *[col(c) for c in extra])


def predict_threshold(df: DataFrame, *, score: str = "score", cut: float = 0.5) -> DataFrame:
    """Class 1 where the score is above the cut."""
    return df.withColumn("prediction", (col(score) > cut).cast("int"))


@dataclass
class Fitted:
    """A fitted classifier with the columns it reads."""

    model: object
    cols: Sequence[str]

    def score(self, df: DataFrame, *, cut: float = 0.5, vector: Column | None = None) -> DataFrame:
        """Adds ``score``, the probability of class 1, and ``prediction``."""
        ready = assemble(df, self.cols) if vector is None else df.withColumn(VECTOR, array_to_vector(vector))
        done = self.model.transform(ready)
        scored = done.withColumn("score", vector_to_array("probability")[1])
        return predict_threshold(scored.select(*[col(c) for c in df.columns], "score"), cut=cut)


def _fit(estimator, train: DataFrame, cols: Sequence[str], label: str, weight: str | None) -> Fitted:
    estimator.setFeaturesCol(VECTOR).setLabelCol(TARGET)
    if weight:
        estimator.setWeightCol(weight)
    rows = training_rows(train, cols, label, [weight] if weight else []).persist()
    try:
        return Fitted(estimator.fit(rows), list(cols))
    finally:
        rows.unpersist()


def fit_logistic(train: DataFrame, *, cols: Sequence[str], label: str, weight: str | None = None, **params) -> Fitted:
    return _fit(LogisticRegression(**params), train, cols, label, weight)


def fit_random_forest(
    train: DataFrame, *, cols: Sequence[str], label: str, weight: str | None = None, **params
) -> Fitted:
    return _fit(RandomForestClassifier(**{"seed": 42, **params}), train, cols, label, weight)


# Names of boosted-tree settings and the Spark settings that play their part.
BOOSTED = {
    "n_estimators": "maxIter",
    "max_depth": "maxDepth",
    "learning_rate": "stepSize",
    "subsample": "subsamplingRate",
    "colsample_bytree": "featureSubsetStrategy",
    "gamma": "minInfoGain",
    "min_child_weight": "minInstancesPerNode",
}
BOOSTED_IGNORED = ("reg_alpha", "reg_lambda")


def boosted_settings(params: Mapping) -> dict:
    """Spark settings for the given ones; column sampling is per node, and penalties have no match."""
    out = {}
    for name, value in params.items():
        if name in BOOSTED_IGNORED:
            continue
        if name == "colsample_bytree":
            value = str(float(value))
        elif name == "min_child_weight":
            value = max(1, round(value))
        out[BOOSTED.get(name, name)] = value
    return out


# Spark names that older callers pass, and the booster's settings they stand for.
SPARK_NAMES = {"maxIter": "n_estimators", "maxDepth": "max_depth", "stepSize": "learning_rate"}


def fit_boosted_trees(
    train: DataFrame, *, cols: Sequence[str], label: str, weight: str | None = None,
    pos_weight: float | None = None, **params,
) -> BoostedTrees:
    """Second-order histogram boosting (``riftline.operators.boosting``); ``pos_weight`` weighs class 1 against class 0.

    All drawn settings take effect, the penalties ``reg_alpha`` and ``reg_lambda`` included."""
    settings = {SPARK_NAMES.get(name, name): value for name, value in params.items()}
    return fit_hist_boosting(train, cols=cols, label=label, weight=weight, pos_weight=pos_weight, **settings)


def fit_mlp(
    train: DataFrame, *, cols: Sequence[str], label: str, hidden: Sequence[int] = (100, 50), classes: int = 2,
    **params,
) -> Fitted:
    layers = [len(cols), *hidden, classes]
    return _fit(MultilayerPerceptronClassifier(**{"layers": layers, "seed": 42, **params}), train, cols, label, None)


# Spark names of forest settings, and the histogram forest's settings they stand for.
FOREST_NAMES = {"maxDepth": "max_depth", "minInstancesPerNode": "min_instances", "featureSubsetStrategy": "features"}


def fit_balanced_forest(
    train: DataFrame, *, cols: Sequence[str], label: str, key: str, trees: int = 100, seed: int = 42, **params,
) -> Forest:
    """Trees on class-balanced bootstraps, each split over a sample of the features, all grown together level by level
    (``riftline.operators.forest``): a row enters a tree with a Poisson weight whose rate makes every class as large as
    the rarest, and the jobs depend on the depth, not on the number of trees."""
    settings = {FOREST_NAMES.get(name, name): value for name, value in params.items()}
    return fit_hist_forest(train, cols=cols, label=label, key=key, trees=trees, seed=seed, **settings)


# ---------------------------------------------------------------- parameter search

class AveragePrecision(Evaluator):
    """Exact average precision for the cross-validator."""

    def _evaluate(self, dataset: DataFrame) -> float:
        scored = dataset.select(F.col(TARGET).alias("label"), vector_to_array("probability")[1].alias("score"))
        return float(average_precision(scored).first()[0])

    def isLargerBetter(self) -> bool:
        return True


def _whole(low: int, high: int) -> Callable:
    return lambda rng: rng.randint(low, high)


def _real(low: float, high: float) -> Callable:
    return lambda rng: rng.uniform(low, high)


def _log(low: float, high: float) -> Callable:
    return lambda rng: math.exp(rng.uniform(math.log(low), math.log(high)))


def _one_of(*values) -> Callable:
    return lambda rng: rng.choice(values)


# The search ranges.
SEARCH = {
    "boosted_trees": {
        "n_estimators": _whole(100, 300),
        "min_child_weight": _log(1.0, 7.0),
        "max_depth": _whole(3, 9),
        "learning_rate": _log(0.01, 0.3),
        "subsample": _real(0.5, 1.0),
        "colsample_bytree": _real(0.5, 1.0),
        "gamma": _log(1e-8, 1.0),
        "reg_alpha": _log(1e-8, 1.0),
        "reg_lambda": _log(1e-8, 1.0),
    },
    "random_forest": {
        "numTrees": _whole(100, 300),
        "maxDepth": _whole(3, 20),
        "minInstancesPerNode": _whole(1, 10),
        "featureSubsetStrategy": _one_of("sqrt", "log2", "all"),
    },
    "online_logistic": {"rate": _log(0.001, 1.0), "l2": _log(1e-8, 1.0)},
}


def draw_params(model: str, trials: int, seed: int = 42, space: Mapping | None = None) -> list[dict]:
    rng = random.Random(seed)
    ranges = space or SEARCH[model]
    return [{name: pick(rng) for name, pick in ranges.items()} for _ in range(trials)]


def _param_maps(estimator, draws: Sequence[Mapping]) -> list[dict]:
    return [{estimator.getParam(n): v for n, v in draw.items()} for draw in draws]


@dataclass
class Tuned:
    params: dict
    score: float
    trials: list[tuple[dict, float]]
    fitted: Fitted


def tune_cv(
    train: DataFrame, *, cols: Sequence[str], label: str, key: str, model: str = "boosted_trees", folds: int = 5,
    trials: int = 30, seed: int = 42, parallelism: int = 2, weight: str | None = None,
    space: Mapping | None = None,
) -> Tuned:
    """Seeded random search for the best mean average precision over stratified folds.

    A balanced forest, whose trees are separate fits, is tuned fold by fold with the forest ranges.
    """
    dealt = stratified_folds(train, label=label, key=key, k=folds, seed=seed)
    if model == "balanced_forest":
        return _tune_balanced(dealt, cols, label, key, folds, trials, seed, space)
    draws = draw_params(model, trials, seed, space)
    if model == "boosted_trees":
        estimator, settings = GBTClassifier(seed=seed), [boosted_settings(d) for d in draws]
    elif model == "random_forest":
        estimator, settings = RandomForestClassifier(seed=seed), draws
    elif model == "logistic":
        estimator, settings = LogisticRegression(), draws
    else:
        raise ValueError(f"unknown model '{model}'")
    estimator.setFeaturesCol(VECTOR).setLabelCol(TARGET)
    if weight:
        estimator.setWeightCol(weight)
    rows = training_rows(dealt, cols, label, ["fold", *([weight] if weight else [])]).persist()
    try:
        search = CrossValidator(
            estimator=estimator, estimatorParamMaps=_param_maps(estimator, settings),
            evaluator=AveragePrecision(), numFolds=folds, foldCol="fold", parallelism=parallelism, seed=seed,
        ).fit(rows)
    finally:
        rows.unpersist()
    scores = [float(s) for s in search.avgMetrics]
    best = max(range(len(draws)), key=lambda n: scores[n])
    return Tuned(draws[best], scores[best], list(zip(draws, scores)), Fitted(search.bestModel, list(cols)))


def _tune_balanced(dealt, cols, label, key, folds, trials, seed, space) -> Tuned:
    draws = draw_params("random_forest", trials, seed, space)
    results = []
    fit = partial(fit_balanced_forest, cols=cols, label=label, key=key, seed=seed)
    for draw in draws:
        settings = {k: v for k, v in draw.items() if k != "numTrees"}
        trees = draw.get("numTrees", 100)
        total = 0.0
        for fold in range(folds):
            model = fit(dealt.filter(F.col("fold") != fold), trees=trees, **settings)
            scored = model.score(dealt.filter(F.col("fold") == fold))
            total += average_precision(scored, label=label).first()[0]
        results.append((draw, total / folds))
    params, score = max(results, key=lambda r: r[1])
    settings = {k: v for k, v in params.items() if k != "numTrees"}
    return Tuned(params, score, results, fit(dealt, trees=params.get("numTrees", 100), **settings))


FITS: dict[str, Callable[..., Fitted | BoostedTrees]] = {
    "logistic": fit_logistic,
    "random_forest": fit_random_forest,
    "boosted_trees": fit_boosted_trees,
    "mlp": fit_mlp,
}
