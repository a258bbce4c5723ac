"""Feature scores and selection. Only tables whose size follows the column count reach the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.folds import col
from riftline.operators.models import (
    assemble,
    fit_boosted_trees,
    fit_logistic,
    fit_random_forest,
)
from riftline.operators.vectors import features_array, partial_sums
from riftline.schemas import quoted

FLAT = 1e-12


def _means(df: DataFrame, cols: Sequence[str]) -> np.ndarray:
    """Column means, used to centre the sums so that large values do not cancel."""
    row = df.selectExpr(*[f"avg(cast({quoted(c)} as double)) AS m{n}" for n, c in enumerate(cols)]).first()
    return np.array([v if v is not None else 0.0 for v in row], dtype="float64")


def _table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return df.sparkSession.createDataFrame(rows, schema)


def _named(df: DataFrame, cols: Sequence[str], index: str, name: str) -> DataFrame:
    names = F.array(*[F.lit(c) for c in cols])
    return df.withColumn(name, F.element_at(names, (F.col(index) + 1).cast("int")))


def masked_gram(df: DataFrame, left: Sequence[str], right: Sequence[str] | None = None) -> DataFrame:
    """Pairwise sums over the rows where both columns are present, in one pass.

    Returns ``i, j, n, sx, sy, sxx, syy, sxy`` of the centred columns. Each partition reduces its
    rows to one matrix per sum before anything is shuffled.
    """
    other = list(left if right is None else right)
    both = [*left, *other]
    centre = _means(df, both)
    p, q = len(left), len(other)

    def fold(matrix: np.ndarray, batch: pa.RecordBatch) -> dict:
        present = ~np.isnan(matrix)
        values = np.where(present, matrix - centre, 0.0)
        x, y = values[:, :p], values[:, p:]
        mx, my = present[:, :p].astype("float64"), present[:, p:].astype("float64")
        return {
            "n": mx.T @ my, "sx": x.T @ my, "sy": mx.T @ y,
            "sxx": (x * x).T @ my, "syy": mx.T @ (y * y), "sxy": x.T @ y,
        }

    sums = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    schema = "at int, " + ", ".join(f"{c} double" for c in sums)
    total = partial_sums(df.select(features_array(both).alias("_x")), fold, schema).groupBy("at").agg(
        *[F.sum(c).alias(c) for c in sums]
    )
    return total.select(
        F.call_function("div", "at", F.lit(q)).cast("int").alias("i"), (F.col("at") % q).alias("j"), *sums
    )


def _pearson() -> Column:
    vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    vy = F.col("n") * F.col("syy") - F.col("sy") * F.col("sy")
    flat = (vx <= FLAT * F.col("n") * F.col("sxx")) | (vy <= FLAT * F.col("n") * F.col("syy"))
    top = F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")
    return F.when((F.col("n") >= 2) & ~flat, top / F.sqrt(vx) / F.sqrt(vy))


def correlation_matrix(df: DataFrame, *, cols: Sequence[str]) -> DataFrame:
    """Pairwise-complete Pearson for i < j as ``i, j, a, b, r``; null for a constant column."""
    pairs = masked_gram(df, cols).filter("i < j").select("i", "j", _pearson().alias("r"))
    return _named(_named(pairs, cols, "i", "a"), cols, "j", "b")


def label_correlation(df: DataFrame, *, cols: Sequence[str], label: str, top: int | None = 10) -> DataFrame:
    """Correlation of each feature with the label, strongest first, constants last."""
    rows = masked_gram(df.withColumn(label, col(label).cast("double")), cols, [label])
    scored = _named(rows.select("i", _pearson().alias("score")), cols, "i", "feature")
    return _top(scored, F.abs("score"), top)


def _top(scored: DataFrame, by: Column, top: int | None) -> DataFrame:
    """``feature, score, rank`` for one row per column; ties by column order."""
    ordered = scored.orderBy(by.desc_nulls_last(), "i")
    ordered = ordered.limit(top) if top else ordered
    rows = [(r["feature"], r["score"], n) for n, r in enumerate(ordered.select("feature", "score").collect(), 1)]
    return _table(scored, rows, "feature string, score double, rank int")


def class_moments(df: DataFrame, *, cols: Sequence[str], label: str, centre: bool = True) -> DataFrame:
    """``feature index i, class c, n, s, q``: count, sum and square sum of each feature per class."""
    classes = sorted(r[0] for r in df.select(col(label)).distinct().collect() if r[0] is not None)
    code = F.array_position(F.array(*[F.lit(c) for c in classes]), col(label)) - 1
    shift = _means(df, cols) if centre else np.zeros(len(cols))

    def fold(matrix: np.ndarray, batch: pa.RecordBatch) -> dict:
        kind = batch.column(1).to_numpy(zero_copy_only=False)
        member = (kind[:, None] == np.arange(len(classes))[None, :]).astype("float64")
        present = ~np.isnan(matrix)
        values = np.where(present, matrix - shift, 0.0)
        return {"n": member.T @ present, "s": member.T @ values, "q": member.T @ (values * values)}

    narrow = df.filter(col(label).isNotNull()).select(features_array(cols).alias("_x"), code.cast("long").alias("_c"))
    total = partial_sums(narrow, fold, "at int, n double, s double, q double").groupBy("at").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")
    )
    width = len(cols)
    return total.select(
        (F.col("at") % width).alias("i"), F.call_function("div", "at", F.lit(width)).cast("int").alias("c"),
        "n", "s", "q",
    )


def anova_f(df: DataFrame, *, cols: Sequence[str], label: str, top: int | None = 10) -> DataFrame:
    """Between over within variance; null where the classes have no spread inside."""
    return _top(_anova(df, cols, label), F.col("score"), top)


def _anova(df: DataFrame, cols: Sequence[str], label: str) -> DataFrame:
    inner = F.sum(F.col("s") * F.col("s") / F.nullif("n", F.lit(0.0)))
    sums = class_moments(df, cols=cols, label=label).groupBy("i").agg(
        F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"), inner.alias("e"),
        F.count_if(F.col("n") > 0).alias("k"),
    )
    within = F.col("q") - F.col("e")
    between = F.col("e") - F.col("s") * F.col("s") / F.col("n")
    value = F.try_divide(between / (F.col("k") - 1), within / (F.col("n") - F.col("k")))
    flat = (within <= FLAT * F.col("q")) | (F.col("k") < 2) | (F.col("n") <= F.col("k"))
    return _named(sums.select("i", F.when(~flat, value).alias("score")), cols, "i", "feature")


def chi2_score(df: DataFrame, *, cols: Sequence[str], label: str, top: int | None = 10) -> DataFrame:
    """Class sums against the sums expected from the class shares; negative input is refused."""
    least = df.agg(*[F.min(col(c)).alias(f"m{n}") for n, c in enumerate(cols)]).first()
    if any(v is not None and v < 0 for v in least):
        raise ValueError("chi2 needs values that are not negative")
    shares = {r[0]: r[1] for r in df.groupBy(col(label)).count().collect() if r[0] is not None}
    n = sum(shares.values())
    share = F.element_at(F.array(*[F.lit(shares[c] / n) for c in sorted(shares)]), F.col("c") + 1)
    moments = class_moments(df, cols=cols, label=label, centre=False)
    total = moments.groupBy("i").agg(F.sum("s").alias("t"))
    expected = share * F.col("t")
    gap = F.col("s") - expected
    scored = moments.join(total, "i").groupBy("i").agg(F.sum(F.try_divide(gap * gap, expected)).alias("score"))
    return _top(_named(scored, cols, "i", "feature"), F.col("score"), top)


def drop_constant(df: DataFrame, *, cols: Sequence[str]) -> list[str]:
    """Columns that vary, by one aggregate of minimum and maximum."""
    row = df.agg(*[(F.min(col(c)) < F.max(col(c))).alias(f"v{n}") for n, c in enumerate(cols)]).first()
    kept = [c for c, varies in zip(cols, row) if varies]
    if not kept:
        raise ValueError("every column is constant")
    return kept


def select_cbfs(df: DataFrame, *, cols: Sequence[str], threshold: float = 0.9) -> DataFrame:
    """Keep a column unless some earlier one, kept or not, correlates with it above the threshold."""
    strong = correlation_matrix(df, cols=cols).filter(F.abs("r") > threshold).select(F.col("b").alias("feature"))
    names = _table(df, [(c, n) for n, c in enumerate(cols, 1)], "feature string, position int")
    return names.join(strong.distinct(), "feature", "left_anti")


def select_mrmr(
    df: DataFrame, *, cols: Sequence[str], label: str, k: int = 50, floor: float = 1e-3
) -> DataFrame:
    """Greedy choice by relevance (F) over mean absolute correlation with the chosen columns."""
    d = len(cols)
    relevance = np.full(d, np.nan)
    for r in _anova(df, cols, label).collect():
        relevance[r.i] = np.nan if r.score is None else r.score
    corr = np.zeros((d, d))
    for r in correlation_matrix(df, cols=cols).collect():
        corr[r.i, r.j] = corr[r.j, r.i] = abs(r.r) if r.r is not None else 0.0
    left = [n for n in range(d) if not np.isnan(relevance[n])]
    rows, chosen = [], []
    while left and len(chosen) < k:
        redundancy = np.maximum(corr[:, chosen].mean(axis=1), floor) if chosen else np.ones(d)
        score = relevance / redundancy
        best = max(left, key=lambda n: (score[n], -n))
        left.remove(best)
        chosen.append(best)
        rows.append((cols[best], float(score[best]), len(chosen)))
    return _table(df, rows, "feature string, score double, rank int")


def _ranked(df: DataFrame, cols: Sequence[str], scores: Sequence[float], keep=None) -> DataFrame:
    order = sorted(range(len(cols)), key=lambda n: (-scores[n], n))
    order = [n for n in order if keep is None or keep[n]]
    rows = [(cols[n], float(scores[n]), at) for at, n in enumerate(order, 1)]
    return _table(df, rows, "feature string, score double, rank int")


def tree_importance(
    df: DataFrame, *, cols: Sequence[str], label: str, top: int = 25, trees: int = 100, seed: int = 42
) -> DataFrame:
    model = fit_random_forest(df, cols=cols, label=label, numTrees=trees, seed=seed).model
    return _ranked(df, cols, model.featureImportances.toArray()).limit(top)


def select_model_threshold(
    df: DataFrame, *, cols: Sequence[str], label: str, threshold: float | str = "median", seed: int = 42,
    **params,
) -> DataFrame:
    """Columns whose boosted-tree importance is at least the threshold."""
    scores = np.asarray(fit_boosted_trees(df, cols=cols, label=label, seed=seed, **params).featureImportances)
    level = {"median": np.median, "mean": np.mean}.get(threshold, lambda s: float(threshold))(scores)
    return _ranked(df, cols, scores, keep=scores >= level)


def select_rfe(df: DataFrame, *, cols: Sequence[str], label: str, k: int = 10, **params) -> DataFrame:
    """Drop the weakest logistic coefficient, one at a time."""
    kept = list(cols)
    cached = df.select(*[col(c) for c in cols], col(label)).persist()
    try:
        while True:
            weights = np.abs(fit_logistic(cached, cols=kept, label=label, standardization=False, **params).model.coefficients.toArray())
            if len(kept) <= k:
                return _ranked(df, kept, weights)
            kept.pop(int(weights.argmin()))
    finally:
        cached.unpersist()


def select_l1(
    df: DataFrame, *, cols: Sequence[str], label: str, strength: float = 0.01, least: float = 1e-5
) -> DataFrame:
    model = fit_logistic(df, cols=cols, label=label, elasticNetParam=1.0, regParam=strength).model
    weights = np.abs(model.coefficients.toArray())
    return _ranked(df, cols, weights, keep=weights > least)


def pca_project(
    train: DataFrame, *tests: DataFrame, cols: Sequence[str], k: int = 50, out: str = "pc"
) -> list[DataFrame]:
    """Components fitted on the centred training rows; each sign makes its largest loading positive."""
    from pyspark.ml.feature import PCA

    centre = _means(train, cols)
    k = min(k, len(cols))
    model = PCA(k=k, inputCol="_v", outputCol="_pc").fit(assemble(train, cols, out="_v"))
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), np.arange(k)])
    # The model projects rows as they are; taking off the projected mean centres them.
    fixed = F.array(*[
        F.struct(F.lit(float(s)).alias("sign"), F.lit(float(m)).alias("mean"))
        for s, m in zip(signs, centre @ loadings)
    ])
    parts = F.zip_with(vector_to_array("_pc"), fixed, lambda v, f: f["sign"] * (v - f["mean"]))
    return [
        model.transform(assemble(df, cols, out="_v")).withColumn(out, parts).drop("_v", "_pc")
        for df in (train, *tests)
    ]


def select_features(
    df: DataFrame, *, cols: Sequence[str], label: str, method: str = "model", threshold: float | str = "median",
    correlation_threshold: float = 0.9, num_features: int = 50, **params,
) -> list[str]:
    """Names of the selected columns by ``model``, ``cbfs`` or ``mrmr``."""
    method = method.lower()
    if method == "model":
        chosen = {r.feature for r in select_model_threshold(df, cols=cols, label=label, threshold=threshold, **params).collect()}
        return [c for c in cols if c in chosen]
    if method == "cbfs":
        chosen = {r.feature for r in select_cbfs(df, cols=cols, threshold=correlation_threshold).collect()}
        return [c for c in cols if c in chosen]
    if method == "mrmr":
        return [r.feature for r in select_mrmr(df, cols=cols, label=label, k=num_features).orderBy("rank").collect()]
    raise ValueError("method must be 'model', 'cbfs' or 'mrmr'")
