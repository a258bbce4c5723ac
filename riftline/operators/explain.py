"""Explanations of a fitted model, for many rows at a time."""

from __future__ import annotations

import random
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.folds import col, normal
from riftline.operators.boosting import BoostedTrees, shapley_table
from riftline.operators.models import Fitted
from riftline.operators.ordering import hash_rank
from riftline.operators.vectors import features_array, matrix_of


def _names(cols: Sequence[str]) -> Column:
    return F.array(*[F.lit(c) for c in cols])


def _replaced(vector: Column, at: Column, value: Column) -> Column:
    return F.transform(vector, lambda x, n: F.when(n == at, value).otherwise(x))


def permutation_importance(
    model: Fitted, df: DataFrame, *, cols: Sequence[str], label: str, key: str, repeats: int = 10, seed: int = 42
) -> DataFrame:
    """Loss of accuracy when one feature is shuffled: ``feature, importance, std``.

    The rows are put in hash order once; a repeat takes its values from the row a fixed random step
    further on, so shuffling is one join on the rank and all repeats and features share one pass.
    """
    rows = df.select(
        col(key), features_array(cols).alias("_x"), col(label).cast("int").alias("_y")
    ).withColumn("_draw", F.xxhash64(col(key), F.lit(seed)))
    ranked = hash_rank(rows, "_draw", key, name="_r").select("_r", "_x", "_y").persist()
    n = ranked.count()
    rng = random.Random(seed)
    steps = [rng.randrange(1, n) if n > 1 else 0 for _ in range(repeats)]
    base = model.score(ranked, vector=F.col("_x")).agg(F.avg((F.col("prediction") == F.col("_y")).cast("double"))).first()[0]
    asked = ranked.select(
        "_x", "_y", F.posexplode(F.array(*[F.lit(s) for s in steps])).alias("repeat", "_step"), "_r"
    ).withColumn("_from", F.pmod(F.col("_r") + F.col("_step"), F.lit(n)))
    donors = ranked.select(F.col("_r").alias("_from"), F.col("_x").alias("_donor"))
    shuffled = asked.join(donors, "_from").select(
        "repeat", "_y", "_x", F.posexplode("_donor").alias("_f", "_value")
    ).withColumn("_x", _replaced(F.col("_x"), F.col("_f"), F.col("_value")))
    scored = model.score(shuffled, vector=F.col("_x"))
    per_repeat = scored.groupBy("_f", "repeat").agg(
        F.avg((F.col("prediction") == F.col("_y")).cast("double")).alias("_score")
    )
    return per_repeat.groupBy("_f").agg(
        (F.lit(base) - F.avg("_score")).alias("importance"), F.stddev_pop("_score").alias("std")
    ).select(F.element_at(_names(cols), F.col("_f") + 1).alias("feature"), "importance", "std")


def partial_dependence(
    model: Fitted, df: DataFrame, *, cols: Sequence[str], grid: int = 20, lower: float = 0.05, upper: float = 0.95
) -> DataFrame:
    """Mean probability over a value grid per varying feature: ``feature, value, mean_score``."""
    ends = df.agg(
        *[F.percentile_approx(col(c).cast("double"), [lower, upper], 10_000).alias(f"p{n}") for n, c in enumerate(cols)],
        *[(F.min(col(c)) < F.max(col(c))).alias(f"v{n}") for n, c in enumerate(cols)],
    ).first()
    points = []
    for n in range(len(cols)):
        if ends[f"v{n}"]:
            low, high = ends[f"p{n}"]
            points += [(n, float(v)) for v in np.unique(np.linspace(low, high, grid))]
    if not points:
        raise ValueError("every feature is constant")
    cells = F.array(*[F.struct(F.lit(f).alias("f"), F.lit(v).alias("v")) for f, v in points])
    moved = df.select(features_array(cols).alias("_x"), F.explode(cells).alias("_cell")).select(
        _replaced(F.col("_x"), F.col("_cell.f"), F.col("_cell.v")).alias("_x"),
        F.col("_cell.f").alias("_f"), F.col("_cell.v").alias("value"),
    )
    scored = model.score(moved, vector=F.col("_x"))
    return scored.groupBy("_f", "value").agg(F.avg("score").alias("mean_score")).select(
        F.element_at(_names(cols), F.col("_f") + 1).alias("feature"), "value", "mean_score"
    )


def local_surrogate(
    model: Fitted, rows: DataFrame, *, cols: Sequence[str], key: str, train: DataFrame, samples: int = 500,
    top: int = 10, ridge: float = 1.0, seed: int = 42,
) -> DataFrame:
    """A weighted linear fit around each row: ``key, feature, weight, rank`` for the strongest features.

    Each row is perturbed by the spread of the training data and scored in one distributed pass. The samples go no
    further than their batch: what is shuffled is one small table of weighted sums per row, from which many rows are
    solved at a time.
    """
    p = len(cols)
    row = train.agg(*[F.stddev_pop(col(c).cast("double")).alias(f"s{n}") for n, c in enumerate(cols)]).first()
    spread = [float(v or 0.0) for v in row]
    noise = F.array(*[
        F.when(F.col("_s") == 0, F.lit(0.0)).otherwise(normal(col(key), F.col("_s"), F.lit(n), F.lit(seed))) for n in range(p)
    ])
    around = (
        rows.select(col(key), features_array(cols).alias("_x0"), F.explode(F.sequence(F.lit(0), F.lit(samples - 1))).alias("_s"))
        .withColumn("_z", noise)
        .withColumn("_x", F.array(*[F.col("_x0")[n] + F.col("_z")[n] * F.lit(s) for n, s in enumerate(spread)]))
    )
    scored = model.score(around, vector=F.col("_x")).select(col(key).alias("_key"), "_z", "score")
    width = (0.75 * np.sqrt(p)) ** 2
    names = list(cols)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Per key of a batch the weighted products of the samples with one another and with the score."""
        for batch in batches:
            if not batch.num_rows:
                continue
            known = pc.dictionary_encode(batch.column(0), null_encoding="encode")
            codes = known.indices.to_numpy()
            order = np.argsort(codes, kind="stable")
            z, score = matrix_of(batch.column(1))[order], batch.column(2).to_numpy(zero_copy_only=False)[order]
            weighted = np.c_[z, np.ones(len(z))]
            right = np.c_[weighted, score]
            weighted *= np.exp(-(z**2).sum(axis=1) / width)[:, None]
            ends = np.cumsum(np.bincount(codes, minlength=len(known.dictionary)))
            found = np.stack([weighted[a:b].T @ right[a:b] for a, b in zip(np.r_[0, ends[:-1]], ends)])
            offsets = pa.array(np.arange(len(ends) + 1) * (p + 1) * (p + 2), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [known.dictionary, pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))], names=["_key", "_sums"]
            )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                total = np.stack([np.sum(parts, axis=0) for parts in part.column(1).to_pylist()]).reshape(-1, p + 1, p + 2)
                normal_matrix = total[:, :, : p + 1] + ridge * np.diag(np.r_[np.ones(p), 0.0])
                beta = np.linalg.solve(normal_matrix, total[:, :, p + 1 :])[:, :p, 0]
                order = np.argsort(-np.abs(beta), axis=1, kind="stable")[:, :top]
                n, kept = order.shape
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(np.repeat(np.arange(n), kept))), pa.array([names[f] for f in order.ravel()], pa.string()),
                     pa.array(np.take_along_axis(beta, order, axis=1).ravel()), pa.array(np.tile(np.arange(1, kept + 1), n), pa.int32())],
                    names=[key, "feature", "weight", "rank"],
                )

    kind = rows.schema[key].dataType.simpleString()
    # The parts of a key are put in order, so that their sum does not depend on the shuffle.
    together = scored.mapInArrow(sums, f"_key {kind}, _sums array<double>").groupBy("_key").agg(
        F.array_sort(F.collect_list("_sums")).alias("_sums")
    )
    return together.mapInArrow(fit, f"`{key}` {kind}, feature string, weight double, rank int")


def shapley_values(
    model: Fitted, rows: DataFrame, *, cols: Sequence[str], key: str, background: Sequence[float],
    permutations: int = 10, seed: int = 42,
) -> DataFrame:
    """Sampled Shapley values: ``key, feature, value``.

    Along a permutation the features of the row replace those of the background one by one. Each
    prediction is credited to the feature that came last and charged to the one that comes next, so
    the sum per feature needs no ordering of the rows.
    """
    p = len(cols)
    rng = random.Random(seed)
    drawn = [rng.sample(range(p), p) for _ in range(permutations)]
    # A permutation travels as its order and the place of each feature in it; step t has the first t features replaced.
    orders = F.array(*[
        F.struct(
            F.array(*map(F.lit, order)).alias("order"), F.array(*[F.lit(order.index(n)) for n in range(p)]).alias("place")
        ) for order in drawn
    ])
    base = F.array(*[F.lit(float(v)) for v in background])
    stepped = rows.select(col(key), features_array(cols).alias("_x"), F.explode(orders).alias("_o")).select(
        "*", F.explode(F.sequence(F.lit(0), F.lit(p))).alias("_t")
    )
    mixed = stepped.select(
        col(key),
        F.struct(
            F.coalesce(F.get("_o.order", F.col("_t") - 1), F.lit(-1)).alias("gain"),
            F.coalesce(F.get("_o.order", F.col("_t")), F.lit(-1)).alias("cost"),
        ).alias("_c"),
        F.transform("_x", lambda v, n: F.when(F.get("_o.place", n) < F.col("_t"), v).otherwise(F.get(base, n))).alias("_x"),
    )
    scored = model.score(mixed, vector=F.col("_x"))
    credit = F.array(
        F.struct(F.col("_c.gain").alias("f"), F.col("score").alias("v")),
        F.struct(F.col("_c.cost").alias("f"), (-F.col("score")).alias("v")),
    )
    return (
        scored.select(col(key), F.inline(credit)).filter("f >= 0")
        .groupBy(key, "f").agg((F.sum("v") / permutations).alias("value"))
        .select(col(key), F.element_at(_names(cols), F.col("f") + 1).alias("feature"), "value")
    )


def tree_shapley_values(model: BoostedTrees, rows: DataFrame, *, key: str) -> DataFrame:
    """Exact Shapley values of boosted trees (path-dependent, per tree, in polynomial time): ``key, feature, value``
    in margin units; with the expected margin they add up to each row's margin."""
    return shapley_table(model, rows, key=key).filter(F.col("feature") != "_base")


def mean_abs_attribution(values: DataFrame, *, feature: str = "feature", value: str = "value") -> DataFrame:
    return values.groupBy(feature).agg(F.avg(F.abs(col(value))).alias("mean_abs"))
