"""Train/test splits, folds, windows and class weights."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.folds import col
from riftline.operators.ordering import (
    as_long,
    hash_rank,
    split_at_rank,
    with_global_index,
    with_group_index,
)

WINDOW_BLOCK = 100_000


def split_random(
    df: DataFrame, *, key: str, test: float = 0.2, seed: int = 42, draw: str | None = None
) -> DataFrame:
    """Adds ``is_test`` for the share of rows lowest in hash order; the exact size is kept.

    The cut is found by counting hash ranges, so the split itself moves no row.
    """
    drawn = df.withColumn("_draw", col(draw) if draw else F.xxhash64(col(key), F.lit(seed)))
    size = math.ceil(test * df.count())
    tie = [key] if as_long(key, df.schema[key].dataType) is not None else []
    train = split_at_rank(drawn, ["_draw", *tie], size)
    return drawn.withColumn("is_test", ~train).drop("_draw")


def split_by_date(df: DataFrame, *, ts: str, tie: str, test: float = 0.2) -> DataFrame:
    """Adds ``is_test`` for the newest rows: the first ``int((1 - test) * n)`` are for training."""
    cut = int((1 - test) * df.count())
    if as_long(tie, df.schema[tie].dataType) is not None:
        return df.withColumn("is_test", split_at_rank(df, [ts, tie], cut))
    indexed = with_global_index(df, [F.asc_nulls_last(ts), tie], name="_i")
    return indexed.withColumn("is_test", F.col("_i") >= cut).drop("_i")


def sliding_windows(
    df: DataFrame, *, order: Sequence[str], cols: Sequence[str], label: str, size: int,
    by: str | None = None, block: int = WINDOW_BLOCK,
) -> DataFrame:
    """Every run of ``size`` consecutive rows as a sequence with the label of its last row.

    Rows are cut into blocks by index, and the rows that end a block are repeated at the start of the
    next one, so a long group is built by many tasks.
    """
    block = max(block, size)
    groups = [by] if by else []
    indexed = with_group_index(df, groups, order) if by else with_global_index(df, order)
    narrow = indexed.select(
        *groups, "i", *[col(c).alias(f"_o{n}") for n, c in enumerate(order)],
        F.struct("i", F.array(*[col(c).cast("double") for c in cols]).alias("x")).alias("_row"),
        col(label).alias("label"),
    )
    home = F.floor(F.col("i") / block)
    reach = F.floor((F.col("i") + (size - 1)) / block)
    placed = narrow.withColumn("_home", home).withColumn("_block", F.explode(F.sequence(home, reach)))
    inside = Window.partitionBy(*groups, "_block").orderBy("i").rowsBetween(-(size - 1), 0)
    return (
        placed.withColumn("_run", F.collect_list("_row").over(inside))
        .filter((F.col("_home") == F.col("_block")) & (F.col("i") >= size - 1))
        .select(
            *groups, "i",
            F.transform(F.array_sort("_run"), lambda r: r["x"]).alias("sequence"),
            "label",
        )
    )


def balanced_class_weights(df: DataFrame, *, label: str) -> DataFrame:
    """Rows over classes times rows of the class."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("t")).scalar()
    return counts.withColumn("weight", total["n"] / (total["k"] * F.col("n")))


def with_class_weight(df: DataFrame, *, label: str, out: str = "weight") -> DataFrame:
    """The balanced weight of each row's class as a column for the model fits."""
    weights = {r[label]: r["weight"] for r in balanced_class_weights(df, label=label).collect()}
    value = F.lit(None).cast("double")
    for name, weight in weights.items():
        value = F.when(col(label) == F.lit(name), F.lit(weight)).otherwise(value)
    return df.withColumn(out, value)


def pos_weight_ratio(df: DataFrame, *, label: str) -> DataFrame:
    """Negatives per positive."""
    positive = F.count_if(col(label).cast("boolean"))
    negative = F.count_if(~col(label).cast("boolean"))
    return df.agg((negative / F.nullif(positive, F.lit(0))).alias("ratio"))


def stratified_folds(
    df: DataFrame, *, label: str, key: str, k: int = 5, seed: int = 42, draw: str | None = None
) -> DataFrame:
    """Adds ``fold`` 0..k-1: rows of a class are dealt out in hash order.

    A given ``draw`` need not be uniform, so its ranks come from ranges of the data and not from equal
    slices of all numbers, which could put a whole class in one task.
    """
    if draw:
        ranked = with_group_index(df, [label], [draw, key], name="_rank")
    else:
        hashed = df.withColumn("_draw", F.xxhash64(col(key), F.lit(seed)))
        ranked = hash_rank(hashed, "_draw", key, by=[label], name="_rank")
    dealt = ranked.withColumn("fold", F.pmod("_rank", F.lit(k)).cast("int"))
    return dealt.select(*df.columns, "fold")


def expanding_folds(df: DataFrame, *, order: Sequence[str], k: int = 5) -> DataFrame:
    """Each fold trains on all rows before its test block, in time order."""
    n = df.count()
    step = n // (k + 1)
    if step < 10:
        raise ValueError("not enough rows for meaningful folds")
    indexed = with_global_index(df, order)
    i = F.col("i")
    # Block b of ``step`` rows tests fold b - 1 and trains the folds from b on; rows after the last
    # whole block take no part.
    block = F.floor(i / step).cast("int")
    folds = F.when(block <= k, F.sequence(F.greatest(block - 1, F.lit(0)), F.lit(k - 1)))
    return indexed.withColumn("fold", F.explode(folds)).withColumn(
        "role", F.when(i < (F.col("fold") + 1) * step, "train").otherwise("test")
    )
