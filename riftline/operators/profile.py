"""Aggregates and profiles. Every one combines map-side before it shuffles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.functions.folds import col


def mean_first_by_key(
    df: DataFrame, *, key: Sequence[str], numeric: Sequence[str], other: Sequence[str], order: Sequence[str]
) -> DataFrame:
    """Mean of the numeric metrics and the first value, by ``order``, of the others."""
    place = F.struct(*[col(c) for c in order])
    return df.groupBy(*key).agg(
        *[F.avg(col(c)).alias(c) for c in numeric],
        *[F.min_by(col(c), place).alias(c) for c in other],
    )


def sum_over_count(df: DataFrame, *, key: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Sum over the row count: a missing value counts in the divisor."""
    rows = F.count(F.lit(1))
    return df.groupBy(*key).agg(*[(F.coalesce(F.sum(col(c)), F.lit(0)) / rows).alias(c) for c in cols])


def value_counts(df: DataFrame, *, col: str) -> DataFrame:
    return (
        df.filter(F.col(col).isNotNull()).groupBy(col).count().orderBy(F.desc("count"), col)
    )


def null_profile(df: DataFrame) -> DataFrame:
    """Columns with missing values and how many, in one pass."""
    counts = df.agg(*[F.count_if(col(c).isNull()).alias(c) for c in df.columns])
    pairs = F.array(*[F.struct(F.lit(c).alias("column"), col(c).alias("n_null")) for c in df.columns])
    return counts.select(F.inline(pairs)).filter(F.col("n_null") > 0)


def distinct_values(df: DataFrame, *, col: str) -> DataFrame:
    return df.select(col).distinct()


def group_sizes(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    """How many groups there are of each size. Distinct sizes grow with the root of the rows."""
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("size"))
    return sizes.groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def group_size_summary(df: DataFrame, *, key: Sequence[str]) -> DataFrame:
    sizes = group_sizes(df, key=key)
    size, groups = F.col("size").cast("double"), F.col("groups")
    quartiles = F.percentile(size, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), groups)
    n, total = F.sum(groups), F.sum(size * groups)
    spread = F.sum(size * size * groups) - total * total / n
    return sizes.agg(
        n.alias("groups"),
        (total / n).alias("mean"),
        F.when(n > 1, F.sqrt(F.greatest(spread, F.lit(0.0)) / F.nullif(n - 1, F.lit(0)))).alias("std"),
        F.min("size").alias("min"),
        quartiles.alias("q"),
        F.max("size").alias("max"),
    ).select(
        "groups", "mean", "std", "min",
        F.col("q")[0].alias("q25"), F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max",
    )


def group_size_over(df: DataFrame, *, key: Sequence[str], limits: Sequence[int] = (10, 50)) -> DataFrame:
    """Number and percentage of groups above each limit."""
    sizes = group_sizes(df, key=key)
    above = [F.sum(F.when(F.col("size") > n, F.col("groups")).otherwise(0)) for n in limits]
    row = sizes.agg(F.sum("groups").alias("all"), *[c.alias(f"n{i}") for i, c in enumerate(above)])
    parts = [
        F.struct(
            F.lit(n).alias("limit"),
            F.col(f"n{i}").alias("groups"),
            (F.col(f"n{i}") * 100.0 / F.col("all")).alias("percent"),
        )
        for i, n in enumerate(limits)
    ]
    return row.select(F.inline(F.array(*parts)))


def top_groups(df: DataFrame, *, key: Sequence[str], n: int = 10) -> DataFrame:
    return (
        df.groupBy(*key).agg(F.count(F.lit(1)).alias("size")).orderBy(F.desc("size"), *key).limit(n)
    )


def mean_frequency(df: DataFrame, *, col: str) -> DataFrame:
    """Mean number of rows per value."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).count()
    return counts.agg(F.avg("count").alias("mean_frequency"))


def histogram(df: DataFrame, *, col: str, bins: int, where: Column | None = None) -> DataFrame:
    """Rows per equal-width bin, empty bins included; the last bin is closed."""
    rows = df if where is None else df.filter(where)
    rows = rows.filter(F.col(col).isNotNull()).select(F.col(col).cast("double").alias("x"))
    span = rows.agg(F.struct(F.min("x").alias("low"), F.max("x").alias("high")).alias("span"))
    limits = span.scalar()
    # A constant column is given a unit range around its value.
    flat = limits["high"] == limits["low"]
    low = F.when(flat, limits["low"] - 0.5).otherwise(limits["low"])
    width = F.when(flat, F.lit(1.0)).otherwise(limits["high"] - limits["low"]) / bins
    place = F.least(F.floor((F.col("x") - low) / width), F.lit(bins - 1)).cast("int")
    counts = rows.groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    edges = span.select(
        F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"), F.col("span.low").alias("a"),
        F.col("span.high").alias("b"),
    )
    start = F.when(F.col("a") == F.col("b"), F.col("a") - 0.5).otherwise(F.col("a"))
    step = F.when(F.col("a") == F.col("b"), F.lit(1.0)).otherwise(F.col("b") - F.col("a")) / bins
    return edges.join(counts, "bin", "left").select(
        "bin",
        (start + step * F.col("bin")).alias("low"),
        (start + step * (F.col("bin") + 1)).alias("high"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )


def row_count(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"))
