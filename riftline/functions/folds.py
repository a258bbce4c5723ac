"""Balanced folds over wide column lists: depth grows with the logarithm of the width."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def fold(terms: Iterable[Column], combine: Callable[[Column, Column], Column], empty: Column) -> Column:
    level = list(terms)
    if not level:
        return empty
    while len(level) > 1:
        paired = [combine(a, b) for a, b in zip(level[::2], level[1::2])]
        level = paired + ([level[-1]] if len(level) % 2 else [])
    return level[0]


def fold_sum(terms: Iterable[Column]) -> Column:
    return fold(terms, lambda a, b: a + b, F.lit(0))


def fold_and(terms: Iterable[Column]) -> Column:
    return fold(terms, lambda a, b: a & b, F.lit(True))


def fold_or(terms: Iterable[Column]) -> Column:
    return fold(terms, lambda a, b: a | b, F.lit(False))


def col(name: str) -> Column:
    """Column by exact name, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN is a missing value here, and Spark would order it above every number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({c: F.when(~F.isnan(col(c)), col(c)) for c in floats}) if floats else df


def uniform(*keys: Column | str) -> Column:
    """A reproducible draw in [0, 1) that depends on the keys alone, not on partitioning."""
    return F.shiftrightunsigned(F.xxhash64(*keys), 11).cast("double") / F.lit(float(1 << 53))


def normal(*keys: Column) -> Column:
    """A reproducible standard normal draw (Box-Muller on two hashed uniforms)."""
    radius = F.sqrt(-2.0 * F.log(1.0 - uniform(*keys, F.lit("radius"))))
    return radius * F.cos(2.0 * F.pi() * uniform(*keys, F.lit("angle")))
