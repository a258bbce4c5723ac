"""Row-wise table operators: filters, fills, derived columns and samples."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.functions.columns import bucket_by_width, is_source_file
from riftline.functions.folds import col, fold_sum, uniform
from riftline.operators.ordering import as_long, split_at_rank


def source_file_filter(
    df: DataFrame,
    *,
    col: str,
    suffix: str = ".java",
    banned: tuple[str, ...] = ("test", "example"),
    excluded: tuple[str, ...] = ("package-info.java",),
) -> DataFrame:
    return df.filter(is_source_file(F.col(col), suffix=suffix, banned=banned, excluded=excluded))


def copy_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """New name to existing column."""
    return df.withColumns({new: col(old) for new, old in mapping.items()})


def equal_width_bucket(
    df: DataFrame, *, col: str, out: str, labels: tuple[str, ...] = ("low", "medium", "high")
) -> DataFrame:
    """Bucket over the table-wide range, found by a one-row subquery."""
    span = df.agg(F.struct(F.min(col).alias("low"), F.max(col).alias("high")).alias("span")).scalar()
    return df.withColumn(
        out, bucket_by_width(F.col(col), low=span["low"], high=span["high"], labels=labels)
    )


def fill_missing(df: DataFrame, value: float, *, cols: Sequence[str] | None = None) -> DataFrame:
    """Constant for missing values; in text columns the constant as text, booleans by its truth."""
    chosen = set(df.columns if cols is None else cols)
    filled = {}
    for field in df.schema:
        if field.name not in chosen:
            continue
        if isinstance(field.dataType, T.NumericType):
            filled[field.name] = F.coalesce(col(field.name), F.lit(value).cast(field.dataType))
        elif isinstance(field.dataType, T.StringType):
            filled[field.name] = F.coalesce(col(field.name), F.lit(str(value)))
        elif isinstance(field.dataType, T.BooleanType):
            filled[field.name] = F.coalesce(col(field.name), F.lit(bool(value)))
    return df.withColumns(filled)


def null_count(cols: Sequence[str]) -> Column:
    return fold_sum([col(c).isNull().cast("int") for c in cols])


def null_count_row(df: DataFrame, *, out: str = "n_null") -> DataFrame:
    return df.withColumn(out, null_count(df.columns))


def drop_sparse_rows(df: DataFrame, *, max_nulls: int = 5) -> DataFrame:
    return df.filter(null_count(df.columns) <= max_nulls)


def project_columns(
    df: DataFrame, *, keep: Sequence[str] | None = None, drop: Sequence[str] = ()
) -> DataFrame:
    names = df.columns if keep is None else list(keep)
    return df.select(*[col(c) for c in names if c not in set(drop)])


def ensure_columns(df: DataFrame, cols: Sequence[str], *, kind: str = "double") -> DataFrame:
    """Absent columns as null."""
    have = set(df.columns)
    return df.withColumns({c: F.lit(None).cast(kind) for c in cols if c not in have})


def sample_fraction(
    df: DataFrame, *, key: str, fraction: float, seed: int = 42, exact: bool = True, draw: str | None = None
) -> DataFrame:
    """A sample chosen by hash of the key: the same rows whatever the partitioning.

    The exact form takes ``round(fraction * n)`` rows, the lowest in hash order, and finds their cut by
    counting; the other form only filters, so its size varies.
    """
    if not exact:
        return df.filter(uniform(F.col(key), F.lit(seed)) < fraction)
    drawn = df.withColumn("_draw", col(draw) if draw else F.xxhash64(col(key), F.lit(seed)))
    tie = [key] if as_long(key, df.schema[key].dataType) is not None else []
    rest = split_at_rank(drawn, ["_draw", *tie], round(fraction * df.count()))
    return drawn.filter(~rest).drop("_draw")


def limit_rows(df: DataFrame, *, order: Sequence[Column | str], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def derived_columns(df: DataFrame, registry: Mapping[str, Callable[[DataFrame], Column]]) -> DataFrame:
    """Add one column per entry, in order; each function sees the columns added before it."""
    for name, function in registry.items():
        if not callable(function):
            raise ValueError(f"the entry for column '{name}' is not callable")
        df = df.withColumn(name, function(df))
    return df
