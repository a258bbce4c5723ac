"""Joins of commits, their parents and class metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.functions.folds import col
from riftline.schemas import delta
from riftline.session import freeze

HOT_ROWS = 1_000_000
NAMED_KEYS = 100_000  # hot keys up to this number are broadcast


def hot_keys(rows: DataFrame, *, on: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """The keys with more than ``hot_rows`` rows and the number of slices for each."""
    counts = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    return counts.filter(F.col("_n") > hot_rows).select(*on, F.ceil(F.col("_n") / hot_rows).cast("int").alias("_slices"))


def split_hot_join(
    rows: DataFrame,
    other: DataFrame,
    *,
    on: Sequence[str],
    how: str = "inner",
    hot: DataFrame | None = None,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Equality join in which a key with very many ``rows`` is cut into slices.

    The slices of ``rows`` are dealt out by row number, so equal rows spread too, and the matching
    ``other`` rows are repeated once per slice. ``hot`` names the keys to slice; it is counted from
    ``rows`` if it is not given, which reads them a second time. The hot keys are counted before they
    are broadcast: past ``NAMED_KEYS`` of them they join as an ordinary table. Row numbers depend on the
    order in which rows arrive, so rows dealt to slices are written before the join: a task run again
    must not deal them anew.
    """
    named = freeze(hot_keys(rows, on=on, hot_rows=hot_rows) if hot is None else hot)
    sliced = named.count()
    if sliced <= NAMED_KEYS:
        named = F.broadcast(named)
    many = F.coalesce(F.col("_slices"), F.lit(1))
    deal = F.when(F.col("_slices").isNull(), 0).otherwise(F.pmod(F.xxhash64(F.monotonically_increasing_id()), many))
    dealt = rows.join(named, list(on), "left").withColumn("_slice", deal.cast("int"))
    if sliced:
        dealt = freeze(dealt)
    repeated = other.join(named, list(on), "left").withColumn(
        "_slice", F.explode(F.sequence(F.lit(0), many - 1))
    )
    return dealt.drop("_slices").join(repeated.drop("_slices"), [*on, "_slice"], how).drop("_slice")


def explode_files(commits: DataFrame, *, files: str, file: str) -> DataFrame:
    """One row per commit and changed file."""
    others = [col(c) for c in commits.columns if c != files]
    return commits.select(*others, F.explode(col(files)).alias(file))


def explode_inner_join(commits: DataFrame, metrics: DataFrame, *, files: str, file: str) -> DataFrame:
    """Class metrics of every changed file of every commit."""
    return split_hot_join(explode_files(commits, files=files, file=file), metrics, on=[file])


def explode_left_join(commits: DataFrame, metrics: DataFrame, *, files: str, file: str) -> DataFrame:
    """All class metrics, with the commits that changed their file where there are any.

    A file that very many commits changed is hot on the optional side, which an outer join cannot
    split; matches come from the sliced inner join and the rest is added by an anti join.
    """
    changed = explode_files(commits, files=files, file=file)
    matched = split_hot_join(changed, metrics, on=[file])
    alone = metrics.join(changed.select(file).distinct(), file, "left_anti")
    names = [*metrics.columns, *[c for c in changed.columns if c != file]]
    return matched.unionByName(alone, allowMissingColumns=True).select(*[col(c) for c in names])


def changed_class_semi_join(metrics: DataFrame, changed: DataFrame, *, on: Sequence[str]) -> DataFrame:
    """Metric rows whose commit and file are on the changed list."""
    return metrics.join(changed.select(*on).distinct(), list(on), "left_semi")


def commit_parent(history: DataFrame, *, seq: str = "seq", key: str = "hash") -> DataFrame:
    """Each commit with the next older line of the history; the oldest has none.

    A join on consecutive line numbers spreads over the cluster; a lead over the whole history
    would be one task.
    """
    older = history.select((col(seq) - 1).alias(seq), col(key).alias("parent"))
    return history.join(older, seq, "left").select(key, "parent", seq)


def one_per_key(df: DataFrame, *, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key. Combines map-side, so copies of one key never meet in bulk."""
    rest = [c for c in df.columns if c not in keys]
    first = F.min_by(F.struct(*[col(c) for c in rest]), F.struct(*[col(c) for c in order]))
    return (
        df.groupBy(*keys).agg(first.alias("_first"))
        .select(*[col(k) for k in keys], *[F.col("_first").getField(c).alias(c) for c in rest])
        .select(*[col(c) for c in df.columns])
    )


def class_status(
    current: DataFrame, parent: DataFrame, *, keys: Sequence[str], include_deleted: bool = False
) -> DataFrame:
    """Classes as ``modified`` or ``new`` against the parent, ``deleted`` ones on request."""
    now = current.select(*keys).distinct().withColumn("_now", F.lit(True))
    old = parent.select(*keys).distinct().withColumn("_old", F.lit(True))
    status = (
        F.when(F.col("_now").isNull(), "deleted").when(F.col("_old").isNull(), "new").otherwise("modified")
    )
    joined = now.join(old, list(keys), "full" if include_deleted else "left")
    return joined.select(*keys, status.alias("status"))


def metric_delta(
    current: DataFrame, parent: DataFrame, *, keys: Sequence[str], metrics: Sequence[str]
) -> DataFrame:
    """Current rows with ``d_<metric>``.

    A class of the parent gives current minus parent, null if either is missing; a class that is
    new gives the current value. ``keys`` must be unique on both sides.
    """
    old = parent.select(
        *[col(k) for k in keys], *[col(m).alias(f"_p_{m}") for m in metrics], F.lit(True).alias("_known")
    )
    change = {
        delta(m): F.when(F.col("_known"), col(m) - col(f"_p_{m}")).otherwise(col(m)) for m in metrics
    }
    return current.join(old, list(keys), "left").select(
        *[col(c) for c in current.columns], *[c.alias(n) for n, c in change.items()]
    )


def attach_commit_info(
    rows: DataFrame, commits: DataFrame, *, key: str, order: Sequence[str], hot_rows: int | None = None
) -> DataFrame:
    """Commit columns on every class row; a commit given twice counts once.

    The adaptive skew join splits a commit with very many rows; ``hot_rows`` slices it ahead of time.
    """
    single = one_per_key(commits, keys=[key], order=order)
    if hot_rows:
        return split_hot_join(rows, single, on=[key], hot_rows=hot_rows)
    return rows.join(single, key)


def missing_file_policy(
    pairs: DataFrame, metrics: DataFrame, *, mode: str = "skip", check_current: bool = True
) -> DataFrame:
    """Apply the rule for a changed file that the commit or its parent lacks.

    ``pairs`` holds unique ``(hash, parent, file)`` and ``metrics`` the class rows per
    ``(hash, file)``. ``skip`` keeps pairs with the file on both sides; a caller that goes on to join
    the current file may leave out the check for it. ``zero`` keeps every pair whose commits were both
    analysed, as a row of zeros stands in for the missing file; the added ``held`` tells whether the
    commit itself has the file.
    """
    if mode not in ("skip", "zero"):
        raise ValueError("mode must be 'skip' or 'zero'")
    files = metrics.select("hash", "file").distinct()
    if mode == "skip":
        kept = pairs.join(files.withColumnRenamed("hash", "parent"), ["parent", "file"], "left_semi")
        if check_current:
            kept = kept.join(files, ["hash", "file"], "left_semi")
        return kept.select(*pairs.columns, F.lit(True).alias("held"))
    commits = metrics.select("hash").distinct()
    analysed = pairs.join(commits, "hash", "left_semi").join(
        commits.withColumnRenamed("hash", "parent"), "parent", "left_semi"
    )
    marked = analysed.join(files.withColumn("held", F.lit(True)), ["hash", "file"], "left")
    return marked.select(*pairs.columns, F.coalesce("held", F.lit(False)).alias("held"))
