"""Cleaning rules for the change table.

A rule that needs a column the table lacks returns the table as it is. A missing value leaves a
comparison undecided, and an undecided row is kept by the drop rules and dropped by the keep rules.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.functions.folds import col, fold_and, fold_sum, nan_to_null
from riftline.operators.ordering import with_next
from riftline.schemas import INFO, LABEL, main_features
from riftline.session import stored

DAY = 24 * 3600
TIME = "author_date_unix_timestamp"


@dataclass(frozen=True)
class CleanConfig:
    """Thresholds of the rules; the defaults are the fixed values of the main run."""

    gap_deleted: int = 2 * DAY
    gap_recent: int = 28 * DAY
    min_change: int = 10
    minimal: int = 15
    marginal: int = 250
    max_files: int = 10
    rules: Sequence[int] = (0, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 15)
    project: str | None = None
    time: str = TIME
    tie: Sequence[str] = ("hash", "file", "class")
    features: Sequence[str] = field(default_factory=tuple)
    info: Sequence[str] = field(default_factory=tuple)


def _has(df: DataFrame, *names: str) -> bool:
    return set(names) <= set(df.columns)


def _drop_where(df: DataFrame, condition: Column) -> DataFrame:
    return df.filter(~F.coalesce(condition, F.lit(False)))


def _deltas(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith("d_")]


def _is_bug() -> Column:
    return F.coalesce(col(LABEL).cast("boolean"), F.lit(False))


def _seconds(name: str) -> Column:
    return F.unix_micros(col(name).cast("timestamp")) / 1_000_000


def rule_dedupe(df: DataFrame, *, copies: str | None = None) -> DataFrame:
    """One row of each kind; with ``copies``, also how many there were of it."""
    rows = nan_to_null(df)
    if copies is None:
        return rows.dropDuplicates()
    return rows.groupBy(*[col(c) for c in rows.columns]).agg(F.count(F.lit(1)).alias(copies))


def rule_deleted_soon(
    df: DataFrame, *, gap: float = 2 * DAY, project: str | None = None, time: str = TIME,
    tie: Sequence[str] = ("hash", "file"),
) -> DataFrame:
    """Drop a change whose class is deleted by its next change within ``gap`` seconds."""
    by = [*([project] if project else []), "class"]
    ahead = with_next(
        df, by=by, order=[time, *tie],
        values={"_kind": F.lower(F.col("type")), "_when": _seconds(time)},
    )
    soon = (F.col("_kind") == "deleted") & (F.col("_when") - _seconds(time) < gap)
    return _drop_where(ahead, soon & F.col("class").isNotNull()).drop("_kind", "_when")


def rule_recent_clean_last(
    df: DataFrame, *, gap: float = 28 * DAY, project: str | None = None, time: str = TIME,
    tie: Sequence[str] = ("hash", "file"),
) -> DataFrame:
    """Drop the last change of a class if it is clean and the project ended within ``gap`` of it.

    The last change comes from an aggregate, and the rows to drop are matched on their whole
    unique key, so a class with very many changes does not gather in one task.
    """
    by = [project] if project else []
    key = [*by, "class", time, *tie]
    place = F.struct(col(time).isNull().alias("late"), col(time).alias("at"), *[col(c).alias(f"t{n}") for n, c in enumerate(tie)])
    latest = df.groupBy(*by, "class").agg(
        F.max(place).alias("_at"),
        F.max_by(F.coalesce(~col(LABEL).cast("boolean"), F.lit(False)), place).alias("_clean"),
        F.max(_seconds(time)).alias("_last"),
    )
    if by:
        ends = df.groupBy(*by).agg(F.max(_seconds(time)).alias("_end"))
        named = latest.join(ends, by)
    else:
        named = latest.withColumn("_end", df.agg(F.max(_seconds(time))).scalar())
    victims = named.filter(
        F.col("class").isNotNull() & F.col("_clean") & (F.col("_end") - F.col("_last") < gap)
        & ~F.col("_at.late")
    ).select(
        *by, "class", F.col("_at.at").alias(time), *[F.col(f"_at.t{n}").alias(c) for n, c in enumerate(tie)]
    )
    return df.join(victims, key, "left_anti").select(*[col(c) for c in df.columns])


def rule_has_members(df: DataFrame) -> DataFrame:
    if not _has(df, "totalMethodsQty", "totalFieldsQty"):
        return df
    return df.filter((F.col("totalMethodsQty") > 0) | (F.col("totalFieldsQty") > 0))


def rule_accessor_only(df: DataFrame) -> DataFrame:
    if not _has(df, "totalMethodsQty", "wmc", "rfc"):
        return df
    return _drop_where(df, (F.col("totalMethodsQty") > 0) & (F.col("wmc") <= 1) & (F.col("rfc") <= 1))


def rule_no_lines_added(df: DataFrame) -> DataFrame:
    return df.filter(F.col("la") > 0) if _has(df, "la") else df


def rule_comment_only(df: DataFrame) -> DataFrame:
    """Drop a change that moved no metric."""
    deltas = _deltas(df)
    if not deltas:
        return df
    return _drop_where(df, fold_and([F.coalesce(col(c) == 0, F.lit(False)) for c in deltas]))


def rule_trivial_method_change(df: DataFrame, *, min_change: float = 10) -> DataFrame:
    if not _has(df, "la", "ld", "d_totalMethodsQty"):
        return df
    small = F.coalesce(F.col("la") + F.col("ld") < min_change, F.lit(False))
    return df.filter(~(small & F.coalesce(F.col("d_totalMethodsQty") != 0, F.lit(True))))


def rule_name_suffix(df: DataFrame, *, endings: Sequence[str] = ("Type", "Exception")) -> DataFrame:
    """Drop by the ending of what stands before the first dot of the whole path."""
    if not _has(df, "file"):
        return df
    stem = F.trim(F.substring_index("file", ".", 1))
    for ending in endings:
        df = _drop_where(df, stem.endswith(ending))
    return df


def rule_dead_code(df: DataFrame) -> DataFrame:
    if not _has(df, "cbo", "fanin"):
        return df
    return _drop_where(df, (F.col("cbo") == 0) & (F.col("fanin") == 0))


def rule_data_class(df: DataFrame) -> DataFrame:
    if not _has(df, "wmc", "rfc", "totalFieldsQty"):
        return df
    return _drop_where(df, (F.col("wmc") <= 1) & (F.col("rfc") <= 1) & (F.col("totalFieldsQty") >= 1))


def rule_no_churn(df: DataFrame) -> DataFrame:
    if not _has(df, "la", "ld"):
        return df
    return _drop_where(df, (F.col("la") == 0) & (F.col("ld") == 0))


def total_change(df: DataFrame) -> Column:
    return fold_sum([F.coalesce(F.abs(col(c)), F.lit(0)) for c in _deltas(df)])


def rule_change_too_large(df: DataFrame, *, threshold: float = 250) -> DataFrame:
    return df.filter((total_change(df) <= threshold) | _is_bug()) if _deltas(df) else df


def rule_change_too_small(df: DataFrame, *, threshold: float = 15) -> DataFrame:
    return df.filter((total_change(df) >= threshold) | _is_bug()) if _deltas(df) else df


def rule_too_many_files(df: DataFrame, *, threshold: float = 10) -> DataFrame:
    return df.filter((F.col("changed_file_count") <= threshold) | _is_bug())


def _steps(config: CleanConfig, columns: Sequence[str]) -> dict:
    from riftline.operators.clusters import rule_cluster_reduce

    # Without a choice of columns: the main run's features and descriptive columns, as far as there are any.
    features = config.features or [c for c in main_features() if c in columns]
    info = config.info or [c for c in INFO if c in columns]

    timed = {"project": config.project, "time": config.time, "tie": list(config.tie)}
    return {
        0: rule_dedupe,
        1: lambda d: rule_deleted_soon(d, gap=config.gap_deleted, **timed),
        2: lambda d: rule_recent_clean_last(d, gap=config.gap_recent, **timed),
        3: rule_has_members,
        4: rule_accessor_only,
        5: rule_no_lines_added,
        6: rule_comment_only,
        7: lambda d: rule_trivial_method_change(d, min_change=config.min_change),
        8: rule_name_suffix,
        9: rule_dead_code,
        10: rule_data_class,
        11: rule_no_churn,
        12: lambda d: rule_change_too_large(d, threshold=config.marginal),
        13: lambda d: rule_change_too_small(d, threshold=config.minimal),
        14: lambda d: rule_too_many_files(d, threshold=config.max_files),
        15: lambda d: rule_cluster_reduce(
            d, threshold=config.max_files, features=features, info=info,
            project=config.project, tie=config.tie,
        ),
    }


ROWS_PER_TASK = 100_000


def _spread(df: DataFrame, config: CleanConfig) -> DataFrame:
    """The rows dealt by the key that rules 0 and 2 match on, to as many tasks as the rows ask for.

    Both rules hold the wide rows of a task, so a number of tasks that stays while the table grows would grow a task's memory;
    dealt once by this key, neither rule shuffles the wide rows again.
    """
    key = [*([config.project] if config.project else []), "class", config.time, *config.tie]
    if not {0, 2} & set(config.rules) or not _has(df, *key):
        return df
    tasks = -(-df.count() // ROWS_PER_TASK)
    return df.repartition(tasks, *[col(c) for c in key]) if tasks > 1 else df


def clean_dataset(df: DataFrame, *, config: CleanConfig = CleanConfig()) -> DataFrame:
    """The rules in the configured order."""
    steps = _steps(config, df.columns)
    df = _spread(df, config)
    for number in config.rules:
        if number == 15:
            df = stored(df)  # the rule reads its rows three times, and the rules before it would run as often
        df = steps[number](df)
    return df


# Rules that look at one row alone: each only filters.
ROW_RULES = range(3, 15)


@dataclass(frozen=True)
class _Conditions:
    """Takes the place of a table in a rule that only filters, and keeps the conditions."""

    columns: Sequence[str]
    kept: tuple[Column, ...] = ()

    def filter(self, condition: Column) -> _Conditions:
        return _Conditions(self.columns, (*self.kept, condition))


# Rules that look at other rows, but only at the key, the time, the type and the label.
TIMED_RULES = (1, 2)
KEPT = 1 << 30  # the mark of a row that no rule of a run drops
COPIES = "_copies"


def _mark(steps: dict, columns: Sequence[str], run: Sequence[tuple]) -> Column:
    """The first step of the run that drops the row."""
    passes = [fold_and([F.coalesce(c, F.lit(False)) for c in steps[number](_Conditions(columns)).kept]) for _, number in run]
    return F.coalesce(*[F.when(~kept, F.lit(at)) for (at, _), kept in zip(run, passes)], F.lit(KEPT))


def clean_counts(df: DataFrame, *, config: CleanConfig = CleanConfig(), dealt: bool = False) -> DataFrame:
    """Rows before the first and after each rule, with how many the rule dropped.

    A rule on single rows needs no pass of its own: the rows before it are marked with the first such rule that drops
    them, and one aggregate counts up to the next rule that looks at other rows. Rows that only rules 1 and 2 are left to
    compare need no more than their key, time, type, label and marks, which are stored once. ``dealt`` tells that equal rows
    already share a task of a size that fits.
    """
    columns = df.columns
    steps = _steps(config, columns)
    df = df if dealt else _spread(df, config)
    runs, whole = [[]], []  # a run of rules on single rows, a rule on others, a run, and so on
    for step in enumerate(config.rules, 1):
        if step[1] in ROW_RULES:
            runs[-1].append(step)
        else:
            whole.append(step)
            runs.append([])
    starts, counts, stored_at = [(0, None), *whole], [], None
    for n, run in enumerate(runs):
        left = [number for _, number in whole[n:]]
        if n == 0 and left[:1] == [0] and not run:
            df = rule_dedupe(df, copies=COPIES)  # its copies are the rows before it: no pass of their own
            continue
        held = COPIES in df.columns
        if stored_at is None and left and set(left) <= set(TIMED_RULES):
            key = [*([config.project] if config.project else []), "class", config.time, *config.tie, "type", LABEL]
            marks = [_mark(steps, columns, later).alias(f"_gone{at}") for at, later in enumerate(runs) if at >= n]
            df = stored(df.select(*[col(c) for c in dict.fromkeys(key) if c in columns], *marks, *([COPIES] if held else [])))
            stored_at = n
        gone = F.col(f"_gone{n}") if stored_at is not None else _mark(steps, columns, run)
        marked = df.select(gone.alias("_gone"), *([COPIES] if held else []))
        tally = {starts[n]: F.count(F.lit(1)), **{step: F.count_if(F.col("_gone") > step[0]) for step in run}}
        if held:
            tally = {starts[n - 1]: F.coalesce(F.sum(COPIES), F.lit(0)), **tally}
        rows = marked.agg(*[value.alias(f"n{at}") for (at, _), value in tally.items()])
        counts.append(rows.select(F.inline(F.array(*[
            F.struct(F.lit(at).alias("step"), F.lit(number).cast("int").alias("rule"), F.col(f"n{at}").alias("rows"))
            for at, number in tally
        ]))))
        if n == len(whole):
            break
        if stored_at is not None:
            df = df.filter(gone == KEPT)
        else:
            for _, number in run:
                df = steps[number](df)
        df = steps[whole[n][1]](df.drop(COPIES))
    table = reduce(DataFrame.unionByName, counts)
    before = F.lag("rows").over(Window.orderBy("step"))  # one row per step; a join would count everything twice
    return table.select("step", "rule", "rows", (before - F.col("rows")).alias("dropped"))


def clean_features_labels(
    df: DataFrame, *, features: Sequence[str], label: str = LABEL, config: CleanConfig = CleanConfig()
) -> DataFrame:
    """Cleaned features and label; they stay in one row, so no index has to line them up."""
    return clean_dataset(df, config=config).select(*[col(c) for c in features], col(label))
