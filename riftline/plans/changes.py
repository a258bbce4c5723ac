"""The change table: commits, their changed files and the metric change of every class."""

from __future__ import annotations

from collections.abc import Sequence
from functools import partial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.functions.columns import (
    calendar_features,
    changed_file_count,
    churn_features,
    epoch_to_timestamp,
    is_source_file,
    parse_list_string,
)
from riftline.functions.folds import col
from riftline.operators.joins import (
    commit_parent,
    hot_keys,
    metric_delta,
    missing_file_policy,
    one_per_key,
    split_hot_join,
)
from riftline.operators.rows import copy_columns, equal_width_bucket
from riftline.schemas import COMMIT_DERIVED, COMMIT_INFO, METRICS, change_columns, delta


def derived_commits(commits: DataFrame) -> DataFrame:
    """Commits with the columns derived from time, churn, authors and the file list; epoch seconds become a timestamp."""
    ts = col("author_date_unix_timestamp")
    timed = commits if isinstance(commits.schema["author_date_unix_timestamp"].dataType, T.TimestampType) else (
        commits.withColumn("author_date_unix_timestamp", epoch_to_timestamp(ts))
    )
    count = changed_file_count(col("fileschanged"))
    derived = timed.withColumns({
        **calendar_features(ts),
        **churn_features(added=col("la"), deleted=col("ld"), files=count),
        "changed_file_count": count, "num_files_changed": count,
    })
    copied = copy_columns(derived, {"author_experience": "exp", "author_ownership": "ndev"})
    return equal_width_bucket(copied, col="entrophy", out="entropy_bucket")


def build_changes(
    commits: DataFrame, history: DataFrame, metrics: DataFrame, *, missing_file: str = "skip", unique: bool = False
) -> DataFrame:
    """The change table with its 126 columns, in their order.

    The plan is wide: write the table before it is cleaned. ``commits`` is as scanned (``commit_hash``, epoch seconds,
    the delimited file list), ``metrics`` has ``commit, file,
    class, type`` and the class metrics.
    """
    named = derived_commits(commits.withColumnRenamed("commit_hash", "hash"))
    wide = merge_changes(
        named.select("hash", "fileschanged", *[col(c) for c in (*COMMIT_INFO, *COMMIT_DERIVED)]), history,
        metrics.withColumnRenamed("commit", "hash"), metric_names=METRICS, missing_file=missing_file, unique=unique,
    )
    return wide.select(*[col(c) for c in change_columns()])


def merge_changes(
    commits: DataFrame,
    history: DataFrame,
    metrics: DataFrame,
    *,
    metric_names: Sequence[str],
    missing_file: str = "skip",
    files: str = "fileschanged",
    unique: bool = False,
    hot_rows: int | None = None,
) -> DataFrame:
    """One row per commit, changed source file and class.

    ``commits`` has ``hash`` and the delimited ``files`` text, ``history`` has ``seq, hash`` with the
    newest first, ``metrics`` has ``hash, file, class`` and the metric columns. ``unique`` promises one
    row per commit and per class; without it copies are dropped first.

    The commit columns ride on the exploded file list, so they need no join of their own. Metrics meet
    the changed files twice, as the commit's and as its parent's, on the same key; classes then meet on
    ``(hash, file, class)``, which is unique and so cannot be skewed. A file with very many classes is
    split by the adaptive skew join; ``hot_rows`` slices it ahead of time where that is switched off.
    """
    if not unique:
        commits = one_per_key(commits, keys=["hash"], order=[c for c in commits.columns if c != "hash"])
        state = [c for c in metrics.columns if c not in ("hash", "file", "class")]
        metrics = one_per_key(metrics, keys=["hash", "file", "class"], order=state)
    parents = commit_parent(history).filter(F.col("parent").isNotNull()).select("hash", "parent")
    info = [c for c in commits.columns if c not in ("hash", files)]
    pairs = (
        commits.join(parents, "hash")
        .select("hash", "parent", *[col(c) for c in info], F.explode(F.array_distinct(parse_list_string(col(files)))).alias("file"))
        .filter(is_source_file(F.col("file")))
    )
    usable = missing_file_policy(pairs, metrics, mode=missing_file, check_current=False)
    present = usable.filter("held").drop("held") if missing_file == "zero" else usable.drop("held")
    if hot_rows:
        join = partial(split_hot_join, on=["hash", "file"], hot=hot_keys(metrics, on=["hash", "file"], hot_rows=hot_rows))
    else:
        join = partial(DataFrame.join, on=["hash", "file"])
    current = join(metrics, present)
    older = present.select(F.col("parent").alias("hash"), "file", F.col("hash").alias("_child"))
    before = join(metrics, older).drop("hash").withColumnRenamed("_child", "hash")
    rows = metric_delta(current, before, keys=["hash", "file", "class"], metrics=metric_names)
    measured = [*metric_names, *[delta(m) for m in metric_names]]
    if missing_file == "zero":
        # A file the commit no longer has counts as one class named 0 whose metrics are all 0.
        gone = usable.filter(~F.col("held")).drop("held")
        zeros = [F.lit(0).cast(rows.schema[c].dataType).alias(c) for c in rows.columns if c not in gone.columns]
        rows = rows.unionByName(gone.select("*", *zeros))
    others = [c for c in rows.columns if c not in {"hash", "parent", "file", "class", *measured, *info}]
    return rows.select("hash", "parent", "file", "class", *[col(c) for c in [*others, *measured, *info]])
