"""Column functions: paths, delimited lists, dates and churn."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalize_path(path: Column, *, prefix: str = "") -> Column:
    """Drop a checkout prefix (a regular expression) and use forward slashes."""
    stripped = F.regexp_replace(path, prefix, "") if prefix else path
    return F.replace(stripped, F.lit("\\"), F.lit("/"))


def split_delimited(text: Column, *, sep: str, drop_empty: bool = True) -> Column:
    """Split on a literal delimiter and strip commas.

    ``drop_empty`` removes entries that are empty after the comma strip. Without it whitespace is
    trimmed and only blank pieces go, so a lone comma is kept as an empty entry.
    """
    pieces = F.split(text, re.escape(sep))
    if drop_empty:
        return F.filter(F.transform(pieces, lambda p: F.btrim(p, F.lit(","))), lambda p: p != "")
    trimmed = F.filter(F.transform(pieces, F.trim), lambda p: p != "")
    return F.transform(trimmed, lambda p: F.btrim(p, F.lit(",")))


def parse_list_string(text: Column) -> Column:
    """``"['a', 'b']"`` to an array; an empty list gives one empty entry."""
    bare = F.btrim(text, F.lit("[]'"))
    return F.split(F.replace(bare, F.lit("'"), F.lit("")), ", ")


def is_source_file(
    path: Column,
    *,
    suffix: str = ".java",
    excluded: tuple[str, ...] = ("package-info.java",),
    banned: tuple[str, ...] = ("test", "example"),
) -> Column:
    """True for a path that ends as source code does and names no banned word."""
    keep = path.endswith(suffix)
    for ending in excluded:
        keep = keep & ~path.endswith(ending)
    for word in banned:
        keep = keep & ~F.lower(path).contains(word)
    return keep


def epoch_to_timestamp(seconds: Column) -> Column:
    return F.timestamp_seconds(seconds)


def calendar_features(ts: Column) -> dict[str, Column]:
    """Hour, weekday with Monday as 0, and the weekend flag."""
    return {
        "time_of_day": F.hour(ts),
        "day_of_week": F.weekday(ts),
        "is_weekend": F.weekday(ts) > 4,
    }


def churn_features(*, added: Column, deleted: Column, files: Column) -> dict[str, Column]:
    total = added + deleted
    return {
        "net_lines_changed": added - deleted,
        "absolute_lines_changed": F.abs(total),
        "lines_per_file": total / files,
    }


def changed_file_count(text: Column) -> Column:
    """Commas plus one."""
    return F.length(text) - F.length(F.replace(text, F.lit(","), F.lit(""))) + 1


def bucket_by_width(value: Column, *, low: Column, high: Column, labels: tuple[str, ...]) -> Column:
    """Equal-width right-closed bins over [low, high]; a constant column falls in the middle bin."""
    width = (high - low) / len(labels)
    out = F.when(value.isNull(), F.lit(None)).when(high == low, F.lit(labels[len(labels) // 2]))
    for step, label in enumerate(labels[:-1], start=1):
        out = out.when(value <= low + width * step, F.lit(label))
    return out.otherwise(F.lit(labels[-1]))


def ordinal(value: Column, codes: Mapping[str, int]) -> Column:
    """Map bucket labels to numbers."""
    out = F.when(F.lit(False), F.lit(None).cast("int"))
    for label, code in codes.items():
        out = out.when(value == label, F.lit(code))
    return out
