"""Column helpers for operators that stay inside Spark SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), GAP), "")


def permuted(x: Column, n: Column, *key: Column) -> Column:
    """A pseudorandom permutation of 0 .. n - 1 chosen by the key.

    A Feistel network over a grid of about sqrt(n) by sqrt(n) cells; from a cell past n the walk goes on. Fewer than
    sqrt(n) cells are past n, so the 16 steps allowed always end for n up to 256, and beyond that fail with odds under
    n ** -8 a value.
    """
    rows = F.greatest(F.ceil(F.sqrt(n.cast("double"))).cast("long"), F.lit(1).cast("long"))

    def step(v: Column, a: Column, b: Column) -> Column:
        def round_(s: Column, t: Column) -> Column:
            left = F.pmod(s["l"] + F.pmod(F.xxhash64(*key, t, s["r"]), a), a)
            return let(left, lambda moved: F.struct(
                moved.alias("l"), F.pmod(s["r"] + F.pmod(F.xxhash64(*key, -t - 1, moved), b), b).alias("r")
            ))

        start = F.struct(F.call_function("div", v, b).alias("l"), F.pmod(v, b).alias("r"))
        return let(F.aggregate(F.sequence(F.lit(0), F.lit(3)), start, round_), lambda s: s["l"] * b + s["r"])

    def walk(a: Column, b: Column) -> Column:
        def go(s: Column, _: Column) -> Column:
            return F.when(s["go"], let(step(s["v"], a, b), lambda y: F.struct(y.alias("v"), (y >= n).alias("go")))).otherwise(s)

        start = F.struct(x.cast("long").alias("v"), F.lit(True).alias("go"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(16)), start, go, lambda s: s["v"])

    return let(rows, lambda a: let(F.call_function("div", n + a - 1, a), lambda b: walk(a, b)))
