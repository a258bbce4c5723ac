"""Total orders without a one-task window.

Every helper takes an order that is total: the caller adds a unique tie key. A composite key with a
unique last part can be split anywhere, so one hot key, time or group never fills a task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riftline.functions.folds import col
from riftline.session import freeze

PART, POS = "_part", "_pos"


def range_sorted(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """Range-partition and sort by ``order``; adds the range number and the place inside it.

    Range bounds come from a sample, so a second pass could draw other bounds. The result is
    checkpointed to keep every later pass on the same ranges.
    """
    placed = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    mask = (1 << 33) - 1
    return freeze(
        placed.select(
            "*",
            F.shiftright("_place", 33).cast("int").alias(PART),
            F.col("_place").bitwiseAND(F.lit(mask)).alias(POS),
        ).drop("_place")
    )


def _running_before(per_part: DataFrame, sums: dict[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """Totals of all earlier ranges. One row per range (and group), so its size follows the cluster."""
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    return per_part.select(
        PART, *by, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(n) for n, c in sums.items()]
    )


def with_global_index(df: DataFrame, order: Sequence[Column | str], name: str = "i") -> DataFrame:
    """Dense 0-based index in the given order."""
    placed = range_sorted(df, order)
    counts = placed.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    offsets = _running_before(counts, {"_before": F.col("_n")})
    return (
        placed.join(F.broadcast(offsets), PART)
        .withColumn(name, F.col("_before") + F.col(POS))
        .drop(PART, POS, "_before")
    )


def with_group_index(
    df: DataFrame, by: Sequence[str], order: Sequence[str], name: str = "i"
) -> DataFrame:
    """Dense 0-based index inside each group; a hot group is spread over many ranges."""
    placed = range_sorted(df, [*by, *order])
    # A group is one contiguous run in each range it touches: its place minus the run's first place.
    runs = placed.groupBy(PART, *by).agg(F.count(F.lit(1)).alias("_n"), F.min(POS).alias("_first"))
    before = Window.partitionBy(*by).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    keys = [PART, *by]
    offsets = runs.select(
        *[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)],
        (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"),
    )
    matched = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys)]
    return placed.join(offsets, matched).select(
        *df.columns, (F.col("_shift") + F.col(POS)).alias(name)
    )


def running_totals(df: DataFrame, order: Sequence[Column | str], sums: dict[str, Column]) -> DataFrame:
    """Cumulative sums in the given order, the current row included."""
    placed = range_sorted(df, order)
    values = {n: F.coalesce(c, F.lit(0)) for n, c in sums.items()}
    totals = placed.groupBy(PART).agg(*[F.sum(c).alias(n) for n, c in values.items()])
    offsets = _running_before(totals, {n: F.col(n) for n in sums})
    inside = Window.partitionBy(PART).orderBy(POS).rowsBetween(Window.unboundedPreceding, 0)
    offsets = offsets.select(PART, *[F.col(n).alias(f"_before_{n}") for n in sums])
    return (
        placed.select("*", *[F.sum(c).over(inside).alias(f"_in_{n}") for n, c in values.items()])
        .join(F.broadcast(offsets), PART)
        .withColumns({n: F.col(f"_before_{n}") + F.col(f"_in_{n}") for n in sums})
        .select(*df.columns, *sums)
    )


def with_next(
    df: DataFrame, *, by: Sequence[str], order: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Values of the next row of the same group, null after the last one.

    The lookahead runs inside sorted ranges; the first row of each range closes the gap to the
    range before it.
    """
    placed = range_sorted(df, [*by, *order])
    seen = F.struct(*[F.col(c).alias(f"k{n}") for n, c in enumerate(by)], *[c.alias(n) for n, c in values.items()])
    inside = Window.partitionBy(PART).orderBy(POS)
    heads = placed.groupBy(PART).agg(F.min_by(seen, POS).alias("_head"))
    ahead = heads.select(PART, F.lead("_head").over(Window.orderBy(PART)).alias("_head"))
    joined = placed.withColumn("_lead", F.lead(seen).over(inside)).join(F.broadcast(ahead), PART)
    following = F.coalesce("_lead", "_head")
    same = F.lit(True)
    for n, c in enumerate(by):
        same = same & F.col("_next")[f"k{n}"].eqNullSafe(F.col(c))
    return (
        joined.withColumn("_next", following)
        .withColumns({n: F.when(F.col("_next").isNotNull() & same, F.col("_next")[n]) for n in values})
        .select(*df.columns, *values)
    )


# ---------------------------------------------------------------- order statistics by counting

_CELLS = 4096
_FEW = 10_000


def as_long(name: str, kind: T.DataType) -> Column | None:
    """An order-preserving 64-bit image of a column, where there is one."""
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return col(name).cast("long")
    if isinstance(kind, T.DateType):
        return F.unix_date(col(name)).cast("long")
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(col(name).cast("timestamp"))
    return None


def _cell_counts(rows: DataFrame, value: Column, low: int, width: int) -> list:
    cell = F.call_function("div", value.cast("decimal(20,0)") - F.lit(low), F.lit(width))
    return rows.groupBy(cell.alias("cell")).agg(F.count(F.lit(1)).alias("n")).orderBy("cell").collect()


def split_at_rank(df: DataFrame, order: Sequence[str], k: int) -> Column:
    """Predicate that is true for the rows at rank ``k`` and later; the rows themselves never move.

    All order columns need an integer image, and missing values sort last. The row at rank ``k`` is
    found by counting ever smaller value ranges: a pass brings at most 4096 counts to the driver, and
    once at most 10,000 rows are left in the range they are looked at directly. A few narrow passes take
    the place of a sort; an input that is costly to compute is best materialised before.
    """
    images = [as_long(c, df.schema[c].dataType) for c in order]
    if any(image is None for image in images):
        raise TypeError("order columns must be integers, dates or timestamps")
    images = [F.coalesce(image, F.lit((1 << 63) - 1)) for image in images]
    rest, cut = df, []
    while len(cut) < len(images):
        image = images[len(cut)]
        low, high, n = rest.agg(F.min(image), F.max(image), F.count(F.lit(1))).first()
        if k >= n:
            return F.lit(False)
        while low < high and n > _FEW:
            width = -(-(high - low + 1) // _CELLS)
            for row in _cell_counts(rest, image, low, width):
                if k < row.n:
                    low, high, n = low + row.cell * width, min(high, low + (row.cell + 1) * width - 1), row.n
                    break
                k -= row.n
            rest = rest.filter((image >= F.lit(low)) & (image <= F.lit(high)))
        if n <= _FEW:
            left = images[len(cut):]
            few = rest.select(*[c.alias(f"v{at}") for at, c in enumerate(left)]).collect()
            cut += sorted(tuple(r) for r in few)[k]
        else:
            cut.append(low)
    later = images[-1] >= F.lit(cut[-1])
    for image, value in reversed(list(zip(images, cut))[:-1]):
        later = (image > F.lit(value)) | ((image == F.lit(value)) & later)
    return later


# ---------------------------------------------------------------- ranks in hash order

def hash_rank(df: DataFrame, draw: str, tie: str, by: Sequence[str] = (), name: str = "rank") -> DataFrame:
    """Dense 0-based rank by a 64-bit hash column inside each group.

    A hash is uniform, so 65,536 equal slices of its range hold equal shares of any group: the windows
    stay small, and the table of slice offsets is bounded by slices times groups.
    """
    cut = df.withColumn("_slice", F.shiftright(draw, 48))
    counts = cut.groupBy(*by, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*by).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    keys = ["_slice", *by]
    offsets = counts.select(
        *[F.col(c).alias(f"_k{n}") for n, c in enumerate(keys)],
        F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
    )
    inside = Window.partitionBy(*keys).orderBy(draw, tie)
    matched = [F.col(c).eqNullSafe(F.col(f"_k{n}")) for n, c in enumerate(keys)]
    return cut.withColumn("_in", F.row_number().over(inside) - 1).join(offsets, matched).select(
        *df.columns, (F.col("_before") + F.col("_in")).alias(name)
    )
