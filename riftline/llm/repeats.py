"""Repeated windows of a fixed number of tokens, found by minimiser partitioning.

The minimiser of a window is its gram of ``gram`` tokens with the smallest hash (leftmost of equal ones). Consecutive
windows with the same minimiser form a super-k-mer. Equal windows have equal minimisers, so:

1. every super-k-mer is listed as (hash of its minimiser, 64-bit hash of its content, row, first window, windows);
2. a minimiser that occurs once in the corpus repeats nothing, and its super-k-mers go no further;
3. super-k-mers with equal minimiser and content are copies: all their windows repeat. Counting them is an aggregate that
   combines before the shuffle, so thousands of copies of a text cost one row per task;
4. of different contents under one minimiser, one occurrence each travels as a packed string to the minimiser's bucket,
   where the exact comparison of the calling operator marks the windows that occur twice;
5. a minimiser with more than ``hot`` different contents (a line that every other text quotes) is cut up instead: its
   windows are counted one by one under 128-bit hashes, which spreads it over all tasks.

Rows are known by ``rid``, a hash of doc_id and text, so repeated rows count as two places and get one answer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.llm.blocks import Block, Words, blocks, mix, powers, rolling
from riftline.llm.shared import stored

_CONTENT, _OTHER = 0x2545F4914F6CDD1D, 0xD1342543DE82EF95
_LOW = np.uint64(0xFFFFFFFF)
BLOCK_BYTES = 512 << 10  # a byte is a token, and some fifteen arrays of 8 bytes a token are held at once: some 60 MB


@dataclass(frozen=True)
class Unit:
    """What a token is: how a block becomes token values, and the tokens of rows.

    ``tokens(block)`` gives (value per token, first token of each row, byte at which each token begins, and ends).
    """

    name: str
    width: int
    gram: int

    def tokens(self, block: Block):
        if self.name == "words":
            held = Words(block)
            return held.hashes(), held.first, held.start, held.end
        n = len(block.data)
        places = np.arange(n)
        return block.data.astype(np.uint64) + np.uint64(1), block.at, places, places + 1

    def pack(self, block: Block, start: np.ndarray, end: np.ndarray, low: int, high: int) -> bytes:
        """Tokens low to high - 1 as one string."""
        if self.name == "bytes":
            return block.data[low:high].tobytes()
        return b" ".join([block.data[a:b].tobytes() for a, b in zip(start[low:high].tolist(), end[low:high].tolist(), strict=True)])


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    n, size, low = len(a) - width + 1, 1, a
    if n <= 0:
        return a[:0]
    while size * 2 <= width:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    return low[:n] if size == width else np.minimum(low[:n], low[width - size:width - size + n])


def span_hash(values: np.ndarray, low: np.ndarray, high: np.ndarray, base: int) -> np.ndarray:
    """A hash of the values low to high - 1 of each span, its length included."""
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=total[1:])
    back = powers(pow(base, -1, 1 << 64), len(values) + 1)
    return mix((total[high] - total[low]) * back[low] + (high - low).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def super_kmers(values: np.ndarray, first: np.ndarray, width: int, gram: int):
    """(row, first window within the row, windows, minimiser hash, content hash) of all super-k-mers."""
    n = len(values) - width + 1
    none = np.zeros(0, dtype=np.int64)
    if n <= 0:
        return none, none, none, none, none
    hashes = rolling(values, gram)
    marked = (hashes & ~_LOW) | np.arange(len(hashes), dtype=np.uint64)
    place = (sliding_min(marked, width - gram + 1) & _LOW).astype(np.int64)
    inside = np.zeros(n + 1, dtype=np.int64)  # windows that end within their row
    windows = np.maximum(np.diff(first) - width + 1, 0)
    some = windows > 0
    np.add.at(inside, first[:-1][some], 1)
    np.add.at(inside, first[:-1][some] + windows[some], -1)
    valid = np.cumsum(inside[:n]) > 0
    edge = np.zeros(n + 1, dtype=bool)
    edge[0] = edge[n] = True
    edge[1:n] = (valid[1:] != valid[:-1]) | (place[1:] != place[:-1])
    edge[first[:-1][some]] = True
    cuts = np.flatnonzero(edge)
    start, size = cuts[:-1], np.diff(cuts)
    keep = valid[start]
    start, size = start[keep], size[keep]
    row = np.searchsorted(first, start, side="right") - 1
    content = span_hash(values, start, start + size + width - 1, _CONTENT)
    return row, start - first[row], size, hashes[place[start]].view(np.int64), content.view(np.int64)


LISTED = "rid long, key long, content long, start int, windows int"


def list_super_kmers(rows: DataFrame, unit: Unit) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text", BLOCK_BYTES):
                values, first, _, _ = unit.tokens(block)
                row, start, size, key, content = super_kmers(values, first, unit.width, unit.gram)
                yield pa.RecordBatch.from_arrays([
                    part.column("rid").take(pa.array(row)), pa.array(key), pa.array(content),
                    pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32)),
                ], names=["rid", "key", "content", "start", "windows"])

    return rows.mapInArrow(run, LISTED)


def _wanted(batches: Iterator[pa.RecordBatch], unit: Unit):
    """Per block: the block's tokens and, row by row, the super-k-mers asked for (as columns)."""
    for batch in batches:
        for part, block in blocks(batch, "text", BLOCK_BYTES):
            values, first, start, end = unit.tokens(block)
            asked = part.column("asked")
            sizes = np.diff(np.asarray(asked.offsets.to_numpy()))
            flat = asked.flatten()
            row = np.repeat(np.arange(len(part)), sizes)
            yield part, block, values, first, start, end, row, {f: flat.field(f).to_numpy() for f in ("key", "start", "windows", "copies")} | {
                "hot": flat.field("hot").to_numpy(zero_copy_only=False)
            }


CUT = "rid long, key long, start int, copies long, packed binary, one long, two long"


def cut(joined: DataFrame, unit: Unit) -> DataFrame:
    """The super-k-mers asked for: packed strings, or, where ``hot``, their windows one by one under two 64-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, values, first, start, end, row, asked in _wanted(batches, unit):
            hot = asked["hot"].astype(bool)
            rid = part.column("rid")
            for chosen, split in ((~hot, False), (hot, True)):
                if not chosen.any():
                    continue
                place, held = row[chosen], {name: values_[chosen] for name, values_ in asked.items()}
                low, size = first[place] + held["start"], held["windows"].astype(np.int64)
                if split:
                    ends = np.cumsum(size)
                    step = np.arange(ends[-1]) - np.repeat(ends - size, size)
                    at = np.repeat(low, size) + step
                    place, starts = np.repeat(place, size), np.repeat(held["start"], size) + step
                    copies, key = np.repeat(held["copies"], size), np.repeat(held["key"], size)
                    packed = pa.nulls(len(at), pa.binary())
                    one = pa.array(span_hash(values, at, at + unit.width, _CONTENT).view(np.int64))
                    two = pa.array(span_hash(values, at, at + unit.width, _OTHER).view(np.int64))
                else:
                    starts, copies, key = held["start"], held["copies"], held["key"]
                    high = low + size + unit.width - 1
                    packed = pa.array([unit.pack(block, start, end, a, b) for a, b in zip(low.tolist(), high.tolist(), strict=True)], pa.binary())
                    one = two = pa.nulls(len(place), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [rid.take(pa.array(place)), pa.array(key), pa.array(starts.astype(np.int32)), pa.array(copies), packed, one, two],
                    names=["rid", "key", "start", "copies", "packed", "one", "two"],
                )

    return joined.mapInArrow(run, CUT)


Compare = Callable[[list[bytes]], list[np.ndarray]]


def compare_buckets(strings: DataFrame, compare: Compare, chunk_bytes: int) -> DataFrame:
    """Marks (rid, low, high) of repeated windows, from strings that share a minimiser; copies are marked already."""

    def marks(rid, start, copies, packed):
        flags = compare(packed)
        out_rid, out_low, out_high = [], [], []
        for r, s, n, flag in zip(rid, start, copies, flags, strict=True):
            if n > 1 or not flag.any():
                continue
            turn = np.flatnonzero(np.diff(np.concatenate([[False], flag, [False]]).astype(np.int8)))
            out_rid += [r] * (len(turn) // 2)
            out_low += (s + turn[::2]).tolist()
            out_high += (s + turn[1::2] - 1).tolist()
        return pa.RecordBatch.from_arrays(
            [pa.array(out_rid, pa.int64()), pa.array(out_low, pa.int32()), pa.array(out_high, pa.int32())], names=["rid", "low", "high"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = ([], [], [], [])
        size, last = 0, None
        for batch in batches:
            keys = batch.column("key").to_pylist()
            for key, *values in zip(keys, *[batch.column(c).to_pylist() for c in ("rid", "start", "copies", "packed")], strict=True):
                if key != last and size >= chunk_bytes:  # a minimiser is never cut
                    yield marks(*held)
                    held, size = ([], [], [], []), 0
                for column, value in zip(held, values, strict=True):
                    column.append(value)
                size += len(values[-1])
                last = key
        if held[0]:
            yield marks(*held)

    return strings.repartition("key").sortWithinPartitions("key").mapInArrow(run, "rid long, low int, high int")


def repeated_windows(rows: DataFrame, unit: Unit, compare: Compare, *, chunk_bytes: int, hot: int) -> DataFrame:
    """Per row (``rid``): ``marks``, the runs of windows that occur twice or more in the corpus, as (low, high)."""
    listed = stored(list_super_kmers(rows, unit), f"{unit.name}_listed")
    # Written first, so that the join reads two plain exchanges and a frequent minimiser can be split.
    keys = listed.groupBy("key").agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(F.col("key").alias("_key"))
    keys = stored(keys, f"{unit.name}_repeated")
    shared = stored(listed.join(keys, F.col("key") == F.col("_key"), "left_semi"), f"{unit.name}_shared")
    contents = shared.groupBy("key", "content").agg(
        F.count(F.lit(1)).alias("copies"), F.first("rid").alias("rid"), F.first("start").alias("start"), F.first("windows").alias("windows")
    )
    contents = stored(contents, f"{unit.name}_contents")
    several = contents.groupBy("key").agg(F.count(F.lit(1)).alias("contents")).filter("contents > 1")
    several = stored(several.select(F.col("key").alias("_key"), "contents"), f"{unit.name}_keys")
    copied = contents.filter("copies > 1").select(F.col("key").alias("_key"), F.col("content").alias("_content"))
    of_copies = shared.join(
        copied, (F.col("key") == F.col("_key")) & (F.col("content") == F.col("_content")), "left_semi"
    ).select("rid", F.col("start").alias("low"), (F.col("start") + F.col("windows") - 1).alias("high"))

    # The texts meet what is asked of them once; strings and windows are written, so either can be read by itself.
    wanted = contents.join(several, F.col("key") == F.col("_key")).groupBy(F.col("rid").alias("_rid")).agg(
        F.collect_list(F.struct("key", "start", "windows", "copies", (F.col("contents") > hot).alias("hot"))).alias("asked")
    )
    pieces = stored(cut(rows.join(wanted, F.col("rid") == F.col("_rid")).select("rid", "text", "asked"), unit), f"{unit.name}_pieces")
    strings = pieces.filter("packed IS NOT NULL").select("rid", "key", "start", "copies", "packed")
    single = pieces.filter("packed IS NULL").select("rid", "one", "two", "start", "copies")
    twice = single.groupBy("one", "two").agg(F.sum("copies").alias("_n")).filter("_n > 1")
    twice = twice.select(F.col("one").alias("_one"), F.col("two").alias("_two"))
    of_windows = single.join(
        twice, (F.col("one") == F.col("_one")) & (F.col("two") == F.col("_two")), "left_semi"
    ).select("rid", F.col("start").alias("low"), F.col("start").alias("high"))
    parts = of_copies.union(compare_buckets(strings, compare, chunk_bytes)).union(of_windows)
    return parts.groupBy(F.col("rid").alias("_rid")).agg(F.collect_list(F.struct("low", "high")).alias("marks"))


def known_rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(F.xxhash64("doc_id", text).alias("rid"), "doc_id", text.alias("text"))


def covered(size: int, lows: np.ndarray, highs: np.ndarray, width: int) -> np.ndarray:
    """Which of ``size`` tokens lie in a marked window."""
    turns = np.zeros(size + 1, dtype=np.int64)
    np.add.at(turns, lows, 1)
    np.add.at(turns, highs + width, -1)
    return np.cumsum(turns[:size]) > 0


def with_marks(rows: DataFrame, marks: DataFrame) -> DataFrame:
    return rows.join(marks, F.col("rid") == F.col("_rid"), "left").select("rid", "doc_id", "text", "marks")


def marked_rows(batches: Iterator[pa.RecordBatch]):
    """(part, block, per row the low and high of its marks) of a table with marks."""
    for batch in batches:
        for part, block in blocks(batch, "text", BLOCK_BYTES):
            column = part.column("marks")
            at = np.asarray(column.offsets.to_numpy())
            flat = column.flatten()
            base = at[0]
            low, high = flat.field("low").to_numpy(), flat.field("high").to_numpy()
            null = column.is_null().to_numpy(zero_copy_only=False)
            yield part, block, [
                (low[:0], high[:0]) if null[i] else (low[at[i] - base:at[i + 1] - base], high[at[i] - base:at[i + 1] - base])
                for i in range(len(part))
            ]
