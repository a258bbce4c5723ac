"""SimHash near-duplicates (operator 9): fingerprints, links by a segment-popcount embedding, components.

A 64-bit fingerprint becomes 32 coordinates: the number of set bits in each pair of neighbouring bits. Their Manhattan
distance is at most the number of differing bits, so fingerprints within ``BITS`` = 4 bits are within 4 steps on this
grid. Cut into eight blocks of four coordinates, two such points agree exactly in at least four blocks: each point enters
the 70 cells named by four of its blocks, the cells are joined by an exchange, and inside a cell the full Manhattan
distance is tested first, then the differing bits. Equal fingerprints are one point throughout, and a large cell yields a
spanning forest of its links, never all pairs.

Defined cases: a null text counts as empty; a text without words has the fingerprint zero and is linked like any other;
repeated rows and ties share a fingerprint and so a component; a null doc_id never names a component unless no other
doc_id is in it; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.blocks import Words, blocks
from riftline.llm.shared import stored
from riftline.session import freeze

SHINGLE = 4
BITS = 4
SEED = 42
EVEN = 0x5555555555555555
_PAIRWISE = 8  # runs up to this size are compared place by place


def fingerprints_of(words: Words) -> np.ndarray:
    """One unsigned 64-bit fingerprint per row of the block."""
    block = words.block
    counts = words.counts
    out = np.zeros(block.size, dtype=np.uint64)
    if not len(words.start):
        return out
    low = block.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    # Words joined by one space: of each gap inside a row only its first byte stays, as a space.
    keep = words.inside.copy()
    last = np.zeros(len(words.start), dtype=bool)
    last[words.first[1:][counts > 0] - 1] = True
    gaps = words.end[~last]
    keep[gaps] = True
    low[gaps] = 0x20
    raw = low[keep].tobytes()
    moved = np.concatenate([[0], np.cumsum(keep)])
    start, end = moved[words.start], moved[words.end]
    shingles = np.where(counts >= SHINGLE, counts - SHINGLE + 1, np.minimum(counts, 1))
    used = counts > 0
    begins = np.concatenate([[0], np.cumsum(shingles)])
    at = np.arange(begins[-1]) + np.repeat(words.first[:-1] - begins[:-1], shingles)
    stop = at + np.repeat(np.minimum(counts, SHINGLE) - 1, shingles)
    digest = xxhash.xxh64_intdigest
    hashes = [digest(raw[a:b], SEED) for a, b in zip(start[at].tolist(), end[stop].tolist(), strict=True)]
    bits = np.unpackbits(np.array(hashes, dtype=">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.add.reduceat(bits, begins[:-1][used], axis=0, dtype=np.int32)
    majority = 2 * total > shingles[used][:, None]
    out[used] = np.packbits(majority, axis=1).view(">u8").ravel().astype(np.uint64)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, rid (a hash of doc_id and text) and the fingerprint as a signed long, one row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                marks = fingerprints_of(Words(block)).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), part.column("rid"), pa.array(marks)], names=["doc_id", "rid", "fp"]
                )

    return docs.select("doc_id", "text", row_hash().alias("rid")).mapInArrow(run, "doc_id long, rid long, fp long")


def row_hash() -> Column:
    return F.xxhash64("doc_id", F.coalesce("text", F.lit("")))


def embed(fp: np.ndarray) -> np.ndarray:
    """32 coordinates of 0 to 2, packed in two bits each."""
    fp = fp.view(np.uint64)
    return (fp & np.uint64(EVEN)) + ((fp >> np.uint64(1)) & np.uint64(EVEN))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def cells(points: DataFrame) -> DataFrame:
    """The grid cells of each fingerprint: four of eight blocks of coordinates, as one hash (equal cells meet; that
    unequal ones may meet too costs only a comparison)."""
    one, other = F.col("fp").bitwiseAND(F.lit(EVEN)), F.shiftrightunsigned("fp", 1).bitwiseAND(F.lit(EVEN))
    grid = F.shiftleft(one.bitwiseAND(other), 1).bitwiseOR(one.bitwiseXOR(other))
    masks = [_signed(sum(0xFF << (8 * b) for b in some)) for some in combinations(range(8), 8 - BITS)]
    spread = points.select("fp", grid.alias("grid"), F.explode(F.array(*[F.lit(m) for m in masks])).alias("mask"))
    return spread.select(F.xxhash64("mask", F.col("grid").bitwiseAND(F.col("mask"))).alias("cell"), "fp")


def _near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether fingerprints are within BITS bits; the grid distance rules most out."""
    x, y = embed(a), embed(b)
    # |x - y| per coordinate: both are 0 to 2, so the differing bits of the packed values give the distance.
    high, low = (x ^ y) >> np.uint64(1) & np.uint64(EVEN), (x ^ y) & np.uint64(EVEN)
    # 0/1 and 1/2 differ by one (the low bit differs), 0/2 by two (only the high bit differs).
    steps = np.bitwise_count(low).astype(np.int64) + 2 * np.bitwise_count(high & ~low).astype(np.int64)
    close = steps <= BITS
    if close.any():
        at = np.flatnonzero(close)
        close[at] = np.bitwise_count(a[at].view(np.uint64) ^ b[at].view(np.uint64)) <= BITS
    return close


def _forest(fp: np.ndarray) -> tuple[list[int], list[int]]:
    """Links that connect a large cell as all its links would: each point reached is compared with the rest once."""
    left, right = [], []
    rest = fp.copy()
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            point = queue.pop()
            hit = _near(np.full(len(rest), point), rest)
            if hit.any():
                found = rest[hit]
                left += [int(point)] * len(found)
                right += found.tolist()
                queue += list(found)
                rest = rest[~hit]
    return left, right


def cell_links(cell: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of equal cells; rows are sorted by cell."""
    edge = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1], [True]]))
    size = np.diff(edge)
    length = np.repeat(size, size)
    left, right = [], []
    for lag in range(1, _PAIRWISE):
        at = np.flatnonzero((cell[lag:] == cell[:-lag]) & (length[lag:] <= _PAIRWISE)) if len(cell) > lag else np.zeros(0, dtype=np.int64)
        if len(at):
            at = at[_near(fp[at], fp[at + lag])]
            left.append(fp[at])
            right.append(fp[at + lag])
    for k in np.flatnonzero(size > _PAIRWISE):
        a, b = _forest(np.unique(fp[edge[k]:edge[k + 1]]))
        left.append(np.array(a, dtype=np.int64))
        right.append(np.array(b, dtype=np.int64))
    if not left:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    left, right = np.concatenate(left), np.concatenate(right)
    apart = left != right
    return left[apart], right[apart]


def links(points: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of different fingerprints within BITS bits, enough to connect all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_cell, held_fp = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)

        def flush(cell, fp):
            u, v = cell_links(cell, fp)
            pairs = np.unique(np.column_stack([np.maximum(u, v), np.minimum(u, v)]), axis=0) if len(u) else np.zeros((0, 2), dtype=np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

        for batch in batches:
            cell = np.concatenate([held_cell, batch.column("cell").to_numpy()])
            fp = np.concatenate([held_fp, batch.column("fp").to_numpy()])
            if not len(cell):
                continue
            # the last cell may go on in the next batch
            cut = int(np.searchsorted(cell, cell[-1]))
            held_cell, held_fp = cell[cut:], fp[cut:]
            if cut:
                yield flush(cell[:cut], fp[:cut])
        if len(held_cell):
            yield flush(held_cell, held_fp)

    placed = cells(points).repartition("cell").sortWithinPartitions("cell")
    return placed.mapInArrow(run, "u long, v long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the links, root being the smallest node reachable.

    Large-star and small-star steps in turn until the links stand still; each round is checkpointed.
    """

    def mark(pairs):
        return pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    pairs = freeze(edges.select("u", "v"))
    seen = mark(pairs)
    while True:
        both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        wide = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = wide.groupBy("u").agg(F.min("v").alias("m"))
        small = wide.join(low, "u").select(F.explode(F.array(
            F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")),
        )).alias("p")).select("p.u", "p.v").filter("u > v").distinct()
        pairs = freeze(small)
        now = mark(pairs)
        if now == seen:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = now


def _rooted(marks: DataFrame) -> DataFrame:
    """(fp, low, root) of each different fingerprint, low being its smallest doc_id."""
    points = marks.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = components(links(points.select("fp")))
    return points.join(roots, points["fp"] == roots["node"], "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp and component_id, the smallest doc_id reachable by links, one row per document."""
    marks = stored(fingerprints(docs), "simhash")
    placed = _rooted(marks)
    least = placed.groupBy("root").agg(F.min("low").alias("component_id"))
    named = placed.join(least, "root").select(F.col("fp").alias("_fp"), "component_id")
    return marks.join(named, marks["fp"] == named["_fp"]).select("doc_id", "fp", "component_id")


def first_of_each(docs: DataFrame, marks: DataFrame, rooted: DataFrame, name: str) -> DataFrame:
    """Of each root the document with the smallest doc_id (then the smallest row hash), all columns as they were; of rows
    that repeat it one. ``marks`` has doc_id, rid and ``name`` per document, ``rooted`` a row per ``name``."""
    placed = rooted.select(F.col(name).alias("_name"), "root")
    first = marks.join(placed, F.col(name) == F.col("_name")).groupBy("root").agg(
        F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("first")
    )
    chosen = first.select(F.col("first.rid").alias("_chosen"))
    # the document travels as one column, so that no name of it can clash
    held = docs.select(row_hash().alias("_rid"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
    kept = held.join(chosen, F.col("_rid") == F.col("_chosen"), "left_semi")
    return kept.dropDuplicates(["_rid"]).select("_doc.*")


def one_of_each(docs: DataFrame) -> DataFrame:
    """One document of each component, see ``first_of_each``."""
    marks = stored(fingerprints(docs), "simhash")
    return first_of_each(docs, marks, _rooted(marks), "fp")
