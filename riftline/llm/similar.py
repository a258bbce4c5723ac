"""Near-duplicates by the Jaccard similarity of their sets of word shingles, verified exactly.

Each different set gets ``BANDS`` cells, each named by ``ROWS`` minima of its shingles; a pair of similarity s shares none
with odds (1 - s ** 4) ** 32, which is below one in 20 million for s = 0.8. Whatever shares a cell is only a candidate:
every link is counted on the sets themselves. A large cell is first tied together by links to one member and to the
neighbour in an order of its own; what is still apart after that is compared pair by pair, so no candidate is left out.

Defined cases: words are those of ``simhash``, in lower case; a text of fewer words than a shingle is one shingle; texts
without words are alike; shingles are known by a 64-bit hash.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riftline.llm.blocks import Block, Words, blocks, mix, rolling
from riftline.llm.shared import stored
from riftline.llm.simhash import components, first_of_each, row_hash

SHINGLE = 5
SHARE = (4, 5)  # the similarity asked for, 0.8
BANDS = 32
ROWS = 4
FIRST_BANDS = 4  # enough to tie most of a large group together
SKETCH = 512
SKETCH_COLS = [f"s{k}" for k in range(SKETCH // 64)]
NAMED_SETS = 1_000_000  # sets up to this number are broadcast by name

_ODD = np.random.default_rng(41).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(block: Block, width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the different shingles of each row, sorted within the row, and where each row begins."""
    low = block.data.copy()
    low[(low >= 65) & (low <= 90)] += 32
    block.data = low
    words = Words(block)
    counts, hashes = words.counts, words.hashes()
    parts = [(np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64))]
    for w in range(1, width):
        rows = np.flatnonzero(counts == w)
        parts.append((mix(rolling(hashes, w)[words.first[rows]] + np.uint64(w)) if len(rows) else parts[0][0], rows))
    many = np.maximum(counts - width + 1, 0)
    rows = np.repeat(np.arange(block.size), many)
    at = np.arange(len(rows)) + np.repeat(words.first[:-1] - np.cumsum(many) + many, many)
    parts.append((rolling(hashes, width)[at] if len(at) else parts[0][0], rows))
    value, row = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    fresh = np.ones(len(row), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (row[1:] != row[:-1])
    value, row = value[fresh], row[fresh]
    return value, np.searchsorted(row, np.arange(block.size + 1))


def set_names(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A 64-bit name per set; equal sets have equal names."""
    size = np.diff(first)
    total = np.zeros(len(size), dtype=np.uint64)
    used = size > 0
    if used.any():
        total[used] = np.add.reduceat(mix(value ^ np.uint64(0x2545F4914F6CDD1D)), first[:-1][used])
    return mix(total + size.astype(np.uint64)).view(np.int64)


def sketches(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """512 bits per set, each the parity of the shingles that fall on it: two sets differ in at least as many shingles
    as their sketches in bits."""
    rows = len(first) - 1
    place = np.repeat(np.arange(rows), np.diff(first)) * SKETCH + (value >> np.uint64(55)).astype(np.int64)
    odd = (np.bincount(place, minlength=rows * SKETCH) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(rows, SKETCH // 64)


def cells_of(value: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The cells of each set that is not empty, a row per set and a column per band."""
    starts = first[:-1][np.diff(first) > 0]
    out = np.empty((len(starts), BANDS), dtype=np.uint64)
    for band in range(BANDS):
        name = np.full(len(starts), band + 1, dtype=np.uint64)
        for odd in _ODD[band * ROWS:(band + 1) * ROWS]:
            name = mix(name ^ np.minimum.reduceat(value * odd, starts)) if len(starts) else name
        out[:, band] = name
    return out.view(np.int64)


def _over(docs: DataFrame, make, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: set[int] = set()
        for batch in batches:
            for part, block in blocks(batch, "text"):
                yield make(part, *shingle_sets(block), state)

    return docs.select("doc_id", "text", row_hash().alias("rid")).mapInArrow(run, schema)


def marked(docs: DataFrame) -> DataFrame:
    """doc_id, rid (a hash of doc_id and text) and the name of the set, one row per document."""

    def make(part, value, first, _):
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id").cast(pa.int64()), part.column("rid"), pa.array(set_names(value, first))], names=["doc_id", "rid", "name"]
        )

    return _over(docs, make, "doc_id long, rid long, name long")


def _new(names: np.ndarray, state: set[int]) -> np.ndarray:
    """Places of names this task has not sent yet: copies of a text meet elsewhere once per task, not once per copy."""
    at = []
    for i, name in enumerate(names.tolist()):
        if name not in state:
            state.add(name)
            at.append(i)
    return np.array(at, dtype=np.int64)


def members(docs: DataFrame) -> DataFrame:
    """cell, band, name and size of the sets in every cell that holds two sets or more."""

    def make(part, value, first, state):
        used = np.flatnonzero(np.diff(first) > 0)
        names, size, cells = set_names(value, first)[used], np.diff(first)[used], cells_of(value, first)
        at = _new(names, state)
        return pa.RecordBatch.from_arrays([
            pa.array(cells[at].ravel()), pa.array(np.tile(np.arange(BANDS, dtype=np.int32), len(at))),
            pa.array(np.repeat(names[at], BANDS)), pa.array(np.repeat(size[at], BANDS)),
        ], names=["cell", "band", "name", "size"])

    placed = _over(docs, make, "cell long, band int, name long, size long").repartition("cell").dropDuplicates(["cell", "name"])
    whole = Window.partitionBy("cell")
    return placed.withColumn("_n", F.count(F.lit(1)).over(whole)).filter("_n > 1").drop("_n")


def sets(docs: DataFrame, names: DataFrame) -> DataFrame:
    """The shingles and the sketch of the sets named."""

    def make(part, value, first, state):
        found = set_names(value, first)
        at = _new(found, state)
        lists = pa.ListArray.from_arrays(pa.array(first, type=pa.int32()), pa.array(value.view(np.int64))).take(pa.array(at))
        bits = sketches(value, first)[at]
        return pa.RecordBatch.from_arrays(
            [pa.array(found[at]), lists, *[pa.array(np.ascontiguousarray(b)) for b in bits.T]], names=["name", "shingles", *SKETCH_COLS]
        )

    few = names.count() <= NAMED_SETS
    made = _over(docs, make, "name long, shingles array<long>, " + ", ".join(f"{c} long" for c in SKETCH_COLS))
    return made.join(F.broadcast(names) if few else names, "name", "left_semi").dropDuplicates(["name"])


def similar(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (u, v) whose sets are as similar as asked, counted exactly."""
    one = known.select(F.col("name").alias("u"), F.col("shingles").alias("_a"))
    two = known.select(F.col("name").alias("v"), F.col("shingles").alias("_b"))
    both = F.size(F.array_intersect("_a", "_b"))
    enough = both * SHARE[1] >= (F.size("_a") + F.size("_b") - both) * SHARE[0]
    return pairs.join(one, "u").join(two, "v").filter(enough).select("u", "v")


def _pair(a: Column, b: Column) -> list[Column]:
    return [F.greatest(a, b).alias("u"), F.least(a, b).alias("v")]


MEMBER = ["name", "size", "root", *SKETCH_COLS]


def _may_be(a: Callable[[str], Column], b: Callable[[str], Column]) -> Column:
    """False only for pairs that cannot be similar: a pair that is differs in at most a ninth of both sizes together."""
    bits = sum((F.bit_count(a(c).bitwiseXOR(b(c))) for c in SKETCH_COLS), F.lit(0))
    sizes = F.least(a("size"), b("size")) * SHARE[1] >= F.greatest(a("size"), b("size")) * SHARE[0]
    return sizes & (bits * (SHARE[0] + SHARE[1]) <= (a("size") + b("size")) * (SHARE[1] - SHARE[0]))


def _ties(placed: DataFrame) -> DataFrame:
    """Of each cell the pairs of every member with the first one and with the one before it, in an order of the cell's own."""
    order = Window.partitionBy("cell").orderBy(F.xxhash64("cell", "name"))
    ordered = placed.withColumn("_me", F.struct(*MEMBER)).withColumns(
        {"_first": F.first("_me").over(order), "_before": F.lag("_me").over(order)}
    )
    met = ordered.select(*MEMBER, F.explode(F.array("_first", "_before")).alias("o")).filter(
        F.col("o").isNotNull() & (F.col("root") != F.col("o.root")) & _may_be(F.col, lambda c: F.col(f"o.{c}"))
    )
    return met.select(*_pair(F.col("name"), F.col("o.name"))).distinct()


def _apart(placed: DataFrame) -> DataFrame:
    """All pairs of members of a cell that no chain of links connects yet."""
    a = placed.select("cell", *[F.col(c).alias(f"_{c}1") for c in MEMBER])
    b = placed.select("cell", *[F.col(c).alias(f"_{c}2") for c in MEMBER])
    met = a.join(b, "cell").filter((F.col("_root1") > F.col("_root2")) & _may_be(lambda c: F.col(f"_{c}1"), lambda c: F.col(f"_{c}2")))
    return met.select(*_pair(F.col("_name1"), F.col("_name2"))).distinct()


def links(docs: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of names of similar sets, enough to connect all that are linked."""
    held = stored(members(docs), "similar-cells")
    known = stored(sets(docs, held.select("name").distinct()), "similar-sets")
    held = stored(held.join(known.drop("shingles"), "name"), "similar-members")
    placed = held.withColumn("root", F.col("name"))
    found = stored(similar(_ties(placed.filter(F.col("band") < FIRST_BANDS)), known), "similar-links")
    for pairs in (_ties, _apart):
        roots = components(found).withColumnRenamed("node", "name")
        placed = held.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
        found = stored(found.union(similar(pairs(placed), known)), "similar-links")
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """Of each group linked by similarity the document with the smallest doc_id, all columns as they were."""
    marks = stored(marked(docs), "similar")
    roots = components(links(docs))
    rooted = marks.select("name").distinct().join(roots, F.col("name") == F.col("node"), "left").select("name", F.coalesce("root", "name").alias("root"))
    return first_of_each(docs, marks, rooted, "name")
