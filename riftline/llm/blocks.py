"""Texts of an Arrow batch as flat numpy arrays.

A block is a run of rows whose texts hold at most ``BLOCK_BYTES`` bytes together (one row alone may be larger, as
texts are always taken whole). All arrays of a task belong to one block, so memory follows the block and the longest
text, never the partition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 4 << 20

# White space of the word pattern: 0x20 and 0x09 to 0x0D. All are single bytes in UTF-8.
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every input bit over the whole word."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


_POWERS = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** (n - 1), modulo 2 ** 64; kept for the task."""
    held = _POWERS.get(base)
    if held is None or len(held) < n:
        size = max(n, 1 << 16)
        held = np.full(size, base, dtype=np.uint64)
        held[0] = 1
        held = np.cumprod(held, dtype=np.uint64)
        if size <= 1 << 24:
            _POWERS[base] = held
    return held[:n]


class Block:
    """``size`` rows: text ``i`` is ``data[at[i]:at[i + 1]]`` as UTF-8 bytes."""

    def __init__(self, texts: pa.Array):
        flat = texts.cast(pa.large_binary()).fill_null(b"")
        self.size = len(flat)
        at = np.frombuffer(flat.buffers()[1], dtype=np.int64)[flat.offset:flat.offset + self.size + 1]
        data = flat.buffers()[2]
        whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
        self.data = whole[at[0]:at[-1]]
        self.at = at - at[0]

    def text(self, i: int) -> bytes:
        return self.data[self.at[i]:self.at[i + 1]].tobytes()


class Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a block: word ``k`` is ``data[start[k]:end[k]]``, row ``i`` has the words
    ``first[i]`` to ``first[i + 1] - 1``."""

    def __init__(self, block: Block):
        self.block = block
        n = len(block.data)
        gap = np.ones(n + 1, dtype=bool)
        np.take(SPACE, block.data, out=gap[:n])
        inside = ~gap[:n]
        begins = np.zeros(n + 1, dtype=bool)
        begins[block.at] = True
        before = np.ones(n, dtype=bool)
        before[1:] = gap[:n - 1]
        self.start = np.flatnonzero(inside & (before | begins[:n]))
        self.end = np.flatnonzero(inside & (gap[1:] | begins[1:])) + 1
        self.first = np.searchsorted(self.start, block.at)
        self.inside = inside

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash per word; equal words have equal hashes."""
        if not len(self.start):
            return np.zeros(0, dtype=np.uint64)
        length = self.end - self.start
        size = len(self.block.data)
        place = np.zeros(size, dtype=np.int64)
        lead = self.start[0]
        place[lead:] = np.arange(lead, size) - np.repeat(self.start, np.diff(np.append(self.start, size)))
        np.minimum(place, int(length.max()), out=place)
        value = (self.block.data.astype(np.uint64) + np.uint64(1)) * powers(0x100000001B3, int(length.max()) + 1)[place]
        value[~self.inside] = 0
        total = np.add.reduceat(value, self.start)
        return mix(total + length.astype(np.uint64) * _ODD)


def rolling(values: np.ndarray, width: int, base: int = 0x5851F42D4C957F2D) -> np.ndarray:
    """A hash of each run of ``width`` neighbours, as a polynomial modulo 2 ** 64, then mixed."""
    n = len(values) - width + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(values * powers(base, len(values)), dtype=np.uint64, out=total[1:])
    return mix((total[width:] - total[:n]) * powers(pow(base, -1, 1 << 64), n))


def blocks(batch: pa.RecordBatch, column: str, budget: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, Block]]:
    """The rows of a batch in order, cut into blocks."""
    place = batch.schema.get_field_index(column)
    if not batch.num_rows:
        return
    texts = batch.column(place).cast(pa.large_binary()).fill_null(b"")
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset:texts.offset + len(texts) + 1]
    low = 0
    while low < len(texts):
        high = max(low + 1, int(np.searchsorted(at, at[low] + budget, side="right")) - 1)
        part = batch.slice(low, high - low)
        yield part, Block(part.column(place))
        low = high
