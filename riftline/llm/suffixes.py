"""Suffix-array dedup (operator 4): bytes covered by a string of 200 bytes that also starts elsewhere are removed.

The corpus is partitioned by byte minimisers (see ``repeats``). In a bucket the packed strings, each with an end mark of
its own, get a suffix array; on its Burrows-Wheeler transform intervals are extended backward breadth first, which gives
the common prefixes of neighbouring suffixes in increasing value. The expansion stops at 200: neighbours whose common
prefix is then still unknown share 200 bytes or more.

Defined cases: a null text counts as empty; a text of fewer than 200 bytes keeps all; a repeated row is a second place, so
its bytes go in both; matches never cross texts, and strings are judged on the input; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from riftline.llm.repeats import Unit, covered, known_rows, marked_rows, repeated_windows, with_marks

LEAST = 200
GRAM = 40
HOT = 10_000  # strings of one minimiser that are compared in one task: some 3 MB
CHUNK_BYTES = 512 << 10


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes of ``text`` in the order of their first ``depth`` symbols at least, by prefix doubling. Symbol 0 ends a
    string; ends are different symbols, ordered by place, and below all others."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, dtype=text.dtype)]).astype(np.uint64)
    key = np.zeros(n, dtype=np.uint64)
    open_ = np.ones(n, dtype=bool)
    for step in range(8):
        symbol = padded[step:step + n] * open_
        key = key << np.uint64(8) | symbol
        open_ &= symbol > 0
    order = np.argsort(key, kind="stable")
    held = key[order]
    fresh = np.ones(n, dtype=bool)  # where a group of equal prefixes begins
    fresh[1:] = (held[1:] != held[:-1]) | ((held[1:] & np.uint64(0xFF)) == 0)
    rank = np.zeros(n, dtype=np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    reach = 8
    while reach < depth:
        alone = fresh & np.append(fresh[1:], True)
        at = np.flatnonzero(~alone)
        if not len(at):
            break
        suffix = order[at]
        pair = rank[suffix] * n + rank[suffix + reach]
        turn = np.argsort(pair, kind="stable")
        suffix, pair = suffix[turn], pair[turn]
        order[at] = suffix
        fresh[at[1:]] |= pair[1:] != pair[:-1]
        first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
        rank[suffix] = first[at]
        reach *= 2
    return order


class Ranks:
    """How often a symbol occurs before a place of the transform: counts per 32 places, and a look at the rest."""

    SPAN = 32

    def __init__(self, bwt: np.ndarray, symbols: int):
        n = len(bwt)
        spans = n // self.SPAN + 1
        self.symbols = symbols
        self.cells = np.full(spans * self.SPAN, 255, dtype=np.uint8)
        self.cells[:n] = bwt
        self.cells = self.cells.reshape(spans, self.SPAN)
        counts = np.bincount(np.arange(n) // self.SPAN * symbols + bwt, minlength=spans * symbols).reshape(spans, symbols)
        self.before = np.zeros((spans, symbols), dtype=np.int32)
        np.cumsum(counts[:-1], axis=0, out=self.before[1:])

    def one(self, place: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        span = place // self.SPAN
        inside = np.arange(self.SPAN) < (place % self.SPAN)[:, None]
        return self.before[span, symbol] + ((self.cells[span] == symbol[:, None]) & inside).sum(axis=1)

    def every(self, place: np.ndarray) -> np.ndarray:
        span = place // self.SPAN
        inside = np.arange(self.SPAN) < (place % self.SPAN)[:, None]
        row = np.broadcast_to(np.arange(len(place))[:, None], inside.shape)[inside]
        more = np.bincount(row * self.symbols + self.cells[span][inside], minlength=len(place) * self.symbols)
        return self.before[span] + more.reshape(len(place), self.symbols)


def _extend(low: np.ndarray, high: np.ndarray, bwt: np.ndarray, ranks: Ranks, base: np.ndarray):
    """All backward extensions of the intervals by one symbol, as intervals."""
    single = high - low == 1
    lows, highs = [], []
    at = low[single]
    symbol = bwt[at]
    at, symbol = at[symbol > 0], symbol[symbol > 0]
    to = base[symbol] + ranks.one(at, symbol)
    lows.append(to)
    highs.append(to + 1)
    low, high = low[~single], high[~single]
    for cut in range(0, len(low), 8192):
        a, b = ranks.every(low[cut:cut + 8192]), ranks.every(high[cut:cut + 8192])
        row, symbol = np.nonzero(b[:, 1:] > a[:, 1:])
        symbol = symbol + 1
        lows.append(base[symbol] + a[row, symbol])
        highs.append(base[symbol] + b[row, symbol])
    return np.concatenate(lows), np.concatenate(highs)


def compare_bytes(packed: list[bytes], least: int = LEAST) -> list[np.ndarray]:
    """Per string, which of its windows of ``least`` bytes occur twice or more among the strings."""
    if not packed:
        return []
    raw = np.frombuffer(b"\0".join(packed) + b"\0", dtype=np.uint8)
    size = np.array([len(s) for s in packed], dtype=np.int64)
    end = np.cumsum(size + 1) - 1
    start = end - size
    # Bytes become symbols 1, 2, ... in order; ends are symbol 0. UTF-8 leaves 13 byte values unused, so all fit.
    is_end = np.zeros(len(raw), dtype=bool)
    is_end[end] = True
    used = np.unique(raw[~is_end])
    to_symbol = np.zeros(256, dtype=np.uint8)
    to_symbol[used] = np.arange(1, len(used) + 1)
    text = to_symbol[raw]
    text[is_end] = 0
    n, symbols = len(text), len(used) + 1
    order = suffix_array(text, least)
    bwt = text[order - 1]
    bwt[order == 0] = 0
    ranks = Ranks(bwt, symbols)
    count = np.bincount(text, minlength=symbols)
    base = np.concatenate([[0], np.cumsum(count)[:-1]])
    prefix = np.full(n + 1, -1, dtype=np.int32)  # common prefix of suffixes t - 1 and t; -1: not known yet
    prefix[0] = prefix[n] = 0
    ends = np.arange(1, count[0] + 1)
    low = np.concatenate([ends - 1, base[1:]])
    high = np.concatenate([ends, base[1:] + count[1:]])
    for value in range(least):
        fresh = prefix[high] < 0
        low, high = low[fresh], high[fresh]
        if not len(low):
            break
        prefix[high] = value
        low, high = _extend(low, high, bwt, ranks, base)
    twice = np.zeros(n, dtype=bool)
    together = np.flatnonzero(prefix < 0)
    twice[order[together]] = True
    twice[order[together - 1]] = True
    return [twice[a:max(a, a + s - least + 1)] for a, s in zip(start.tolist(), size.tolist(), strict=True)]


def dedup_bytes(docs: DataFrame, *, least: int = LEAST, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_text``, the removed runs as (start, end) and the
    bytes left."""
    rows = known_rows(docs)
    marks = repeated_windows(
        rows, Unit("bytes", least, gram), lambda packed: compare_bytes(packed, least), chunk_bytes=CHUNK_BYTES, hot=hot
    )
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, spans in marked_rows(batches):
            removed, runs, digest, cut, kept = [], [], [], [], []
            for i, (low, high) in enumerate(spans):
                text = block.data[block.at[i]:block.at[i + 1]]
                gone = covered(len(text), low, high, least)
                turn = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
                rest = text[~gone].tobytes()
                removed.append(int(gone.sum()))
                runs.append(len(turn) // 2)
                digest.append(hashlib.sha256(rest).hexdigest())
                if keep_text:
                    cut.append([{"start": a, "end": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)])
                    kept.append(rest)
            columns = [
                part.column("doc_id").cast(pa.int64()), pa.array(np.diff(block.at)), pa.array(removed, pa.int64()),
                pa.array(runs, pa.int64()), pa.array(digest, pa.string()),
            ]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if keep_text:
                columns += [pa.array(cut, spans_type), pa.array(kept, pa.binary())]
                names += ["removed", "kept"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    if keep_text:
        schema += ", removed array<struct<start:long,end:long>>, kept binary"
    return with_marks(rows, marks).mapInArrow(run, schema)
