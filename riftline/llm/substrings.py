"""Substring dedup (operator 3): words covered by a window of 35 words that also starts elsewhere are removed.

Super-k-mers travel packed to the bucket of their minimiser (see ``repeats``); there the words become exact local numbers,
the windows are sorted, and neighbours are compared word by word.

Defined cases: a null text has no words; a text of fewer than 35 words keeps all; a repeated row is a second place, so its
windows go in both; windows are judged on the input; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame

from riftline.llm.blocks import Block, Words, rolling
from riftline.llm.repeats import Unit, covered, known_rows, marked_rows, repeated_windows, with_marks

WINDOW = 35
GRAM = 8
HOT = 20_000
CHUNK_BYTES = 4 << 20


def exact_numbers(words: Words) -> np.ndarray:
    """Equal numbers for equal words, and only for them."""
    data, start, size = words.block.data, words.start, words.end - words.start
    code, _ = pd.factorize(words.hashes())
    if len(code):
        seen = np.zeros(code.max() + 1, dtype=np.int64)
        seen[code[::-1]] = np.arange(len(code))[::-1]
        twin = seen[code]
        ends = np.cumsum(size)
        place = np.arange(ends[-1]) - np.repeat(ends - size, size)
        same = np.array_equal(size[twin], size) and np.array_equal(data[np.repeat(start[twin], size) + place], data[np.repeat(start, size) + place])
        if not same:
            code, _ = pd.factorize(np.array([data[a:a + s].tobytes() for a, s in zip(start.tolist(), size.tolist(), strict=True)], dtype=object))
    return code.astype(np.int64)


def compare_words(packed: list[bytes], width: int = WINDOW) -> list[np.ndarray]:
    """Per string, which of its windows occur twice or more among the strings."""
    words = Words(Block(pa.array(packed, pa.large_binary())))
    number = exact_numbers(words)
    n = len(number) - width + 1
    first, counts = words.first, words.counts
    twice = np.zeros(max(n, 0), dtype=bool)
    if n > 0:
        windows = np.maximum(counts - width + 1, 0)
        at = np.repeat(first[:-1], windows) + np.arange(windows.sum()) - np.repeat(np.cumsum(windows) - windows, windows)
        hashes = rolling(number.astype(np.uint64) + np.uint64(1), width)[at]
        order = np.argsort(hashes, kind="stable")
        ahead = np.flatnonzero(hashes[order][1:] == hashes[order][:-1])
        a, b = at[order[ahead]], at[order[ahead + 1]]
        same = np.ones(len(a), dtype=bool)
        for step in range(width):
            same &= number[a + step] == number[b + step]
        twice[a[same]] = True
        twice[b[same]] = True
    return [twice[first[i]:max(first[i], first[i + 1] - width + 1)] for i in range(len(packed))]


def dedup_substrings(docs: DataFrame, *, window: int = WINDOW, gram: int = GRAM, hot: int = HOT, keep_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, with ``keep_text``, the words left, joined by one space."""
    rows = known_rows(docs)
    marks = repeated_windows(
        rows, Unit("words", window, gram), lambda packed: compare_words(packed, window), chunk_bytes=CHUNK_BYTES, hot=hot
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, block, spans in marked_rows(batches):
            words = Words(block)
            removed, digest, kept_text = [], [], []
            raw = block.data.tobytes()
            for i, (low, high) in enumerate(spans):
                a, b = int(words.first[i]), int(words.first[i + 1])
                gone = covered(b - a, low, high, window)
                keep = np.flatnonzero(~gone) + a
                text = b" ".join([raw[x:y] for x, y in zip(words.start[keep].tolist(), words.end[keep].tolist(), strict=True)])
                removed.append(int(gone.sum()))
                digest.append(hashlib.sha256(text).hexdigest())
                kept_text.append(text)
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(words.counts), pa.array(removed, pa.int64()), pa.array(digest, pa.string())]
            names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
            if keep_text:
                columns.append(pa.array(kept_text, pa.binary()).cast(pa.string()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text
    return with_marks(rows, marks).mapInArrow(run, schema)
