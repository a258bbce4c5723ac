"""Byte-level BPE encoding and decoding (operator 5) by replaying the merges over a corpus.

The corpus of a task is a run of whole texts of about ``CORPUS_BYTES``. Its distinct pieces (matches of the tokenizer's
pattern) are laid out as one chain of byte symbols; an inverted index from merge rank to the places of the pair waits in a heap of ranks. The
lowest rank is taken, all its places are merged at once, and only the two neighbours of each merged place get a new pair.
A merge never touches another piece, so each piece sees its own merges in the order in which it would alone.
Texts need no shuffle, and a piece is merged once per corpus however often it occurs.

Defined cases: a null text counts as empty and has no ids; long texts are taken whole; repeated rows give equal results;
an empty table gives an empty result; other columns are ignored. No special tokens: their strings are ordinary text.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from riftline.llm.blocks import Block, blocks, mix, powers

CORPUS_BYTES = 24 << 20


class Vocabulary:
    """Ranks by token, and for two neighbouring tokens the rank of their concatenation."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.tokens = [b""] * (max(self.ranks.values(), default=-1) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.bytes = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pair = np.array(sorted(pairs), dtype=np.int64)
        self.pair_rank = np.array([pairs[p] for p in self.pair.tolist()], dtype=np.int64)

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where it is no token."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        return np.where(self.pair[at] == key, self.pair_rank[at], -1)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def replay(pieces: list[bytes], held: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all pieces, one after the other, and the offset at which each piece begins.

    A piece that is a token itself is that token, as in the library.
    """
    whole = np.array([held.ranks.get(piece, -1) for piece in pieces], dtype=np.int64)
    split = np.flatnonzero(whole < 0)
    flat = np.frombuffer(b"".join([pieces[i] for i in split.tolist()]), dtype=np.uint8)
    length = np.array([len(pieces[i]) for i in split.tolist()], dtype=np.int64)
    n = len(flat)
    token = held.bytes[flat] if n else np.zeros(0, dtype=np.int64)
    owner = np.repeat(split, length)
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    if n:
        ends = np.cumsum(length)
        after[ends - 1], before[ends - length] = -1, -1
    alive = np.ones(n, dtype=bool)
    rank = np.full(n, -1, dtype=np.int64)  # of the pair that begins here
    index: dict[int, list[np.ndarray]] = {}
    heap: list[int] = []

    def note(places: np.ndarray) -> None:
        """Looks the pairs up that begin at these places and enters them into the index."""
        found = held.rank_of(token[places], token[after[places]])
        rank[places] = found
        places, found = places[found >= 0], found[found >= 0]
        if len(places) == 1:
            groups = [(int(found[0]), places)]
        else:
            order = np.argsort(found, kind="stable")
            places, found = places[order], found[order]
            cuts = np.flatnonzero(np.diff(found)) + 1
            groups = zip(found[np.concatenate([[0], cuts])].tolist() if len(found) else [], np.split(places, cuts), strict=False)
        for r, some in groups:
            if r in index:
                index[r].append(some)
            else:
                index[r] = [some]
                heapq.heappush(heap, r)

    note(np.flatnonzero(after >= 0))
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r)
        places = np.unique(np.concatenate(places)) if len(places) > 1 else np.sort(places[0])
        places = places[alive[places] & (rank[places] == r)]
        # In a run of overlapping places (as in "aaa") every second one goes, from the left.
        if len(places) > 1:
            follows = np.zeros(len(places), dtype=bool)
            follows[1:] = after[places[:-1]] == places[1:]
            if follows.any():
                at = np.arange(len(places))
                head = np.maximum.accumulate(np.where(follows, 0, at))
                places = places[(at - head) % 2 == 0]
        if not len(places):
            continue
        gone = after[places]
        token[places] = r
        alive[gone] = False
        rank[gone] = -1
        beyond = after[gone]
        after[places] = beyond
        rank[places] = -1
        inner = beyond >= 0
        before[beyond[inner]] = places[inner]
        left = before[places]
        left = left[left >= 0]
        rank[left] = -1
        touched = np.unique(np.concatenate([left, places[inner]]))
        if len(touched):
            note(touched)
    left_over = np.flatnonzero(alive)
    counts = (whole >= 0).astype(np.int64)
    counts += np.bincount(owner[left_over], minlength=len(pieces))
    at = np.zeros(len(pieces) + 1, dtype=np.int64)
    np.cumsum(counts, out=at[1:])
    ids = np.zeros(at[-1], dtype=np.int64)
    single = np.flatnonzero(whole >= 0)
    ids[at[single]] = whole[single]
    mask = np.ones(at[-1], dtype=bool)
    mask[at[single]] = False
    ids[mask] = token[left_over]
    return ids, at


# Classes of code points in the tokenizer's pattern.
_OTHER, _LETTER, _NUMBER, _BLANK = range(4)


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    held = np.zeros(0x110000, dtype=np.uint8)
    points = np.array([*range(0xD800), *range(0xE000, 0x110000)], dtype=np.int64)
    every = "".join(map(chr, points.tolist()))
    for kind, name in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_BLANK, r"\p{White_Space}+")):
        for run in regex.finditer(name, every):
            held[points[run.start():run.end()]] = kind
    return held


def piece_starts(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Where the pieces of the 50k pattern begin; ``first`` are the beginnings of texts among the code points.

    The pattern as rules on runs of one class: a run takes one blank 0x20 before it; other white space before a run
    leaves its last character to a piece of its own; an apostrophe that begins a piece takes the ending of a contraction.
    """
    n = len(points)
    kind = _classes()[points]
    fresh = np.zeros(n + 1, dtype=bool)
    fresh[first] = True
    fresh[n] = True
    run = fresh.copy()
    run[1:n] |= kind[1:] != kind[:-1]
    start = run[:n].copy()
    blank = kind == _BLANK
    last_blank = blank.copy()  # of a blank run that something follows
    last_blank[:-1] &= ~blank[1:]
    last_blank &= ~fresh[1:]
    start |= last_blank
    joined = np.flatnonzero(last_blank & (points == 0x20)) + 1
    start[joined] = False
    mark = np.flatnonzero((points == 0x27) & start & run[1:])
    mark = mark[(mark + 1 < n) & ~fresh[np.minimum(mark + 1, n)]]
    mark = mark[kind[mark + 1] == _LETTER]
    if len(mark):
        one = points[mark + 1]
        two = np.where((mark + 2 < n) & ~fresh[np.minimum(mark + 2, n)], points[np.minimum(mark + 2, n - 1)], 0)
        size = np.zeros(len(mark), dtype=np.int64)
        size[np.isin(one, [ord(c) for c in "stmd"])] = 1
        for pair in ("re", "ve", "ll"):
            size[(one == ord(pair[0])) & (two == ord(pair[1]))] = 2
        mark, size = mark[size > 0], size[size > 0]
        start[mark + 1] = False
        beyond = mark + 1 + size
        start[beyond[beyond < n]] = True
    return np.flatnonzero(start)


class Pieces:
    """Pieces of a block: text ``i`` is the distinct pieces ``code[first[i]:first[i + 1]]``."""

    def __init__(self, block: Block):
        data = block.data
        try:
            whole = data.tobytes().decode()
        except UnicodeDecodeError:  # not valid UTF-8: as the library would see it
            texts = [block.text(i).decode(errors="replace").encode() for i in range(block.size)]
            data = np.frombuffer(b"".join(texts), dtype=np.uint8)
            block.at = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int64)
            block.data = data
            whole = data.tobytes().decode()
        points = np.frombuffer(whole.encode("utf-32-le"), dtype=np.uint32)
        self.distinct: list[bytes] = []
        self.code = np.zeros(0, dtype=np.int64)
        self.first = np.zeros(block.size + 1, dtype=np.int64)
        if not len(data):
            return
        begins = np.flatnonzero((data & 0xC0) != 0x80)  # byte of each code point
        text_first = np.searchsorted(begins, block.at[:-1])
        at = begins[piece_starts(points, text_first[text_first < len(points)])]
        size = np.diff(np.append(at, len(data)))
        self.first = np.searchsorted(at, block.at)
        place = np.arange(len(data)) - np.repeat(at, size)
        value = (data.astype(np.uint64) + np.uint64(1)) * powers(0x100000001B3, int(size.max()))[place]
        key = mix(np.add.reduceat(value, at) + size.astype(np.uint64))
        self.code, _ = pd.factorize(key)
        seen = np.zeros(self.code.max() + 1, dtype=np.int64)
        seen[self.code[::-1]] = np.arange(len(at))[::-1]
        twin = seen[self.code]
        if not (np.array_equal(size[twin], size) and np.array_equal(data[np.repeat(at[twin], size) + place], data)):
            raw = data.tobytes()
            number: dict[bytes, int] = {}
            self.code = np.array([number.setdefault(raw[a:a + s], len(number)) for a, s in zip(at.tolist(), size.tolist(), strict=True)])
            self.distinct = list(number)
            return
        raw = data.tobytes()
        self.distinct = [raw[a:a + s] for a, s in zip(at[seen].tolist(), size[seen].tolist(), strict=True)]


def encode_corpus(parts: list[Block], held: Vocabulary) -> Iterator[list[np.ndarray]]:
    """Ids of each text, block by block; the merges are replayed once over the pieces of all blocks."""
    number: dict[bytes, int] = {}
    cut = []
    for block in parts:
        pieces = Pieces(block)
        known = np.array([number.setdefault(piece, len(number)) for piece in pieces.distinct], dtype=np.int64)
        cut.append((known[pieces.code].astype(np.int32) if len(known) else pieces.code, pieces.first))
    ids, at = replay(list(number), held)
    for code, first in cut:
        count = at[code + 1] - at[code]
        ends = np.concatenate([[0], np.cumsum(count)])
        shift = np.repeat(at[code] - ends[:-1], count)
        flat = ids[np.arange(len(shift)) + shift] if len(shift) else np.zeros(0, dtype=np.int64)
        reach = ends[first]
        yield [flat[reach[i]:reach[i + 1]] for i in range(len(reach) - 1)]


def decode_ids(ids: np.ndarray, held: Vocabulary) -> bytes:
    tokens = held.tokens
    return b"".join([tokens[i] for i in ids.tolist()])


def encode(docs: DataFrame, path: str, *, keep_ids: bool = True) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids (array<int>, unless ``keep_ids`` is off), ids_sha256, decoded_sha256.

    ``path`` names a file of ranks that every executor can open.
    """

    def rows(parts: list[tuple[pa.RecordBatch, Block]], held: Vocabulary) -> Iterator[pa.RecordBatch]:
        for (part, _), texts in zip(parts, encode_corpus([block for _, block in parts], held), strict=True):
            packed = [text.astype("<u4") for text in texts]
            columns = [
                part.column("doc_id").cast(pa.int64()),
                pa.array([len(text) for text in texts], pa.int64()),
                pa.array([hashlib.sha256(text.tobytes()).hexdigest() for text in packed], pa.string()),
                pa.array([hashlib.sha256(decode_ids(text, held)).hexdigest() for text in texts], pa.string()),
            ]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                at = np.concatenate([[0], np.cumsum([len(text) for text in texts])]).astype(np.int32)
                columns.append(pa.ListArray.from_arrays(pa.array(at), pa.array(np.concatenate(packed).astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        parts, size = [], 0
        for batch in batches:
            for part, block in blocks(batch, "text"):
                if parts and size + len(block.data) > CORPUS_BYTES:
                    yield from rows(parts, held)
                    parts, size = [], 0
                parts.append((part, block))
                size += len(block.data)
        if parts:
            yield from rows(parts, held)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """The texts (as binary) of rows with doc_id and ids; a null list is an empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = vocabulary(path)
        for batch in batches:
            texts = [decode_ids(np.array(ids or [], dtype=np.int64), held) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(texts, pa.binary())], names=["doc_id", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")
