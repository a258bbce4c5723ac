"""Phrase collocation mining (operator 11): an FM-index per shard over word ids, counts summed across shards.

Texts are lower-cased in A-Z, cut into pieces at ``[.,;:!?\\n\\v\\f\\r]`` and pieces into words ``[^\\x20\\x09]+``; all
counts are per lang (null: ``und``). A task cuts its rows into shards of about ``SHARD_CHARS`` bytes, so neither a repeated
doc_id nor a hot language fills one task. A shard is one row, written once: its words (by lang and text), their counts,
and its text as a sequence of word ids with separators between pieces.

A phrase occurs at most as often as each of its parts, so phrases are counted by length, shortest first, and only those are
counted whose shorter parts all occur ``MIN_COUNT`` times. One such round: every shard builds the suffix array of its sequence
(prefix doubling), its Burrows-Wheeler transform and LF mapping, and enumerates its n-grams by backward interval extension
(prepend a word w: the interval moves to C[w] + rank(w, lo) .. C[w] + rank(w, hi)), the interval's width being the count; it
sends a 64-bit hash and the count of each, packed by ranges of hashes; a range adds up its hashes and tells each shard
which of its own reach ``MIN_COUNT``. A collision can only add to a count, so the set of frequent n-grams can only grow.
Rounds: words; words in pairs; threes; fours and fives. The last one enumerates the frequent n-grams again, as text with
their exact counts in the shard, and these are summed by text: no hash decides a count that reaches the result. Within a shard
equal hashes of words are compared byte by byte. Spark then forms the cuts, the scores in exact decimal arithmetic, the
containment rule and the top ``TOP`` per lang with a group limit.

Note on the method: only the backward (left) extension is used. Every frequent n-gram up to ``DEPTH`` words is enumerated
with its count, and the parts of a candidate are as frequent as itself, so the counts of a phrase's left and right parts are
read from the same table; right extensions add nothing.

Defined cases: a null text is empty; a null lang is ``und``; repeated rows count as often as they occur; very long texts
are read whole; an empty table gives an empty result; other columns are ignored; ties of score and a are ordered by the
phrase's UTF-8 bytes.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riftline.llm.blocks import Block, blocks, mix, powers
from riftline.llm.shared import stored

MIN_COUNT = 100
SHORTEST, DEPTH = 2, 5
TOP = 2000
SHARD_CHARS = 8_000_000
RANGE_SHARDS = 8  # a range of hashes holds about as many n-grams as this number of shards
KEY_BYTES = 6  # of a hash that travels; fewer bytes could only let more n-grams pass as frequent
KEY = np.uint64((1 << 8 * KEY_BYTES) - 1)
SLICE = 1 << 18  # words whose bytes are looked at in one step
ROUNDS = ((2, 2), (3, 3), (4, DEPTH))  # the lengths counted together
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
PIECE = re.compile(r"[.,;:!?\x0A-\x0D]")
WORD = re.compile(r"[^\x20\x09]+")

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32
KIND = np.zeros(256, dtype=np.uint8)  # of a byte: 0 in a word, 1 between words, 2 between pieces
KIND[[0x20, 0x09]] = 1
KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2

SHARD = "shard long, langs array<string>, totals array<long>, seq binary, words binary, lengths binary, lang_of binary, counts binary"
RUNS = "shard long, langs array<string>, seq binary, hashes binary, words array<string>, lang_of binary, counts binary"
PACKED = "bucket long, level int, shard long, keys binary, counts binary"
LISTS = "shard long, level int, keys binary"
TEXTS = "bucket long, lang string, phrases string, counts binary"
GRAMS = "lang string, phrase string, f long, size int"


def pieces(text: str | None) -> list[list[str]]:
    """The words of each piece of a text."""
    low = (text or "").translate(str.maketrans(UPPER, UPPER.lower()))
    return [WORD.findall(p) for p in PIECE.split(low)]


def packed(values: np.ndarray, width: int = 4) -> bytes:
    """Integers below 256 ** ``width``: all their first bytes, then all second ones, under zstd."""
    data = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()
    return len(data).to_bytes(8, "little") + (pa.compress(data, codec="zstd", asbytes=True) if data else b"")


def unpacked(data: bytes, width: int = 4) -> np.ndarray:
    size = int.from_bytes(data[:8], "little")
    out = np.zeros((size // width, 8), dtype=np.uint8)
    if size:
        planes = pa.decompress(data[8:], decompressed_size=size, codec="zstd", asbytes=True)
        out[:, :width] = np.frombuffer(planes, dtype=np.uint8).reshape(width, -1).T
    return out.view("<i8").reshape(-1)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted hashes, as steps."""
    return packed(np.diff(keys, prepend=np.uint64(0)), KEY_BYTES)


def unpacked_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpacked(data, KEY_BYTES)).astype(np.uint64)


def _bytes_of(start: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the bytes of some words are, which byte of its word each is, and where each word's bytes begin among them."""
    begin = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(begin, length)
    return np.repeat(start, length) + place, place, begin


def word_hashes(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A 64-bit hash per word of one byte or more; equal words have equal hashes."""
    out = np.empty(len(start), dtype=np.uint64)
    for low in range(0, len(start), SLICE):
        size = length[low:low + SLICE]
        at, place, begin = _bytes_of(start[low:low + SLICE], size)
        value = (data[at].astype(np.uint64) + np.uint64(1)) * powers(0x100000001B3, int(size.max()))[place]
        out[low:low + SLICE] = np.add.reduceat(value, begin) + size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(out)


def _in_lang(hashes: np.ndarray, langs: Sequence[str], lang_of: np.ndarray) -> np.ndarray:
    seeds = np.array([xxhash.xxh64_intdigest(lang) for lang in langs], dtype=np.uint64)
    return mix(hashes ^ seeds[lang_of])


def _same_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, other: np.ndarray) -> bool:
    """Whether every word equals the word numbered ``other``."""
    if (length != length[other]).any():
        return False
    for low in range(0, len(start), SLICE):
        size = length[low:low + SLICE]
        at, place, _ = _bytes_of(start[low:low + SLICE], size)
        if (data[at] != data[np.repeat(start[other[low:low + SLICE]], size) + place]).any():
            return False
    return True


def _numbered(data: np.ndarray, start: np.ndarray, length: np.ndarray, langs: Sequence[str], lang_of: np.ndarray):
    """(the number of each word, the first place of each number): numbers stand for a word of a lang, the most frequent first."""
    hashes = _in_lang(word_hashes(data, start, length), langs, lang_of)
    first, inverse, counts = np.unique(hashes, return_index=True, return_inverse=True, return_counts=True)[1:]
    if (lang_of != lang_of[first[inverse]]).any() or not _same_words(data, start, length, first[inverse]):
        held: dict[tuple[int, bytes], int] = {}  # two words share a hash
        inverse = np.array([
            held.setdefault((g, data[s:s + n].tobytes()), len(held))
            for g, s, n in zip(lang_of.tolist(), start.tolist(), length.tolist(), strict=True)
        ], dtype=np.int64)
        first, counts = np.unique(inverse, return_index=True, return_counts=True)[1:]
    order = np.argsort(-counts, kind="stable")
    number = np.empty(len(order), dtype=np.int64)
    number[order] = np.arange(len(order))
    return number[inverse], first[order], counts[order]


def sequence(words: np.ndarray, linked: np.ndarray) -> np.ndarray:
    """Runs of word ids between zeros; ``linked`` tells whether a word follows the one before. Words without a neighbour go."""
    inside = linked.copy()
    inside[:-1] |= linked[1:]
    words, fresh = words[inside], ~linked[inside]
    out = np.zeros(len(words) + int(fresh.sum()) + 1, dtype=np.int64)
    out[np.arange(len(words)) + np.cumsum(fresh)] = words
    return out


def links(seq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words of a sequence, and whether each follows the one before."""
    at = np.flatnonzero(seq)
    return seq[at], (at > 0) & (seq[at - 1] != 0)


def _shard(number: int, held: Sequence[tuple[Block, pa.Array]]) -> dict:
    """One row of ``SHARD``."""
    data = LOWER[np.concatenate([b.data for b, _ in held])]
    size = np.cumsum([0, *[len(b.data) for b, _ in held]])
    at = np.concatenate([b.at[:-1] + s for (b, _), s in zip(held, size[:-1], strict=True)])
    named = pa.concat_arrays([g for _, g in held]).dictionary_encode()
    langs = named.dictionary.to_pylist()
    kind = KIND[data]
    begins = np.zeros(len(data) + 1, dtype=bool)
    begins[at] = True
    begins[-1] = True
    gap = np.ones(len(data) + 2, dtype=bool)  # of the byte before, from the first on
    gap[1:-1] = kind != 0
    start = np.flatnonzero((kind == 0) & (gap[:-2] | begins[:-1]))
    end = np.flatnonzero((kind == 0) & (gap[2:] | begins[1:])) + 1
    row = np.searchsorted(at, start, side="right") - 1
    cuts = np.zeros(len(data) + 1, dtype=np.int32)
    np.cumsum(kind == 2, out=cuts[1:])
    linked = np.zeros(len(start), dtype=bool)
    linked[1:] = (row[1:] == row[:-1]) & (cuts[start[1:]] == cuts[end[:-1]])
    del kind, begins, gap, cuts
    lang_of, length = named.indices.to_numpy()[row].astype(np.int64), end - start
    ids, first, counts = _numbered(data, start, length, langs, lang_of)
    return {
        "shard": number, "langs": langs, "totals": np.bincount(lang_of, minlength=len(langs)).tolist(),
        "seq": packed(sequence(ids + 1, linked)), "words": data[_bytes_of(start[first], length[first])[0]].tobytes(),
        "lengths": packed(length[first]), "lang_of": packed(lang_of[first]), "counts": packed(counts),
    }


SHARD_ARROW = pa.schema([
    ("shard", pa.int64()), ("langs", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("seq", pa.binary()),
    ("words", pa.binary()), ("lengths", pa.binary()), ("lang_of", pa.binary()), ("counts", pa.binary()),
])


def _shards_of(size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, total = [], 0

        def row():
            return pa.RecordBatch.from_pylist([_shard(number, held)], schema=SHARD_ARROW)

        for batch in batches:
            for part, block in blocks(batch, "text", size):
                held.append((block, part.column(part.schema.get_field_index("lang")).cast(pa.string())))
                total += len(block.data)
                if total >= size:
                    yield row()
                    number, held, total = number + 1, [], 0
        if total:
            yield row()

    return run


def _spread(shard: int, level: int, keys: np.ndarray, counts: np.ndarray, buckets: int) -> Iterator[dict]:
    """Rows of ``PACKED``: hashes and counts of a shard by ranges of hashes."""
    keys = keys & KEY
    order = np.argsort(keys)
    bucket = (keys >> np.uint64(20)) % np.uint64(buckets)
    order = order[np.argsort(bucket[order], kind="stable")]
    keys, counts = keys[order], counts[order]
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(bounds)).tolist():
        s = slice(bounds[b], bounds[b + 1])
        yield {"bucket": b, "level": level, "shard": shard, "keys": packed_keys(keys[s]), "counts": packed(counts[s])}


def _dictionary(shard: Mapping) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, lengths, lang numbers, hashes) of the words of a shard."""
    data, length, lang_of = np.frombuffer(shard["words"], dtype=np.uint8), unpacked(shard["lengths"]), unpacked(shard["lang_of"])
    start = np.cumsum(length) - length
    return data, start, length, lang_of, _in_lang(word_hashes(data, start, length), list(shard["langs"]), lang_of)


def _word_counts(buckets: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for shard in frame.to_dict("records"):
                rows = list(_spread(shard["shard"], 1, _dictionary(shard)[-1], unpacked(shard["counts"]), buckets))
                if rows:
                    yield pd.DataFrame(rows)

    return run


def _frequent(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Of the hashes in one range, those which reach ``least`` over all shards, told to every shard that has them."""

    def run(frame: pd.DataFrame) -> pd.DataFrame:
        held = [unpacked_keys(k) for k in frame["keys"]]
        keys, counts = np.concatenate(held), np.concatenate([unpacked(c) for c in frame["counts"]])
        order = np.argsort(keys)
        first = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
        often = np.zeros(len(keys), dtype=bool)
        often[order] = np.repeat(np.add.reduceat(counts[order], first) >= least, np.diff(np.append(first, len(keys))))
        parts = np.split(often, np.cumsum([len(k) for k in held])[:-1])
        rows = [
            (shard, level, packed_keys(k[m]))
            for shard, level, k, m in zip(frame["shard"], frame["level"], held, parts, strict=True) if m.any()
        ]
        return pd.DataFrame(rows, columns=["shard", "level", "keys"]).astype({"shard": "int64", "level": "int32"})

    return run


def _lists(frame: pd.DataFrame) -> dict[int, np.ndarray]:
    """The frequent hashes of a shard by length, sorted."""
    return {
        int(level): np.unique(np.concatenate([unpacked_keys(k) for k in keys]))
        for level, keys in frame.groupby("level")["keys"]
    }


def among(keys: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Which keys, as far as they travel, are in the sorted ``held``."""
    keys = keys & KEY
    at = np.searchsorted(held, keys)
    at[at == len(held)] = 0
    return held[at] == keys if len(held) else np.zeros(len(keys), dtype=bool)


def _runs(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Rows of ``RUNS``: a shard's frequent words, renumbered, and its runs of them."""
    out = pd.DataFrame(columns=["shard", "langs", "seq", "hashes", "words", "lang_of", "counts"])
    if not len(left) or not len(right):
        return out
    shard = left.iloc[0]
    data, start, length, lang_of, hashes = _dictionary(shard)
    keep = among(hashes, _lists(right)[1])
    number = np.zeros(len(keep) + 1, dtype=np.int64)
    number[1:][keep] = np.arange(1, int(keep.sum()) + 1)
    words, linked = links(unpacked(shard["seq"]))
    words = number[words]
    linked[1:] &= (words[1:] != 0) & (words[:-1] != 0)
    out.loc[0] = [
        shard["shard"], list(shard["langs"]), packed(sequence(words, linked)), hashes[keep].tobytes(),
        [data[s:s + n].tobytes().decode() for s, n in zip(start[keep].tolist(), length[keep].tolist(), strict=True)],
        packed(lang_of[keep]), packed(unpacked(shard["counts"])[keep]),
    ]
    return out


def suffix_array(seq: np.ndarray, depth: int) -> np.ndarray:
    """Suffix array of an integer sequence by prefix doubling, ordered by the first ``depth`` integers or more."""
    n = len(seq)
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    rank, k = seq, 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: n - k] += rank[k:] + 1 if k < n else 0
        order = np.argsort(key)
        k *= 2
        if k >= min(depth, n):
            return order
        rank = np.empty(n, dtype=np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], np.diff(key[order]) != 0]))


def gram_hashes(grams: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(grams), dtype=np.uint64)
    for j in range(grams.shape[1]):
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + hashes[grams[:, j] - 1])
    return out


def ngram_counts(
    seq: np.ndarray, hashes: np.ndarray, often: Mapping[int, np.ndarray], depth: int
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(n-grams of word ids as a matrix, their counts) for each length 1 to ``depth``, none holding the separator 0 and none
    whose parts are known not to be in ``often``.

    Backward extension over the FM-index of ``seq``, all nodes of one length at once: the SA intervals of distinct
    n-grams of one length are disjoint, so each SA position carries the node it lies in, and prepending the word
    bwt[p] moves position p to LF(p) = C[bwt[p]] + rank(bwt[p], p), inside the child's interval. Suffixes are ordered by
    ``depth`` words at least, so LF is read from the inverse of the suffix array."""
    n = len(seq)
    sa = suffix_array(seq, depth)
    inverse = np.empty(n, dtype=np.int64)
    inverse[sa] = np.arange(n)
    bwt, lf = seq[sa - 1], inverse[sa - 1]
    bwt[sa == 0] = 0
    node = np.zeros(n, dtype=np.int64)  # every position lies in the root, the empty n-gram
    grams = np.zeros((1, 0), dtype=np.int64)
    for size in range(1, depth + 1):
        live = (node >= 0) & (bwt != 0)
        parent = np.full(n, -1, dtype=np.int64)
        parent[lf[live]] = node[live]
        at = np.flatnonzero(parent >= 0)  # the children's intervals, in SA order
        if not len(at):
            return
        symbol, parent = seq[sa[at]], parent[at]
        change = np.concatenate([[True], (symbol[1:] != symbol[:-1]) | (parent[1:] != parent[:-1])])
        first = np.flatnonzero(change)
        grams = np.concatenate([symbol[first, None], grams[parent[first]]], axis=1)
        counts = np.diff(np.append(first, len(at)))
        if size in often:
            kept = among(gram_hashes(grams, hashes), often[size])
        elif size - 1 in often:
            kept = among(gram_hashes(grams[:, :-1], hashes), often[size - 1])
        else:
            kept = np.ones(len(grams), dtype=bool)
        child = np.where(kept, np.cumsum(kept) - 1, -1)
        node = np.full(n, -1, dtype=np.int64)
        node[at] = child[np.cumsum(change) - 1]
        grams, counts = grams[kept], counts[kept]
        yield grams, counts


def _index(left: pd.DataFrame, right: pd.DataFrame, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``ngram_counts`` of a shard's runs of frequent words or, when they are known, of frequent pairs of words."""
    often = _lists(right) if len(right) else {}
    hashes = np.frombuffer(left["hashes"].iloc[0], dtype=np.uint64)
    seq = unpacked(left["seq"].iloc[0])
    if SHORTEST in often:
        words, linked = links(seq)
        pairs = np.stack([words[:-1], words[1:]], axis=1)
        linked[1:] &= among(gram_hashes(pairs, hashes), often[SHORTEST])
        seq = sequence(words, linked)
    return ngram_counts(seq, hashes, often, depth)


def _gram_counts(sizes: tuple[int, int], buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        # a shard without frequent n-grams one shorter has none of these
        if len(left) and (sizes[0] == SHORTEST or (len(right) and (right["level"] == sizes[0] - 1).any())):
            hashes = np.frombuffer(left["hashes"].iloc[0], dtype=np.uint64)
            for grams, counts in _index(left, right, sizes[1]):
                if grams.shape[1] >= sizes[0]:
                    rows += _spread(int(left["shard"].iloc[0]), grams.shape[1], gram_hashes(grams, hashes), counts, buckets)
        return pd.DataFrame(rows, columns=["bucket", "level", "shard", "keys", "counts"])

    return run


def _phrases(buckets: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    """The frequent words and n-grams of a shard as text, one to a line, with their counts in it, by lang and range."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            shard = left.iloc[0]
            hashes, lang_of = np.frombuffer(shard["hashes"], dtype=np.uint64), unpacked(shard["lang_of"])
            words = np.array(["", *shard["words"]], dtype=object)
            singles = (np.arange(1, len(words))[:, None], unpacked(shard["counts"]))
            for grams, counts in [singles, *(_index(left, right, int(right["level"].max())) if len(right) else ())]:
                if grams is not singles[0] and grams.shape[1] < SHORTEST:
                    continue
                text = words[grams[:, 0]]
                for j in range(1, grams.shape[1]):
                    text = text + " " + words[grams[:, j]]
                bucket = ((gram_hashes(grams, hashes) >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
                place = lang_of[grams[:, 0] - 1] * buckets + bucket
                order = np.argsort(place, kind="stable")
                kinds, first = np.unique(place[order], return_index=True)
                for kind, part in zip(kinds.tolist(), np.split(order, first[1:]), strict=True):
                    rows.append((kind % buckets, shard["langs"][kind // buckets], "\n".join(text[part]), packed(counts[part])))
        return pd.DataFrame(rows, columns=["bucket", "lang", "phrases", "counts"])

    return run


def _totals(least: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        text = [p for part in frame["phrases"] for p in part.split("\n")]  # no word holds a line break
        f = pd.Series(np.concatenate([unpacked(c) for c in frame["counts"]])).groupby(np.array(text, dtype=object)).sum()
        f = f[f >= least]
        return pd.DataFrame({"lang": frame["lang"].iloc[0], "phrase": f.index, "f": f.to_numpy()}).assign(
            size=[p.count(" ") + 1 for p in f.index]
        ).astype({"f": "int64", "size": "int32"})

    return run


def phrase_counts(docs: DataFrame, least: int) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, size, f) of all words and phrases of up to ``DEPTH`` words with f of ``least`` or more, and n per lang."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang")
    held = docs.select(lang, F.col("text").cast("string").alias("text"))
    shards = stored(held.mapInArrow(_shards_of(SHARD_CHARS), SHARD), "phrases_shards")
    n = shards.select(F.explode(F.arrays_zip("langs", "totals")).alias("t")).groupBy(F.col("t.langs").alias("lang")).agg(
        F.sum("t.totals").alias("n")
    )
    buckets = max(1, math.ceil(shards.count() / RANGE_SHARDS))

    def frequent(counted: DataFrame, name: str) -> DataFrame:
        return stored(counted.groupBy("bucket", "level").applyInPandas(_frequent(least), LISTS), name)

    dictionaries = shards.select("shard", "langs", "words", "lengths", "lang_of", "counts")
    words = frequent(dictionaries.mapInPandas(_word_counts(buckets), PACKED), "phrases_often_1")
    runs = stored(
        shards.drop("totals").groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(_runs, RUNS), "phrases_runs"
    )
    often = words.limit(0)
    for sizes in ROUNDS:
        counted = runs.select("shard", "seq", "hashes").groupBy("shard").cogroup(often.groupBy("shard")).applyInPandas(
            _gram_counts(sizes, buckets), PACKED
        )
        often = often.unionByName(frequent(counted, f"phrases_often_{sizes[0]}"))
    text = runs.groupBy("shard").cogroup(often.groupBy("shard")).applyInPandas(_phrases(buckets), TEXTS)
    return stored(text.groupBy("bucket", "lang").applyInPandas(_totals(least), GRAMS), "phrases_counts"), n


def collocations(docs: DataFrame) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``TOP`` candidates of each lang."""
    f, n = phrase_counts(docs, MIN_COUNT)
    cands = f.filter((F.col("size") >= SHORTEST) & (F.col("f") >= MIN_COUNT)).select(
        "lang", "phrase", "size", F.col("f").alias("a"), F.split("phrase", " ").alias("w")
    )
    # every cut: left part of k words, right part of the rest
    cuts = cands.select("*", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k")).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice("w", 1, F.col("k")), " ").alias("lp"),
        F.array_join(F.slice("w", F.col("k") + 1, F.col("size")), " ").alias("rp"),
    )
    lf = f.select(F.col("lang").alias("_ll"), F.col("phrase").alias("_lp"), F.col("f").alias("l"))
    rf = f.select(F.col("lang").alias("_rl"), F.col("phrase").alias("_rp"), F.col("f").alias("r"))
    exact = "decimal(38,0)"
    scored = (
        cuts.join(lf, (F.col("lang") == F.col("_ll")) & (F.col("lp") == F.col("_lp")))
        .join(rf, (F.col("lang") == F.col("_rl")) & (F.col("rp") == F.col("_rp")))
        .join(n, "lang")
        .select(
            "lang", "phrase", "a", "k", "l", "r", "n",
            F.expr(
                f"cast(1000 as {exact}) * cast(a as {exact}) * cast(n as {exact}) div (cast(l as {exact}) * cast(r as {exact}))"
            ).alias("score"),
        )
    )
    lowest = Window.partitionBy("lang", "phrase").orderBy("score", "k")
    best = scored.withColumn("_c", F.row_number().over(lowest)).filter("_c = 1").drop("_c", "k")
    # containment: sub-phrases of 2 or more words of every longer candidate, with the longer one's count
    inner = cands.filter(F.col("size") > SHORTEST).select(
        "lang", "a", "w", "size", F.explode(F.sequence(F.lit(SHORTEST), F.col("size") - 1)).alias("m")
    ).select("lang", "a", "w", "m", F.explode(F.sequence(F.lit(1), F.col("size") - F.col("m") + 1)).alias("at")).select(
        F.col("lang").alias("_il"), F.array_join(F.slice("w", F.col("at"), F.col("m")), " ").alias("_ip"), F.col("a").alias("_ia")
    ).groupBy("_il", "_ip").agg(F.max("_ia").alias("_longer"))
    kept = best.join(inner, (F.col("lang") == F.col("_il")) & (F.col("phrase") == F.col("_ip")), "left").filter(
        F.col("_longer").isNull() | (100 * F.col("_longer") < 100 * F.col("a"))
    )
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {TOP}")
    return ranked.select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", F.col("a").cast("long").alias("a"),
        F.col("l").cast("long").alias("l"), F.col("r").cast("long").alias("r"), F.col("n").cast("long").alias("n"),
        F.col("score").cast("long").alias("score"),
    )
