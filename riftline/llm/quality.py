"""Quality rules (operator 7): statistics of a text, an isolation forest over them, thresholds from labelled rows.

Every text is measured whole. The forest learns the statistics of documents labelled as good: a document that random
splits separate early from these is an anomaly. The score above which a document is rejected is calibrated on labelled
good rows that the trees have not seen.

Defined cases: a null text counts as empty; a text with fewer than ten words fails the base rule; repeated rows are
judged alike, one result each; an empty table gives an empty result; other columns are ignored. Without labelled good
rows the forest learns from a sample of all documents that pass the base rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riftline.llm.blocks import Block, Words, blocks, mix, rolling
from riftline.llm.shared import stored

SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
REPEAT_PERCENT = 20
PRIOR = 20

STATS = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "n_lines long, n_upper long, n_shouts long, n_marked long"
)
NAMES = [part.split()[0] for part in STATS.split(", ")]


def _table(chars: bytes) -> np.ndarray:
    held = np.zeros(256, dtype=np.int64)
    held[list(chars)] = 1
    return held


_SYMBOL, _UPPER, _SHOUT = _table(SYMBOLS), _table(bytes(range(65, 91))), _table(b"!?")
_LETTER_START = np.ones(256, dtype=np.int64)
_LETTER_START[0x80:0xC0] = 0


def _per_row(block: Block, flags: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, dtype=np.int64)
    np.cumsum(flags, out=total[1:])
    return total[block.at[1:]] - total[block.at[:-1]]


def _repeat_words(words: Words) -> np.ndarray:
    """Words of each row that lie in a window of five words found twice or more in that row."""
    counts, n = words.counts, len(words.start)
    row = np.repeat(np.arange(len(counts)), counts)
    covered = np.zeros(n + 1, dtype=np.int64)
    gram = rolling(words.hashes(), WINDOW)
    if len(gram):
        whole = row[:len(gram)] == row[WINDOW - 1:]
        at = np.flatnonzero(whole)
        key = mix(gram[at] + row[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(at), dtype=bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = at[order[twice]]
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + WINDOW, -1)
    inside = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(np.cumsum(covered[:n]) > 0, out=inside[1:])
    return inside[words.first[1:]] - inside[words.first[:-1]]


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word, and how many of them equal an earlier line."""
    with_word = [line for line in text.split(b"\n") if line.strip(b" \t\r\n\x0b\x0c")]
    return len(with_word), len(with_word) - len(set(with_word))


def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, block in blocks(batch, "text"):
            words = Words(block)
            lines = np.array([_lines(block.text(i)) for i in range(block.size)], dtype=np.int64).reshape(-1, 2)
            marked = np.zeros(len(words.start) + 1, dtype=np.int64)
            if len(words.start):
                last = block.data[words.end - 1]
                np.cumsum(_SYMBOL[last] | _SHOUT[last], out=marked[1:])
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id").cast(pa.int64()),
                pa.array(words.counts),
                pa.array(_per_row(block, _LETTER_START[block.data] * words.inside)),
                pa.array(_per_row(block, _SYMBOL[block.data])),
                pa.array(lines[:, 1]),
                pa.array(_repeat_words(words)),
                pa.array(lines[:, 0]),
                pa.array(_per_row(block, _UPPER[block.data])),
                pa.array(_per_row(block, _SHOUT[block.data])),
                pa.array(marked[words.first[1:]] - marked[words.first[:-1]]),
            ], names=NAMES)


def text_statistics(docs: DataFrame) -> DataFrame:
    """One row of statistics per document."""
    return docs.select("doc_id", "text").mapInArrow(measure, STATS)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))


def rates(stats: dict[str, np.ndarray]) -> np.ndarray:
    """What the forest sees: shares that do not depend on the length of the text.

    ``PRIOR`` ordinary words are added to each text, so that one odd word does not make a short text odd.
    """
    words = stats["n_words"] + PRIOR
    return np.column_stack([
        (stats["word_chars"] + 5 * PRIOR) / words,
        stats["n_symbols"] / words,
        stats["n_dup_lines"] / (stats["n_lines"] + 1),
        stats["n_repeat_words"] / words,
        stats["n_upper"] / (stats["word_chars"] + 5 * PRIOR),
        stats["n_shouts"] / words,
        stats["n_marked"] / words,
    ]).astype(float)


@dataclass
class Forest:
    """Random trees as flat arrays: feature (-1 at a leaf), cut, left and right child, expected depth at the leaf."""

    trees: list[tuple[np.ndarray, ...]] = field(default_factory=list)
    sample: int = 256

    @staticmethod
    def _expected(n: int) -> float:
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, trees: int, sample: int, seed: int) -> Forest:
        draw = np.random.default_rng(seed)
        size = min(sample, len(x))
        forest = cls(sample=size)
        most = int(np.ceil(np.log2(max(size, 2))))
        for _ in range(trees):
            feature, cut, left, right, depth = [], [], [], [], []

            def grow(rows, level):
                me = len(feature)
                for held, value in ((feature, -1), (cut, 0.0), (left, 0), (right, 0), (depth, level + cls._expected(len(rows)))):
                    held.append(value)
                low, high = rows.min(axis=0), rows.max(axis=0)
                open_ = np.flatnonzero(high > low)
                if level >= most or len(rows) < 2 or not len(open_):
                    return me
                f = int(draw.choice(open_))
                c = float(draw.uniform(low[f], high[f]))
                feature[me], cut[me] = f, c
                below = rows[:, f] <= c
                left[me] = grow(rows[below], level + 1)
                right[me] = grow(rows[~below], level + 1)
                return me

            grow(x[draw.choice(len(x), size, replace=False)], 0)
            forest.trees.append(tuple(map(np.array, (feature, cut, left, right, depth))))
        return forest

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): near 1 for what is separated early."""
        total = np.zeros(len(x))
        every = np.arange(len(x))
        for feature, cut, left, right, depth in self.trees:
            node = np.zeros(len(x), dtype=np.int64)
            while True:
                f = feature[node]
                if (f < 0).all():
                    break
                value = x[every, np.maximum(f, 0)]
                node = np.where(f < 0, node, np.where(value <= cut[node], left[node], right[node]))
            total += depth[node]
        return 2.0 ** (-(total / max(len(self.trees), 1)) / max(self._expected(self.sample), 1e-9))


@dataclass
class QualityModel:
    forest: Forest
    low: np.ndarray
    high: np.ndarray
    threshold: float

    def anomaly(self, x: np.ndarray) -> np.ndarray:
        """The forest's score, plus how far a share lies outside what good documents show, in their own spans: a
        tree puts all values past its last cut in one leaf, which alone would hide how far out they are."""
        span = np.maximum(self.high - self.low, 0.05)
        beyond = np.maximum(np.maximum(self.low - x, x - self.high) / span, 0).max(axis=1)
        return self.forest.score(x) + beyond


def fit_quality(
    stats: DataFrame, labels: DataFrame | None, *, rows: int = 4000, trees: int = 100, sample: int = 256,
    keep_share: float = 0.999, seed: int = 7,
) -> QualityModel | None:
    """Fits on at most ``rows`` labelled good documents, drawn by a hash of doc_id; half train, half calibrate.

    The threshold is the score that ``keep_share`` of the calibrating rows stay at or under. None when there is
    nothing to learn from.
    """
    passed = stats.filter(~base_failed())
    good = passed
    if labels is not None:
        named = labels.filter(F.col("quality") == 1).select(F.col("doc_id").alias("_id")).distinct()
        good = passed.join(named, F.col("doc_id") == F.col("_id"), "left_semi")
    drawn = good.orderBy(F.xxhash64(F.lit(seed), "doc_id"), *NAMES).limit(rows).toPandas()
    if labels is not None and not len(drawn):
        return fit_quality(stats, None, rows=rows, trees=trees, sample=sample, keep_share=keep_share, seed=seed)
    if not len(drawn):
        return None
    x = rates({name: drawn[name].to_numpy() for name in NAMES})
    train, calibrate = (x[::2], x[1::2]) if len(x) > 1 else (x, x)
    low, high = np.quantile(train, [0.005, 0.995], axis=0)
    model = QualityModel(Forest.fit(train, trees, sample, seed), low, high, 0.0)
    model.threshold = float(np.quantile(model.anomaly(calibrate), keep_share, method="higher"))
    return model


def verdicts(stats: pa.RecordBatch, model: QualityModel | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly and kept of each row of statistics."""
    held = {name: stats.column(name).to_numpy(zero_copy_only=False) for name in NAMES if name != "doc_id"}
    failed = (held["n_words"] < MIN_WORDS) | (100 * held["n_repeat_words"] > REPEAT_PERCENT * held["n_words"])
    if model is None:
        return failed, np.zeros(len(failed)), ~failed
    score = model.anomaly(rates(held))
    return failed, score, ~failed & (score <= model.threshold)


def judge(stats: DataFrame, model: QualityModel | None) -> DataFrame:
    """Adds base_failed, anomaly and kept to the statistics."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, *map(pa.array, verdicts(batch, model))],
                names=[*batch.schema.names, "base_failed", "anomaly", "kept"],
            )

    return stats.mapInArrow(run, f"{STATS}, base_failed boolean, anomaly double, kept boolean")


def passing(docs: DataFrame, labels: DataFrame | None, **fit) -> DataFrame:
    """The documents that pass, all columns as they were. Texts are measured again where they are: a second pass over
    them is cheaper than a shuffle of them to meet the verdicts."""
    model = fit_quality(stored(text_statistics(docs), "quality_stats"), labels, **fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for stats in measure([batch]):
                yield batch.slice(at, stats.num_rows).filter(pa.array(verdicts(stats, model)[2]))
                at += stats.num_rows

    return docs.mapInArrow(run, docs.schema)


def quality_rules(docs: DataFrame, labels: DataFrame | None, **fit) -> DataFrame:
    """Statistics and verdict of every document; texts are measured once, then the narrow table is read twice."""
    stats = stored(text_statistics(docs), "quality_stats")
    return judge(stats, fit_quality(stats, labels, **fit))

