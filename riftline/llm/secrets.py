"""Secret scans (operator 6): rules give the base findings, a small character network judges every further candidate.

Candidates are all runs of 16 or more key characters that hold a digit, and all assignments to a secret's name that the
base rule drops as too short. The network sees the candidate and 24 characters on either side: embedded characters, one
convolution, the largest response before, inside and after the candidate, then one hidden layer. It is trained in numpy
on labelled findings: base findings of a bounded sample of documents against the other runs there, and as many generated
from a rule, so that a corpus without secrets trains too. Its logits are calibrated on held-out rows (a slope and an
offset), and the threshold is the largest that keeps a wanted recall there.

Defined cases: a null text counts as empty; texts are scanned whole; repeated rows give equal results; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riftline.llm.blocks import Block, blocks

KINDS = ("assign", "access", "hex", "model")
ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I)
NAME = re.compile(rb"password|passwd|secret|token|api_?key")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS, RUN_CHARS, SHORT_CHARS = 12, 18, 16, 16, 6

_HEX = np.zeros(256, dtype=bool)
_HEX[list(b"0123456789abcdef")] = True
_KEY = np.zeros(256, dtype=bool)
_KEY[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-=")] = True
_DIGIT = np.zeros(256, dtype=np.int64)
_DIGIT[list(b"0123456789")] = 1

# Candidates: a run of key characters, a short value assigned to a secret's name.
RUN, SHORT = 3, 4
SIDE, BODY = 24, 48
WIDTH = 2 * SIDE + BODY


def _runs(block: Block, table: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Longest runs of the table's bytes inside one text, of at least ``least`` bytes."""
    held = table[block.data]
    edge = np.zeros(len(held) + 1, dtype=bool)
    edge[block.at] = True
    before = np.concatenate([[False], held[:-1]])
    after = np.concatenate([held[1:], [False]])
    start = np.flatnonzero(held & (~before | edge[:-1]))
    end = np.flatnonzero(held & (~after | edge[1:])) + 1
    keep = end - start >= least
    return start[keep], end[keep]


def find(block: Block) -> list[tuple[int, int, int, int]]:
    """(row, kind, start, end) in bytes of the block, sorted; kinds from 3 are candidates of the model."""
    if not len(block.data):
        return []
    found = []
    raw = block.data.tobytes()
    low = raw.lower()
    at = block.at

    def rows(places):
        return (np.searchsorted(at, np.asarray(places, dtype=np.int64), side="right") - 1).tolist()

    named = [m.start() for m in NAME.finditer(low)]
    for row in sorted(set(rows(named))):
        a, b = int(at[row]), int(at[row + 1])
        for m in ASSIGN.finditer(raw, a, b):
            size = m.end(2) - m.start(2)
            if size >= ASSIGN_CHARS:
                found.append((row, 0, m.start(), m.end()))
            elif size >= SHORT_CHARS:
                found.append((row, SHORT, m.start(2), m.end(2)))
    keys = [(m.start(), m.end()) for m in ACCESS.finditer(raw)]
    for (a, b), row in zip(keys, rows([a for a, _ in keys]), strict=True):
        end = min(b, int(at[row + 1]))
        if end - a >= ACCESS_CHARS:
            found.append((row, 1, a, end))
        # a match that runs over the end of its text hides the next text's own beginning
        while end < b:
            row += 1
            again = ACCESS.match(raw, end, int(at[row + 1]))
            if again is not None and again.end() - end >= ACCESS_CHARS:
                found.append((row, 1, end, again.end()))
            inner = [m for m in ACCESS.finditer(raw, end, min(b, int(at[row + 1]))) if m.start() > end]
            found.extend((row, 1, m.start(), m.end()) for m in inner if m.end() - m.start() >= ACCESS_CHARS)
            end = min(b, int(at[row + 1]))
    start, end = _runs(block, _HEX, HEX_CHARS)
    found.extend((row, 2, a, b) for row, a, b in zip(rows(start), start.tolist(), end.tolist(), strict=True))
    start, end = _runs(block, _KEY, RUN_CHARS)
    if len(start):
        digits = np.concatenate([[0], np.cumsum(_DIGIT[block.data])])
        keep = digits[end] > digits[start]
        start, end = start[keep], end[keep]
        found.extend((row, RUN, a, b) for row, a, b in zip(rows(start), start.tolist(), end.tolist(), strict=True))
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    # A candidate that touches a base finding is found already.
    base: dict[int, list[tuple[int, int]]] = {}
    for row, kind, a, b in found:
        if kind < 3:
            base.setdefault(row, []).append((a, b))
    kept, reach = [], (-1, -1)
    for row, kind, a, b in found:
        if kind >= RUN:
            if any(a < y and x < b for x, y in base.get(row, ())):
                continue
            if row == reach[0] and a < reach[1]:
                continue
            reach = (row, b)
        kept.append((row, kind, a, b))
    return kept


def window(raw: bytes, low: int, high: int, a: int, b: int) -> bytes:
    """The candidate [a, b) with its surroundings inside the text [low, high), padded with zero bytes; the middle of a
    long candidate is left out."""
    before = raw[max(low, a - SIDE):a].rjust(SIDE, b"\0")
    after = raw[b:min(high, b + SIDE)].ljust(SIDE, b"\0")
    body = raw[a:b] if b - a <= BODY else raw[a:a + BODY // 2] + raw[b - BODY // 2:b]
    return before + body.ljust(BODY, b"\0") + after


@dataclass
class CharNet:
    """Embedding, one convolution, maximum per part of the window, one hidden layer."""

    weights: list[np.ndarray]
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5
    TAPS = 5

    @classmethod
    def new(cls, seed: int, embed: int = 8, filters: int = 24, hidden: int = 16) -> CharNet:
        draw = np.random.default_rng(seed)
        return cls([
            draw.normal(0, 0.5, (128, embed)),
            draw.normal(0, 1 / np.sqrt(cls.TAPS * embed), (cls.TAPS * embed, filters)), np.zeros(filters),
            draw.normal(0, 1 / np.sqrt(3 * filters), (3 * filters, hidden)), np.zeros(hidden),
            draw.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1),
        ])

    # The parts over which the largest response is taken, as places of the convolution's output.
    PARTS = ((0, SIDE), (SIDE, SIDE + BODY), (SIDE + BODY, WIDTH))

    def _forward(self, codes: np.ndarray):
        table, kernel, shift, dense, bias, out, base = self.weights
        n = len(codes)
        half = self.TAPS // 2
        padded = np.zeros((n, WIDTH + 2 * half), dtype=np.int64)
        padded[:, half:half + WIDTH] = codes
        embedded = table[padded]
        taps = np.stack([embedded[:, t:t + WIDTH] for t in range(self.TAPS)], axis=2).reshape(n * WIDTH, -1)
        response = np.maximum(taps @ kernel + shift, 0).reshape(n, WIDTH, -1)
        tops = [a + response[:, a:b].argmax(axis=1) for a, b in self.PARTS]
        pooled = np.concatenate([np.take_along_axis(response, top[:, None], axis=1)[:, 0] for top in tops], axis=1)
        middle = np.maximum(pooled @ dense + bias, 0)
        return padded, taps, tops, pooled, middle, middle @ out + base[0]

    @staticmethod
    def codes(windows: list[bytes]) -> np.ndarray:
        return np.minimum(np.frombuffer(b"".join(windows), dtype=np.uint8).reshape(-1, WIDTH), 127).astype(np.int64)

    def train(self, codes: np.ndarray, label: np.ndarray, *, epochs: int, seed: int, rate: float = 0.003, step: int = 128) -> None:
        """Adam on the logistic loss."""
        draw = np.random.default_rng(seed)
        first = [np.zeros_like(w) for w in self.weights]
        second = [np.zeros_like(w) for w in self.weights]
        t = 0
        for _ in range(epochs):
            order = draw.permutation(len(codes))
            for low in range(0, len(codes), step):
                rows = order[low:low + step]
                t += 1
                for w, g, m, v in zip(self.weights, self._gradient(codes[rows], label[rows]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)

    def _gradient(self, codes: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        table, kernel, shift, dense, bias, out, base = self.weights
        padded, taps, tops, pooled, middle, logit = self._forward(codes)
        n, filters = len(codes), len(shift)
        miss = (1 / (1 + np.exp(-np.clip(logit, -40, 40))) - label) / n
        to_middle = miss[:, None] * out * (middle > 0)
        to_pooled = (to_middle @ dense.T) * (pooled > 0)
        kernel_grad, table_grad = np.zeros_like(kernel), np.zeros_like(table)
        embed = table.shape[1]
        cells = taps.reshape(n, WIDTH, -1)
        for part, top in enumerate(tops):
            share = to_pooled[:, part * filters:(part + 1) * filters]
            for f in range(filters):
                chosen = cells[np.arange(n), top[:, f]]
                kernel_grad[:, f] += share[:, f] @ chosen
                back = (share[:, f, None] * kernel[:, f]).reshape(n, self.TAPS, embed)
                for tap in range(self.TAPS):
                    np.add.at(table_grad, padded[np.arange(n), top[:, f] + tap], back[:, tap])
        return [
            table_grad, kernel_grad, np.sum([to_pooled[:, p * filters:(p + 1) * filters].sum(axis=0) for p in range(3)], axis=0),
            pooled.T @ to_middle, to_middle.sum(axis=0), middle.T @ miss, np.array([miss.sum()]),
        ]

    def probability(self, codes: np.ndarray) -> np.ndarray:
        parts = [self._forward(codes[low:low + 512])[-1] for low in range(0, len(codes), 512)]
        logit = np.concatenate(parts) if parts else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.slope * logit + self.offset, -40, 40)))

    def calibrate(self, codes: np.ndarray, label: np.ndarray, recall: float) -> None:
        """Fits slope and offset to held-out rows by Newton steps, then sets the largest threshold with that recall."""
        self.slope, self.offset = 1.0, 0.0
        logit = np.concatenate([self._forward(codes[low:low + 512])[-1] for low in range(0, len(codes), 512)])
        x = np.column_stack([logit, np.ones(len(logit))])
        w = np.array([1.0, 0.0])
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            pull = x.T @ (p - label) + 1e-2 * (w - [1.0, 0.0])
            curve = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
            w = w - np.linalg.solve(curve, pull)
        self.slope, self.offset = float(max(w[0], 1e-3)), float(w[1])
        hits = np.sort(self.probability(codes[label > 0]))
        self.threshold = float(hits[int(np.floor((1 - recall) * len(hits)))]) if len(hits) else 0.5


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FORMS = (  # characters and length of a generated secret
    ("0123456789abcdef", 32, 64), (_LETTERS + _LETTERS.upper() + "0123456789", 16, 48),
    (_LETTERS + _LETTERS.upper() + "0123456789+/", 24, 64), (_LETTERS.upper() + "234567", 16, 32),
    (_LETTERS + _LETTERS.upper() + "0123456789_-", 20, 44), (_LETTERS + _LETTERS.upper() + "0123456789", 6, 11),
)
_LEADS = ("key ", "password=", "token: ", "secret = ", "api_key=", "auth ", "", "use ", "export KEY=", "\"")


def generated(rows: int, seed: int) -> tuple[list[bytes], list[int]]:
    """Labelled windows from a rule: random keys against words, numbers, dates, addresses, names with digits."""
    draw = np.random.default_rng(seed)

    def some(chars, low, high):
        return "".join(draw.choice(list(chars), int(draw.integers(low, high + 1))))

    def words(n):
        return " ".join(some(_LETTERS, 2, 9) for _ in range(n))

    windows, label = [], []
    for i in range(rows):
        if i % 2:
            chars, low, high = _FORMS[int(draw.integers(len(_FORMS)))]
            body = some(chars, low, high)
            lead = _LEADS[int(draw.integers(1, 5))] if high < 12 else _LEADS[int(draw.integers(len(_LEADS)))]
        else:
            form = int(draw.integers(7))
            lead = _LEADS[int(draw.integers(len(_LEADS)))] if form == 0 else ""
            body = (
                some(_LETTERS, 6, 10), "_".join(some(_LETTERS, 3, 8) for _ in range(3)) + "_" + some("0123456789", 1, 2),
                some("0123456789", 16, 20), some(_LETTERS, 14, 20) + some("0123456789", 1, 3),
                "20" + some("0123456789", 2, 2) + "-01-0" + some("123456789", 1, 1) + "_" + some(_LETTERS, 8, 12),
                "-".join(some(_LETTERS, 4, 9) for _ in range(3)) + "-" + some("0123456789", 1, 4),
                "/".join(some(_LETTERS, 3, 8) for _ in range(3)) + "/" + some("0123456789", 1, 5),
            )[form]
        text = f"{words(6)} {lead}".encode()
        raw = text + body.encode() + f" {words(6)}".encode()
        windows.append(window(raw, 0, len(raw), len(text), len(text) + len(body)))
        label.append(i % 2)
    return windows, label


def fit_network(docs: DataFrame, *, rows: int = 1500, made: int = 3000, recall: float = 0.98, epochs: int = 5, seed: int = 6) -> CharNet:
    """Trains on the findings of at most ``rows`` documents that name a secret, drawn by a hash of doc_id, and on
    ``made`` generated ones; a fifth is held out for the calibration."""
    hint = F.lit(False)
    for name in ("AKIA", "password", "passwd", "secret", "token", "api_key", "apikey"):
        hint = hint | F.contains("text", F.lit(name))
    drawn = docs.filter(hint).select("doc_id").distinct().orderBy(F.xxhash64(F.lit(seed), "doc_id"), "doc_id").limit(rows)
    ids = [row.doc_id for row in drawn.collect() if row.doc_id is not None]

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                raw, name = block.data.tobytes(), part.column("doc_id").to_pylist()
                found = [x for x in find(block) if x[1] != SHORT]  # of unknown label: the generated rows teach them
                yield pa.RecordBatch.from_arrays([
                    pa.array([name[row] for row, _, _, _ in found], pa.int64()),
                    pa.array([window(raw, int(block.at[row]), int(block.at[row + 1]), a, b) for row, _, a, b in found], pa.binary()),
                    pa.array([int(kind < 3) for _, kind, _, _ in found], pa.int32()),
                ], names=["doc_id", "window", "label"])

    windows, label = generated(made, seed)
    if ids:
        few = docs.select("doc_id", "text").filter(F.col("doc_id").isin(ids))
        seen = few.mapInArrow(labelled, "doc_id long, window binary, label int").distinct()
        seen = seen.orderBy(F.xxhash64("doc_id", "window"), "window", "label").limit(4 * rows).collect()
        for row in seen:
            windows.append(bytes(row.window))
            label.append(row.label)
    codes, target = CharNet.codes(windows), np.array(label, dtype=float)
    held = np.arange(len(codes)) % 5 == 0
    net = CharNet.new(seed)
    net.train(codes[~held], target[~held], epochs=epochs, seed=seed)
    net.calibrate(codes[held], target[held], recall)
    return net


def findings(block: Block, net: CharNet) -> list[list[tuple[int, int, int]]]:
    """Per row the base findings and the candidates that the network accepts: (kind, start, end) in bytes of the block."""
    raw, found = block.data.tobytes(), find(block)
    asked = [i for i, x in enumerate(found) if x[1] >= RUN]
    codes = CharNet.codes([
        window(raw, int(block.at[found[i][0]]), int(block.at[found[i][0] + 1]), *found[i][2:]) for i in asked
    ])
    odds = dict(zip(asked, net.probability(codes).tolist(), strict=True))
    spans: list[list[tuple[int, int, int]]] = [[] for _ in range(block.size)]
    for i, (row, kind, a, b) in enumerate(found):
        if kind < RUN or odds[i] >= net.threshold:
            spans[row].append((min(kind, RUN), a, b))
    return spans


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_model long, base_sha256 string, spans string"


def scan(docs: DataFrame, net: CharNet) -> DataFrame:
    """Findings per document: counts, and ``kind:start:end`` in code points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
                base, every, counts = [], [], np.zeros((4, block.size), dtype=np.int64)
                for row, some in enumerate(findings(block, net)):
                    zero = chars[block.at[row]]
                    said = [f"{KINDS[k]}:{chars[a] - zero}:{chars[b] - zero}" for k, a, b in some]
                    for k, _, _ in some:
                        counts[k, row] += 1
                    base.append(hashlib.sha256(",".join(s for s, x in zip(said, some, strict=True) if x[0] < RUN).encode()).hexdigest())
                    every.append(",".join(said))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *[pa.array(c) for c in counts], pa.array(base, pa.string()),
                     pa.array(every, pa.string())],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "n_model", "base_sha256", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def redact(docs: DataFrame, net: CharNet, mask: str = "[SECRET]") -> DataFrame:
    """The documents with every finding replaced (overlapping ones by one mask), n_chars anew, else as they were."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, block in blocks(batch, "text"):
                raw = block.data.tobytes()
                texts, touched = part.column("text").to_pylist(), False
                for row, some in enumerate(findings(block, net)):
                    if not some:
                        continue
                    out, at = [], int(block.at[row])
                    for _, a, b in some:
                        if a >= at:
                            out += [raw[at:a], mask.encode()]
                        at = max(at, b)
                    texts[row] = (b"".join(out) + raw[at:int(block.at[row + 1])]).decode(errors="replace")
                    touched = True
                if touched:
                    place = part.schema.get_field_index("text")
                    part = part.set_column(place, part.schema.field(place), pa.array(texts, part.schema.field(place).type))
                    if "n_chars" in part.schema.names:
                        place = part.schema.get_field_index("n_chars")
                        sizes = [None if text is None else len(text) for text in texts]
                        part = part.set_column(place, part.schema.field(place), pa.array(sizes, part.schema.field(place).type))
                yield part

    return docs.mapInArrow(run, docs.schema)
