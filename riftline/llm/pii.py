"""Personal data (operator 12): rule spans, and a character BiLSTM with CRF transitions that adds spans of its own.

Base spans are the leftmost non-overlapping matches of one pattern per kind, dropped when they fail their check (IP parts
at most 255; cards of 14 to 19 digits passing Luhn; phones of 10 to 15 digits), without a retry inside a dropped match.

The method: a character-level bidirectional LSTM whose per-character tag scores feed a linear-chain CRF (tags O, and B/I
per kind). It is trained in numpy, by backpropagation through time and the CRF's forward-backward gradient, on labelled
windows: the base spans of a bounded sample of windows from the corpus (``windows``, a documented parameter), drawn by a
hash of doc_id and place so reruns agree. At inference every text is read whole: each run of digits or ``@`` (all of
them, none skipped) opens a region of ``CONTEXT`` characters on either side, regions are cut into windows of ``WIDTH``
characters overlapping by half, every window is decoded by Viterbi, and each character takes its tag from the window in
which it lies farthest from an edge (global reconciliation). Model spans that overlap no base span are added.

Defined cases: a null text counts as empty (no spans, the hash of the empty string); a null doc_id is kept as null;
repeated rows give equal results, one row each; very long texts are read whole in windows; an empty table gives an empty
result; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
# The contract's patterns, in the order of KINDS.
PATTERNS = (
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
)
TAGS = 1 + 2 * len(KINDS)  # O, then B and I per kind
WIDTH, CONTEXT = 48, 24
HOT = re.compile(r"[0-9@]+")
VOCAB = 130  # ASCII code points, one for every other character, one for padding
PAD = VOCAB - 1


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = int(d) * (2 if i % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def _passes(kind: int, found: str) -> bool:
    if kind == 1:
        return all(int(part) <= 255 for part in found.split("."))
    digits = sum(c.isdigit() for c in found)
    if kind == 2:
        return 14 <= digits <= 19 and luhn("".join(c for c in found if c.isdigit()))
    if kind == 3:
        return 10 <= digits <= 15
    return True


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the rule findings, in code points, sorted by start then kind."""
    out = [
        (m.start(), kind, m.end())
        for kind, pattern in enumerate(PATTERNS)
        for m in pattern.finditer(text)
        if _passes(kind, m.group())
    ]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def codes(text: str) -> np.ndarray:
    raw = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32) if text else np.zeros(0, np.uint32)
    return np.where(raw < 128, raw, 128).astype(np.int64)


def tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n, dtype=np.int64)
    for s, k, e in spans:
        tags[s:e] = 2 + 2 * k
        tags[s] = 1 + 2 * k
    return tags


def regions(text: str) -> list[tuple[int, int]]:
    """Window starts and ends covering every digit or ``@`` run with its context, windows overlapping by half."""
    out, n = [], len(text)
    spans = []
    for m in HOT.finditer(text):
        lo, hi = max(0, m.start() - CONTEXT), min(n, m.end() + CONTEXT)
        if spans and lo <= spans[-1][1]:
            spans[-1][1] = max(spans[-1][1], hi)
        else:
            spans.append([lo, hi])
    for lo, hi in spans:
        start = lo
        while True:
            out.append((start, start + WIDTH))
            if start + WIDTH >= hi:
                break
            start += WIDTH // 2
    return out


def _sig(x):
    return 1.0 / (1.0 + np.exp(-np.clip(x, -30, 30)))


def _lse(x, axis):
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


@dataclass
class Tagger:
    """Weights of the BiLSTM-CRF; ``params`` maps names to arrays."""

    params: dict

    @staticmethod
    def fresh(seed: int, emb: int = 16, hidden: int = 24) -> Tagger:
        draw = np.random.default_rng(seed)

        def w(*shape):
            return draw.normal(0, 1 / np.sqrt(shape[-1]), shape)

        p = {"E": w(VOCAB, emb) * 0.5}
        for d in "fb":
            p[f"W{d}"] = w(4 * hidden, emb + hidden)
            p[f"b{d}"] = np.zeros(4 * hidden)
            p[f"b{d}"][hidden : 2 * hidden] = 1.0  # forget gates open at first
        p["O"], p["o"] = w(TAGS, 2 * hidden), np.zeros(TAGS)
        p["A"], p["s"], p["e"] = np.zeros((TAGS, TAGS)), np.zeros(TAGS), np.zeros(TAGS)
        return Tagger(p)

    def _lstm(self, x, d, keep):
        W, b = self.params[f"W{d}"], self.params[f"b{d}"]
        B, L, _ = x.shape
        H = W.shape[0] // 4
        h, c = np.zeros((B, H)), np.zeros((B, H))
        hs, cache = np.zeros((B, L, H)), []
        steps = range(L) if d == "f" else range(L - 1, -1, -1)
        for t in steps:
            z = np.concatenate([x[:, t], h], axis=1)
            a = z @ W.T + b
            i, f, o, g = _sig(a[:, :H]), _sig(a[:, H : 2 * H]), _sig(a[:, 2 * H : 3 * H]), np.tanh(a[:, 3 * H :])
            c_prev = c
            c = f * c + i * g
            h = o * np.tanh(c)
            hs[:, t] = h
            if keep:
                cache.append((t, z, i, f, o, g, c_prev, c))
        return hs, cache

    def emissions(self, ids, keep=False):
        x = self.params["E"][ids]
        hf, cf = self._lstm(x, "f", keep)
        hb, cb = self._lstm(x, "b", keep)
        hcat = np.concatenate([hf, hb], axis=2)
        U = hcat @ self.params["O"].T + self.params["o"]
        return U, (ids, x, hcat, cf, cb)

    def viterbi(self, U):
        A, s, e = self.params["A"], self.params["s"], self.params["e"]
        B, L, T = U.shape
        delta = s + U[:, 0]
        back = np.zeros((B, L, T), dtype=np.int64)
        for t in range(1, L):
            cand = delta[:, :, None] + A[None]
            back[:, t] = cand.argmax(axis=1)
            delta = cand.max(axis=1) + U[:, t]
        best = np.zeros((B, L), dtype=np.int64)
        best[:, -1] = (delta + e).argmax(axis=1)
        for t in range(L - 1, 0, -1):
            best[:, t - 1] = back[np.arange(B), t, best[:, t]]
        return best

    def loss_grad(self, ids, y):
        """Mean negative log-likelihood of the gold tags and its gradient."""
        p = self.params
        A, s, e = p["A"], p["s"], p["e"]
        U, (ids, x, hcat, cf, cb) = self.emissions(ids, keep=True)
        B, L, T = U.shape
        alpha = np.zeros((B, L, T))
        alpha[:, 0] = s + U[:, 0]
        for t in range(1, L):
            alpha[:, t] = _lse(alpha[:, t - 1][:, :, None] + A[None], 1) + U[:, t]
        beta = np.zeros((B, L, T))
        beta[:, -1] = e
        for t in range(L - 2, -1, -1):
            beta[:, t] = _lse(A[None] + (U[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        logz = _lse(alpha[:, -1] + e, 1)
        rows = np.arange(B)[:, None]
        gold = U[rows, np.arange(L)[None], y].sum(1) + A[y[:, :-1], y[:, 1:]].sum(1) + s[y[:, 0]] + e[y[:, -1]]
        loss = float((logz - gold).mean())
        marg = np.exp(alpha + beta - logz[:, None, None])
        onehot = np.eye(T)[y]
        dU = (marg - onehot) / B
        pair = np.exp(alpha[:, :-1, :, None] + A[None, None] + (U[:, 1:] + beta[:, 1:])[:, :, None, :] - logz[:, None, None, None])
        dA = pair.sum((0, 1)) / B
        np.add.at(dA, (y[:, :-1].ravel(), y[:, 1:].ravel()), -1.0 / B)
        ds = (marg[:, 0] - onehot[:, 0]).sum(0) / B
        de = (marg[:, -1] - onehot[:, -1]).sum(0) / B
        grads = {"A": dA, "s": ds, "e": de, "O": np.einsum("blt,blh->th", dU, hcat), "o": dU.sum((0, 1))}
        dh = dU @ p["O"]
        H = dh.shape[2] // 2
        dx = np.zeros_like(x)
        for d, cache, dhd in (("f", cf, dh[:, :, :H]), ("b", cb, dh[:, :, H:])):
            W = p[f"W{d}"]
            E = x.shape[2]
            dW, db = np.zeros_like(W), np.zeros(W.shape[0])
            dh_next, dc_next = np.zeros((B, H)), np.zeros((B, H))
            for t, z, i, f, o, g, c_prev, c in reversed(cache):
                dht = dhd[:, t] + dh_next
                tc = np.tanh(c)
                do = dht * tc
                dc = dht * o * (1 - tc**2) + dc_next
                di, df, dg = dc * g, dc * c_prev, dc * i
                da = np.concatenate([di * i * (1 - i), df * f * (1 - f), do * o * (1 - o), dg * (1 - g**2)], axis=1)
                dW += da.T @ z
                db += da.sum(0)
                dz = da @ W
                dx[:, t] += dz[:, :E]
                dh_next, dc_next = dz[:, E:], dc * f
            grads[f"W{d}"], grads[f"b{d}"] = dW, db
        dE = np.zeros_like(p["E"])
        np.add.at(dE, ids.ravel(), dx.reshape(-1, dx.shape[2]))
        grads["E"] = dE
        return loss, grads

    def fit(self, ids, y, epochs: int = 30, batch: int = 64, rate: float = 0.02, seed: int = 0) -> list[float]:
        """Adam over shuffled batches; returns the mean loss of each epoch."""
        draw = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.params.items()}
        v = {k: np.zeros_like(v) for k, v in self.params.items()}
        step, losses = 0, []
        for _ in range(epochs):
            order = draw.permutation(len(ids))
            total = []
            for lo in range(0, len(ids), batch):
                pick = order[lo : lo + batch]
                loss, grads = self.loss_grad(ids[pick], y[pick])
                total.append(loss)
                step += 1
                for k, g in grads.items():
                    g = np.clip(g, -5, 5)
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.params[k] -= rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            losses.append(float(np.mean(total)) if total else 0.0)
        return losses

    def tag(self, text: str, chunk: int = 1024) -> np.ndarray:
        """A tag per character, every window decoded by Viterbi and reconciled by distance from its edges."""
        n = len(text)
        tags = np.zeros(n, dtype=np.int64)
        places = regions(text)
        if not places:
            return tags
        full = np.concatenate([codes(text), np.full(WIDTH, PAD)])
        depth = np.full(n, -1)
        for lo in range(0, len(places), chunk):
            part = places[lo : lo + chunk]
            ids = np.stack([full[s : s + WIDTH] for s, _ in part])
            best = self.viterbi(self.emissions(ids)[0])
            for (s, _), row in zip(part, best, strict=True):
                end = min(s + WIDTH, n)
                at = np.arange(s, end)
                d = np.minimum(at - s, s + WIDTH - 1 - at)
                better = d > depth[s:end]
                tags[s:end][better] = row[: end - s][better]
                depth[s:end][better] = d[better]
        return tags


def spans_of(tags: np.ndarray) -> list[tuple[int, int, int]]:
    out, t, n = [], 0, len(tags)
    while t < n:
        tag = tags[t]
        if tag == 0:
            t += 1
            continue
        kind, end = (tag - 1) // 2, t + 1
        while end < n and tags[end] == 2 + 2 * kind:
            end += 1
        out.append((t, int(kind), end))
        t = end
    return out


def found(text: str, tagger: Tagger) -> tuple[list, list]:
    """(base spans, all spans): model spans that overlap no base span are added."""
    base = base_spans(text)
    cover = np.zeros(len(text) + 1, dtype=bool)
    for s, _, e in base:
        cover[s:e] = True
    extra = [sp for sp in spans_of(tagger.tag(text)) if not cover[sp[0] : sp[2]].any()]
    return base, sorted(base + extra)


def _windows(seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                text = text or ""
                tags = tags_of(len(text), base_spans(text))
                for s, _ in regions(text):
                    key = hashlib.blake2b(f"{seed}:{doc_id}:{s}".encode(), digest_size=8).digest()
                    ids = codes(text[s : s + WIDTH])
                    t = tags[s : s + WIDTH]
                    out.append((int.from_bytes(key, "little", signed=True), np.pad(ids, (0, WIDTH - len(ids)), constant_values=PAD).tolist(),
                                np.pad(t, (0, WIDTH - len(t))).tolist()))
            yield pd.DataFrame(out, columns=["key", "ids", "tags"])

    return run


def fit_tagger(docs: DataFrame, *, windows: int = 2000, epochs: int = 30, seed: int = 12) -> Tagger:
    """The tagger trained on ``windows`` labelled windows (a bounded sample of all candidate windows, by hash)."""
    found_windows = docs.select("doc_id", "text").mapInPandas(_windows(seed), "key long, ids array<long>, tags array<long>")
    # the threshold key of the sample first, so that only the drawn windows reach the driver
    edge = found_windows.select("key").orderBy("key").limit(windows).agg(F.max("key")).first()[0]
    drawn = [] if edge is None else sorted(found_windows.filter(F.col("key") <= edge).collect(), key=lambda r: r["key"])[:windows]
    tagger = Tagger.fresh(seed)
    if drawn:
        ids = np.array([r["ids"] for r in drawn], dtype=np.int64)
        y = np.array([r["tags"] for r in drawn], dtype=np.int64)
        tagger.fit(ids, y, epochs=epochs, seed=seed)
    return tagger


def _scan(tagger: Tagger):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in batches:
            out = []
            for doc_id, text in zip(frame["doc_id"], frame["text"], strict=True):
                base, spans = found(text or "", tagger)
                counts = [sum(1 for _, k, _ in base if k == kind) for kind in range(len(KINDS))]
                out.append((doc_id, *counts, hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans)))
            yield pd.DataFrame(out, columns=["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]).astype({"doc_id": "Int64"})

    return run


def scan_pii(docs: DataFrame, tagger: Tagger) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256 and spans of every document."""
    schema = "doc_id long, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInPandas(_scan(tagger), schema)
