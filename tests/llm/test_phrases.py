"""Collocations against a plain count of all n-grams in Python integers."""

import collections
from pathlib import Path

import numpy as np

from riftline.llm import phrases
from riftline.llm.phrases import collocations, pieces
from riftline.session import ensure_checkpoint_dir
from tests.llm.helpers import awkward, nothing


def plain(rows, least=100, top=2000):
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in pieces(text):
            n[lang] += len(piece)
            for d in range(1, 6):
                for i in range(len(piece) - d + 1):
                    f[(lang, " ".join(piece[i : i + d]))] += 1
    cands = {k: v for k, v in f.items() if v >= least and 2 <= len(k[1].split(" ")) <= 5}
    out = []
    for (lang, phrase), a in cands.items():
        w = phrase.split(" ")
        longer = [b for (l2, q), b in cands.items() if l2 == lang and len(q.split(" ")) > len(w) and f" {phrase} " in f" {q} " and b >= a]
        if longer:
            continue
        cuts = []
        for k in range(1, len(w)):
            l, r = f[(lang, " ".join(w[:k]))], f[(lang, " ".join(w[k:]))]
            cuts.append(((1000 * a * n[lang]) // (l * r), k, l, r))
        score, _, l, r = min(cuts)
        out.append((lang, phrase, a, l, r, n[lang], score))
    ranked = []
    for lang in sorted({o[0] for o in out}):
        mine = sorted((o for o in out if o[0] == lang), key=lambda o: (-o[6], -o[2], o[1].encode()))[:top]
        ranked += [(lang, i + 1, *o[1:]) for i, o in enumerate(mine)]
    return sorted(ranked)


def test_against_plain_count(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_CHARS", 200_000)  # many shards
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r.lang, r.text) for r in docs.collect()]
    got = sorted(tuple(r) for r in collocations(docs).collect())
    assert got == plain(rows)
    assert len(got) > 10


def test_awkward_rows_and_ties(spark, frame, monkeypatch):
    monkeypatch.setattr(phrases, "MIN_COUNT", 2)
    docs = awkward(frame)
    got = sorted(tuple(r) for r in collocations(docs.withColumn("lang", docs["source"].substr(0, 0)).drop("source")).collect())
    # lang: '' for rows with a source, null for the others: both are counted apart
    want = plain([("" if r.source is not None else None, r.text) for r in docs.collect()], least=2)
    assert got == want
    assert collocations(nothing(frame)).count() == 0


def test_what_is_written_stays_below_the_text(spark, frame):
    """Nearly every pair of these words occurs once, and no word often: their pairs need not be written."""
    rng = np.random.default_rng(5)
    texts = [" ".join(f"w{n}" for n in rng.integers(0, 30000, 4000)) for _ in range(60)]
    docs = frame([("en", t) for t in texts], "lang string, text string").coalesce(1)
    folder = Path(ensure_checkpoint_dir(spark).removeprefix("file:"))
    before = set(folder.glob("phrases_*/*.parquet"))
    assert collocations(docs).count() == 0
    written = sum(f.stat().st_size for f in set(folder.glob("phrases_*/*.parquet")) - before)
    assert 0 < written < sum(map(len, texts))


def test_words_with_one_hash_are_told_apart(spark, frame, monkeypatch):
    data = np.frombuffer(b"aabbaacc", dtype=np.uint8)
    monkeypatch.setattr(phrases, "word_hashes", lambda data, start, length: np.zeros(len(start), dtype=np.uint64))
    number, first, counts = phrases._numbered(data, np.array([0, 2, 4, 6]), np.full(4, 2), ["en"], np.zeros(4, dtype=np.int64))
    assert number[0] == number[2] == 0 and sorted(number) == [0, 0, 1, 2]
    assert counts.tolist() == [2, 1, 1] and first[0] == 0


def test_langs_bytes_and_long_phrases(spark, frame, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_CHARS", 300)
    rows = [(lang, f"Der Éa\x0bB c\td e f g. a b c {lang} d e f,x\r\nÉa b c d {n % 3}") for n in range(150) for lang in ("de", None, "")]
    got = sorted(tuple(r) for r in collocations(frame(rows, "lang string, text string")).collect())
    assert got == plain(rows) and {len(r[2].split(" ")) for r in got} >= {2, 5}
