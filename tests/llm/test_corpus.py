"""Operators over the whole corpus, against brute force."""

import collections
import hashlib
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")

from riftline.llm import fingerprint, mixing, native, repeats, simhash, substrings, suffixes  # noqa: E402
from tests.llm.helpers import awkward, awkward_rows, nothing, words  # noqa: E402
from tests.llm.test_rowwise import LOWER, rows_of  # noqa: E402


# ---------------------------------------------------------------- repeated windows

def twice(sequences, width):
    counts = collections.Counter(s[i:i + width] for s in sequences for i in range(len(s) - width + 1))
    return [np.array([counts[s[i:i + width]] > 1 for i in range(len(s) - width + 1)], dtype=bool) for s in sequences]


def gone_of(sequences, width):
    out = []
    for sequence, starts in zip(sequences, twice(sequences, width), strict=True):
        gone = np.zeros(len(sequence), dtype=bool)
        for i in np.flatnonzero(starts):
            gone[i:i + width] = True
        out.append(gone)
    return out


@pytest.mark.parametrize(("window", "gram", "hot"), [(35, 8, 20_000), (7, 3, 1), (2, 1, 20_000)])
def test_substring_dedup(spark, frame, window, gram, hot):
    rows = awkward_rows()
    sequences = [tuple(words(text)) for _, text, _ in rows]
    want = []
    for (doc_id, _, _), sequence, gone in zip(rows, sequences, gone_of(sequences, window), strict=True):
        kept = " ".join(w for w, g in zip(sequence, gone, strict=True) if not g)
        want.append((doc_id, len(sequence), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest(), kept))
    got = substrings.dedup_substrings(awkward(frame), window=window, gram=gram, hot=hot)
    assert rows_of(got, "doc_id", "n_words", "n_removed", "kept_sha256", "kept") == sorted(want, key=repr)
    assert substrings.dedup_substrings(nothing(frame)).count() == 0


@pytest.mark.parametrize(("least", "gram", "hot"), [(200, 40, 1000), (20, 6, 1), (12, 5, 1000)])
def test_suffix_dedup(spark, frame, least, gram, hot):
    rows = awkward_rows()
    sequences = [(text or "").encode() for _, text, _ in rows]
    want = []
    for (doc_id, _, _), sequence, gone in zip(rows, sequences, gone_of(sequences, least), strict=True):
        kept = bytes(b for b, g in zip(sequence, gone, strict=True) if not g)
        runs = int((np.diff(np.concatenate([[False], gone]).astype(int)) == 1).sum())
        want.append((doc_id, len(sequence), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    got = suffixes.dedup_bytes(awkward(frame), least=least, gram=gram, hot=hot)
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == sorted(want, key=repr)
    assert suffixes.dedup_bytes(nothing(frame)).count() == 0


def test_interval_expansion_by_brute_force():
    draw = np.random.default_rng(3)
    for turn in range(300):
        width, chars = int(draw.choice([3, 5, 9, 20])), "ab" if turn % 2 else "abcdefgé"
        base = "".join(draw.choice(list(chars), 60))
        strings = [
            (base[a:a + int(draw.integers(0, 40))] + "".join(draw.choice(list(chars), int(draw.integers(0, 20))))).encode()
            for a in draw.integers(0, 50, int(draw.integers(0, 8)))
        ]
        for got, want in zip(suffixes.compare_bytes(strings, width), twice(strings, width), strict=True):
            assert np.array_equal(got, want)


def test_copies_travel_once(spark, frame):
    """Ten or a thousand copies of a text send the same strings to the buckets."""
    from tests.llm.helpers import prose

    unit, sizes = repeats.Unit("words", 35, 8), []
    for copies in (10, 300):
        rows = repeats.known_rows(frame([(i, prose(1, 300), "a") for i in range(copies)], "doc_id long, text string, source string"))
        listed = repeats.list_super_kmers(rows, unit)
        sizes.append(listed.groupBy("key", "content").count().count())
        assert listed.count() == copies * sizes[-1]
    assert sizes[0] == sizes[1]


def test_listing_bytes_holds_a_small_block():
    """What a worker holds while it lists the super-k-mers of a batch follows the block, not the batch."""

    class Rows:
        def mapInArrow(self, run, schema):
            return run

    draw = np.random.default_rng(7)
    texts = ["".join(map(chr, row)) for row in draw.integers(97, 123, (4000, 1000))]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["rid", "text"])
    tracemalloc.start()
    try:
        found = sum(part.num_rows for part in repeats.list_super_kmers(Rows(), repeats.Unit("bytes", 200, 40))(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert found > len(texts)
    assert peak < 100 << 20


# ---------------------------------------------------------------- SimHash

def plain_fingerprint(text):
    w = words((text or "").translate(LOWER))
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] if len(w) >= 4 else [" ".join(w)] if w else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(marks, bits=4):
    root = list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(marks):
        for j, b in enumerate(marks[:i]):
            if (a ^ b).bit_count() <= bits:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(marks))]


def test_fingerprints_and_components(spark, frame):
    rows = awkward_rows()
    marks = [plain_fingerprint(text) for _, text, _ in rows]
    groups = collections.defaultdict(list)
    for place, root in enumerate(plain_components(marks)):
        groups[root].append(place)
    least = {}
    for places in groups.values():
        ids = [rows[p][0] for p in places if rows[p][0] is not None]
        least.update(dict.fromkeys(places, min(ids, default=None)))
    want = sorted([(rows[p][0], f"{marks[p]:016x}", least[p]) for p in range(len(rows))], key=repr)
    got = simhash.near_duplicates(awkward(frame)).withColumn("f", F.lower(F.lpad(F.hex("fp"), 16, "0")))
    assert rows_of(got, "doc_id", "f", "component_id") == want
    assert simhash.near_duplicates(nothing(frame)).count() == 0
    one = simhash.one_of_each(awkward(frame))
    assert one.columns == awkward(frame).columns
    assert one.count() == len(groups)


def test_links_of_chains_and_dense_groups(spark, frame):
    draw = np.random.default_rng(9)
    marks = [int(x) for x in draw.integers(0, 1 << 63, 60)]
    for _ in range(120):  # a dense group: within two bits of one fingerprint
        marks.append(marks[0] ^ (1 << int(draw.integers(64))) ^ (1 << int(draw.integers(64))))
    for _ in range(30):  # a chain: four bits further each time
        x = marks[-1]
        for b in draw.choice(64, 4, replace=False):
            x ^= 1 << int(b)
        marks.append(x)
    marks = sorted(set(marks))
    signed = [m - (1 << 64) if m >> 63 else m for m in marks]
    points = frame([(m,) for m in signed], "fp long")
    edges = simhash.links(points)
    assert edges.count() < 70 * len(marks)
    assert all(((u ^ v) & (1 << 64) - 1).bit_count() <= 4 for u, v in rows_of(edges, "u", "v"))
    roots = dict(rows_of(simhash.components(edges), "node", "root"))
    mine = [roots.get(m, m) for m in signed]
    plain = plain_components(marks)
    assert len({*zip(mine, plain, strict=True)}) == len(set(mine)) == len(set(plain))


# ---------------------------------------------------------------- fingerprints

def test_fingerprints_and_edits(spark, frame):
    rows = awkward_rows()
    done = fingerprint.edited_fingerprints(awkward(frame)).collect()
    assert len(done) == len(rows)
    by_text = collections.defaultdict(set)
    for doc_id, text, _ in rows:
        for r in done:
            if r.doc_id == doc_id and r.n_chars == len(text or ""):
                by_text[text or ""].add(r.fingerprint)
    assert all(len(marks) == 1 for marks in by_text.values())
    assert fingerprint.edited_fingerprints(nothing(frame)).count() == 0
    single = fingerprint.edited_fingerprints(frame([(5, "a b c d e f g h i")], "doc_id long, text string")).first()
    assert single.near_next == 1.0


def test_next_text_over_many_ranges(spark, frame):
    rows = [(int(i), f"text {i} " * 3) for i in np.random.default_rng(2).permutation(700) * 3]
    for ranges in (1, 7, 300):
        got = fingerprint.with_next(frame(rows, "doc_id long, text string"), ["text"], rows_per_range=max(1, 700 // ranges))
        held = dict(rows)
        ids = sorted(held, reverse=True)
        want = {a: held[b] for a, b in zip(ids, ids[1:] + ids[:1], strict=True)}
        assert {r.doc_id: r.next_text for r in got.collect()} == want


def test_likeness_is_unbiased(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    ids = sorted(texts, reverse=True)
    miss = []

    def shingles(text):
        w = words(text)
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}

    done = {r.doc_id: r for r in fingerprint.edited_fingerprints(docs).collect()}
    for a, b in zip(ids, ids[1:] + ids[:1], strict=True):
        text, third = texts[a], len(texts[a]) // 3
        edited = text[:len(text) - third] + texts[b][:third]
        assert done[a].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        one, two = shingles(text), shingles(edited)
        miss.append(done[a].near_edited - len(one & two) / len(one | two))
        assert done[a].near_next < 0.2 or texts[a] == texts[b]
    assert abs(np.mean(miss)) < 0.01 and np.std(miss) < 0.05


# ---------------------------------------------------------------- mixing

def plain_targets(sizes):
    """Weights 1, 2, 3 by name, null last; what is over three times a source goes to the others by weight."""
    names = sorted([s for s in sizes if s is not None]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    target, total, capped = {}, sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        free = [s for s in names if s not in capped]
        share = sum(weight[s] for s in free)
        target = {s: 3.0 * sizes[s] if s in capped else left * weight[s] / share for s in names}
        over = {s for s in free if target[s] > 3 * sizes[s]}
        if not over:
            return target
        capped |= over


def test_mix(spark, frame):
    rows = awkward_rows()
    done = mixing.mix_report(awkward(frame)).collect()
    sizes = collections.Counter()
    for _, text, source in rows:
        sizes[source] += len(words(text))
    target = plain_targets(sizes)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size) for r in done) == sorted((d is None, d or 0, len(words(t))) for d, t, _ in rows)
    taken = collections.Counter()
    for r in done:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    for source in sizes:
        assert abs(taken[source] - target[source]) <= 2 * mixing.BLOCK_WORDS
    assert rows_of(mixing.mix_report(awkward(frame).repartition(5)), "doc_id", "size", "target", "taken") == sorted(
        [(r.doc_id, r.size, r.target, r.taken) for r in done], key=repr
    )
    assert mixing.mix_report(nothing(frame)).count() == 0


def test_skewed_targets_and_mixed_texts(spark, frame):
    rows = [(i, " ".join(f"w{i}_{k}" for k in range(n)), s, "en", 0) for i, (s, n) in enumerate(
        [("a", 4000), ("a", 5000), ("b", 700), ("c", 30), (None, 900), ("d", 0)]
    )]
    docs = frame(rows, "doc_id long, text string, source string, lang string, n_chars long")
    report = {r.doc_id: r for r in mixing.mix_report(docs).collect()}
    sizes = {"a": 9000, "b": 700, "c": 30, "d": 0, None: 900}
    for r in report.values():
        assert r.target == pytest.approx(plain_targets(sizes)[r.source])
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    words_of = collections.Counter()
    for r in mixed.collect():
        w = words(r.text)
        assert len(r.text) == r.n_chars and set(w) <= set(rows[r.doc_id][1].split()) and len(set(w)) == len(w)
        words_of[r.doc_id] += len(w)
    assert words_of == {d: r.taken for d, r in report.items() if r.taken}
    assert mixing.mixed_documents(nothing(frame)).count() == 0


def test_permutations(spark):
    for n in (1, 2, 3, 5, 17, 256, 1000):
        got = spark.range(n).select(native.permuted(F.col("id"), F.lit(n), F.lit(3)).alias("p")).collect()
        assert sorted(r.p for r in got) == list(range(n))
