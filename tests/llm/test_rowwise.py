"""Operators that judge each row by itself, against plain re-statements and reference libraries."""

import collections
import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
import tiktoken

public_tokenizers = pytest.importorskip("public_tokenizers")

from riftline.llm import bpe, html, licenses, quality, secrets  # noqa: E402
from riftline.llm.blocks import Block, Words, blocks  # noqa: E402
from tests.llm.helpers import awkward, awkward_rows, nothing, words  # noqa: E402

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def rows_of(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=repr)


def expect(function):
    return sorted([(doc_id, *function(text or "")) for doc_id, text, _ in awkward_rows()], key=repr)


def test_words_of_a_block():
    texts = [text for _, text, _ in awkward_rows()]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    for budget in (1, 100, 1 << 20):
        got = []
        for _, block in blocks(batch, "text", budget):
            held = Words(block)
            spans = list(zip(held.start.tolist(), held.end.tolist(), strict=True))
            got += [[block.data[a:b].tobytes().decode() for a, b in spans[x:y]] for x, y in zip(held.first[:-1], held.first[1:], strict=True)]
        assert got == [words(text) for text in texts]


# ---------------------------------------------------------------- encoding

def library():
    held = bpe.vocabulary(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=held.ranks, special_tokens={})


def test_encode_as_the_library_and_back(spark, frame):
    lib = library()

    def wanted(text):
        ids = lib.encode_ordinary(text)
        return (
            len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest(), ids,
        )

    done = bpe.encode(awkward(frame), RANKS)
    assert rows_of(done, "doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids") == expect(wanted)
    back = bpe.decode(done, RANKS)
    assert rows_of(back.selectExpr("doc_id", "cast(bytes as string) t"), "doc_id", "t") == expect(lambda t: (t,))
    assert bpe.encode(nothing(frame), RANKS).count() == 0


def test_pieces_of_odd_texts():
    lib, held = library(), bpe.vocabulary(RANKS)
    draw = np.random.default_rng(5)
    chars = list("aab e  \n\t 　'''stremvldSé1２!?\x1c\x85日ñ🤖́.")
    texts = ["".join(draw.choice(chars, draw.integers(0, 15))) for _ in range(3000)]
    texts += ["a" * 3000, "<|endoftext|>", "abab" * 500 + "   zz", "don't 'twas we'll I'd"]
    got = [ids.tolist() for part in bpe.encode_corpus([Block(pa.array(texts[i:i + 700])) for i in range(0, len(texts), 700)], held) for ids in part]
    assert got == [lib.encode_ordinary(text) for text in texts]


# ---------------------------------------------------------------- quality rules

def base_statistics(text):
    w = words(text)
    lines = [line for line in text.split("\n") if words(line)]
    grams = collections.Counter(tuple(w[i:i + 5]) for i in range(len(w) - 4))
    repeated = {i + k for i in range(len(w) - 4) if grams[tuple(w[i:i + 5])] > 1 for k in range(5)}
    failed = len(w) < 10 or 100 * len(repeated) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeated), failed


def test_quality_statistics(spark, frame):
    labels = frame([(8, 1, 0), (None, 1, 0), (3, 0, 0)], "doc_id long, quality int, toxic int")
    done = quality.quality_rules(awkward(frame), labels)
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(done, *columns) == expect(base_statistics)
    assert done.filter("base_failed and kept").count() == 0
    assert quality.quality_rules(nothing(frame), labels).count() == 0
    assert quality.quality_rules(awkward(frame), None).count() == len(awkward_rows())


def test_quality_keeps_clean_and_drops_junk(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    judged = quality.quality_rules(docs, labels, rows=150).join(labels, "doc_id").select("quality", "base_failed", "kept").toPandas()
    rest = judged[~judged.base_failed]  # most of these rows took no part in the fit
    assert rest[rest.quality == 1].kept.mean() > 0.97
    assert rest[rest.quality == 0].kept.mean() < 0.2
    kept = quality.passing(docs, labels, rows=150)
    assert kept.schema == docs.schema
    assert kept.count() == quality.quality_rules(docs, labels, rows=150).filter("kept").count()


# ---------------------------------------------------------------- secrets

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def base_secrets(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    kinds = [k for _, k, _ in found]
    said = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
    return kinds.count(0), kinds.count(1), kinds.count(2), hashlib.sha256(said.encode()).hexdigest()


def test_base_secrets(spark, frame):
    docs = awkward(frame)
    net = secrets.fit_network(docs, made=400, epochs=2)
    done = secrets.scan(docs, net)
    assert rows_of(done, "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == expect(base_secrets)
    clean = secrets.redact(docs, net)
    assert clean.schema == docs.schema
    assert clean.filter("text like '%abcdef0123456789%' or text like '%AKIA1234%'").count() == 0
    assert rows_of(clean.filter("doc_id = 8"), "text") == rows_of(docs.filter("doc_id = 8"), "text")
    assert secrets.scan(nothing(frame), net).count() == 0


def test_base_secrets_of_odd_texts():
    draw = np.random.default_rng(1)
    parts = ["AKIA", "token", "=", ":", " ", '"', "ABCDEFGH12", "0123456789abc", "Password", "é", "api_key", "x", "SECRET", "\n"]
    texts = ["".join(draw.choice(parts, draw.integers(0, 11))) for _ in range(2000)] + ["AKIA5BAMYKPXXEBPP3", "BG12", "token=secret: abcdefghijklmnop"]
    block = Block(pa.array(texts))
    chars = np.concatenate([[0], np.cumsum((block.data & 0xC0) != 0x80)])
    got = collections.defaultdict(list)
    for row, kind, a, b in secrets.find(block):
        if kind < secrets.RUN:
            zero = chars[block.at[row]]
            got[row].append(f"{secrets.KINDS[kind]}:{chars[a] - zero}:{chars[b] - zero}")
    for row, text in enumerate(texts):
        assert hashlib.sha256(",".join(got[row]).encode()).hexdigest() == base_secrets(text)[3], text


def test_network_on_held_out_rows():
    windows, label = secrets.generated(3000, seed=1)
    codes, target = secrets.CharNet.codes(windows), np.array(label, dtype=float)
    net = secrets.CharNet.new(1)
    net.train(codes[:2000], target[:2000], epochs=4, seed=1)
    net.calibrate(codes[2000:2500], target[2000:2500], recall=0.95)
    hit = net.probability(codes[2500:]) >= net.threshold
    assert hit[target[2500:] > 0].mean() > 0.9
    assert hit[target[2500:] == 0].mean() < 0.1


# ---------------------------------------------------------------- licences

def base_licenses(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
    places, labels = [], set()
    for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
        parts = phrase.split()
        at = [i for i in range(len(w) - len(parts) + 1) if w[i:i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def test_base_licenses(spark, frame):
    done = licenses.license_scan(awkward(frame))
    assert rows_of(done, "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels") == expect(base_licenses)
    assert licenses.license_scan(nothing(frame)).count() == 0


def test_licenses_beyond_the_base(spark, frame):
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    texts = [f"{'word ' * 500} {bsd} {'more ' * 300}", "Licensed under CC BY-NC 4.0.", "provided that conditions are met in binary", "clause " * 20000]
    done = licenses.license_scan(frame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [r.labels for r in done] == ["bsd", "cc-by-nc", "", ""]
    assert done[0].score > 0.9 and done[3].score < 0.5


# ---------------------------------------------------------------- pages

def test_main_text(spark, frame):
    page = (
        "<html><head><title>t</title><script>var a='<p>no</p>'</script></head><body><header><a href=/>Home</a></header>"
        "<nav><ul><li><a href=#>One</a><li><a href=#>Two</a></ul></nav><div class='cookie-notice'>We use cookies. <button>OK</button></div>"
        "<article><h1>Title &amp; more</h1><p>First  <b>bold</b>\n words of the text, long enough to read.<p>Second &lt;i&gt; paragraph, again of some length."
        "<div class=ad>Buy now!</div><p>Third.</p></article><section class=comments><p>Nice post, thanks for it.</p></section>"
        "<aside class=sidebar><a href=#>Related</a></aside><form><label>Mail</label><input></form><footer>&copy; us</footer></body></html>"
    )
    want = "Title & more First bold words of the text, long enough to read. Second <i> paragraph, again of some length. Third."
    pages = frame(
        [(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (3, "u", "", "x"), (4, "u", "only plain words, no markup", "x"),
         (5, "u", "<p>unclosed <b>" + "long text. " * 20000, "x"), (None, "u", "<script>x", "x")],
        "page_id long, url string, html string, text string",
    )
    got = {r.page_id: r for r in html.extract(pages).collect()}
    assert got[1].text == want and got[1].n_chars == len(want)
    assert got[2].text == "" and got[3].text == "" and got[None].text == ""
    assert got[4].text == "only plain words, no markup"
    assert got[5].n_chars > 200_000
    assert html.extract(pages.limit(0)).count() == 0


def test_pages_from_the_rule_held_out():
    draw, model, exact = np.random.default_rng(12345), html.fit_blocks(), 0
    for _ in range(150):
        page, label = html.generated_page(draw)
        blocks_of, _ = html.parse(page)
        exact += html.main_text(page, model) == " ".join(t for t, keep in zip(blocks_of.text, label, strict=True) if keep)
    assert exact > 130


def test_minimum_cut_by_brute_force():
    draw = np.random.default_rng(4)
    for _ in range(200):
        n = int(draw.integers(1, 8))
        source, sink = draw.integers(0, 9, n).tolist(), draw.integers(0, 9, n).tolist()
        edges = [(a, b, int(draw.integers(0, 6))) for a in range(n) for b in range(a) if draw.random() < 0.5]

        def cost(keep):
            return sum(t if k else s for s, t, k in zip(source, sink, keep, strict=True)) + sum(c for a, b, c in edges if keep[a] != keep[b])

        best = min(cost([bool(mask >> i & 1) for i in range(n)]) for mask in range(1 << n))
        assert cost(html.minimum_cut(source, sink, edges)) == best
