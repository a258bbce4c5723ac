"""Personal data: base spans against a plain scan, the tagger against held-out windows, awkward rows."""

import hashlib

import numpy as np

from riftline.llm.pii import KINDS, Tagger, base_spans, fit_tagger, found, scan_pii, spans_of, tags_of
from tests.llm.helpers import awkward, nothing

SAMPLES = [
    "write to a.b@x.org or x@y, ip 10.0.0.1 and 999.1.1.1, card 4111 1111 1111 1111 or 4111 1111 1111 1112",
    "call +1 (555) 123-4567 or +12 34, id 1234567890123456789012, 0.0.0.0.0 and 255.255.255.255",
    "", "no digits here at all", "mail@host.com." * 3, "4111-1111-1111-1111+44 20 7946 0958",
]


def plain(text):
    """The rules by a hand-written scan: leftmost match per kind, skip past it, check afterwards."""
    out = []
    digits = set("0123456789")
    for kind in range(4):
        i = 0
        while i < len(text):
            end = None
            if kind == 0:
                local = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-"
                label = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-"
                j = i
                while j < len(text) and text[j] in local:
                    j += 1
                # backtracking: the local part may end before any '@' it contains
                for at in range(j, i, -1):
                    if at < len(text) and text[at] == "@":
                        k, last = at + 1, None
                        while k < len(text) and text[k] in label:
                            k += 1
                        if k == at + 1:
                            continue
                        while k < len(text) and text[k] == "." and k + 1 < len(text) and text[k + 1] in label:
                            k += 1
                            while k < len(text) and text[k] in label:
                                k += 1
                            last = k
                        if last:
                            end = last
                            break
            elif kind == 1 and text[i] in digits:
                j, parts = i, 0
                while True:
                    k = j
                    while k < len(text) and text[k] in digits:
                        k += 1
                    if k == j:
                        break
                    parts += 1
                    j = k
                    if parts == 4 or j + 1 >= len(text) or text[j] != "." or text[j + 1] not in digits:
                        break
                    j += 1
                if parts == 4:
                    end = j
            elif kind == 2 and text[i] in digits:
                j = i + 1
                while j < len(text):
                    if text[j] in digits:
                        j += 1
                    elif text[j] in " -" and j + 1 < len(text) and text[j + 1] in digits:
                        j += 2
                    else:
                        break
                if j > i + 1:
                    end = j
            elif kind == 3 and text[i] == "+" and i + 1 < len(text) and text[i + 1] in digits:
                j = i + 2
                while j < len(text) and text[j] in " ().-0123456789":
                    j += 1
                while j > i + 2 and text[j - 1] not in digits:
                    j -= 1
                if j > i + 2:
                    end = j
            if end is None:
                i += 1
                continue
            found_text = text[i:end]
            ok = True
            if kind == 1:
                ok = all(int(p) <= 255 for p in found_text.split("."))
            elif kind == 2:
                d = [int(c) for c in found_text if c in digits]
                total = sum(x if n % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for n, x in enumerate(reversed(d)))
                ok = 14 <= len(d) <= 19 and total % 10 == 0
            elif kind == 3:
                ok = 10 <= sum(c in digits for c in found_text) <= 15
            if ok:
                out.append((i, kind, end))
            i = end
    return sorted(out)


def test_base_rules_against_a_plain_scan():
    for text in SAMPLES:
        assert base_spans(text) == plain(text), text
    assert [k for _, k, _ in base_spans(SAMPLES[0])] == [0, 1, 2]


def test_tags_round_trip():
    spans = base_spans(SAMPLES[0] + " " + SAMPLES[1])
    assert spans_of(tags_of(300, spans)) == spans


def test_tagger_learns_held_out_windows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    tagger = fit_tagger(docs.filter("doc_id % 2 = 0"))
    held = docs.filter("doc_id % 2 = 1 and doc_id % 25 = 1").collect()
    right = wanted = 0
    for r in held:
        text = r.text or ""
        truth = tags_of(len(text), base_spans(text))
        guess = tagger.tag(text)
        wanted += int((truth > 0).sum())
        right += int(((truth > 0) & (guess == truth)).sum())
    assert wanted > 100
    assert right / wanted >= 0.9, right / wanted


def test_awkward_rows(spark, frame):
    docs = awkward(frame)
    tagger = Tagger.fresh(3)
    got = {(r.doc_id, r.spans) for r in scan_pii(docs, tagger).collect()}
    assert len(scan_pii(docs, tagger).collect()) == docs.count()
    for r in docs.collect():
        base, spans = found(r.text or "", tagger)
        assert (r.doc_id, ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)) in got
        assert set(base) <= set(spans)
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.base_sha256 for r in scan_pii(docs, tagger).filter("n_email + n_ip + n_card + n_phone = 0").collect()} == {empty}
    assert scan_pii(nothing(frame), tagger).count() == 0


def test_model_spans_never_overlap_base_ones():
    tagger = Tagger.fresh(4)
    tagger.params["o"][:] = np.array([-5.0, 5, 5, 0, 0, 0, 0, 0, 0])  # a tagger that calls everything an email
    text = "x 10.0.0.1 y " * 20
    base, spans = found(text, tagger)
    extra = set(spans) - set(base)
    assert extra
    for s, _, e in extra:
        assert all(e <= bs or s >= be for bs, _, be in base)
