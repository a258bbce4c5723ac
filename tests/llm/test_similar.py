"""Groups by similarity against brute-force Jaccard over all pairs."""

import random

import pytest

pytest.importorskip("public_tokenizers")

from riftline.llm import similar  # noqa: E402
from tests.llm.helpers import awkward, awkward_rows, nothing, prose, words  # noqa: E402


def shingles(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = words(low)
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def plain_kept(rows):
    """The smallest doc_id of each group, null last."""
    groups = []
    for doc_id, text in rows:
        mine = shingles(text)
        near = [g for g in groups if any(mine == s or len(mine & s) * 5 >= len(mine | s) * 4 for _, s in g)]
        groups = [g for g in groups if g not in near] + [[(doc_id, mine), *[x for g in near for x in g]]]
    return sorted(min((d is None, d or 0) for d, _ in g) for g in groups)


def kept(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


def edited():
    draw = random.Random(5)
    rows = []
    for group in range(40):
        base = prose(1000 + group, draw.randint(60, 400)).split()
        for _ in range(4 if group else 60):  # the first group is large
            copy = list(base)
            for at in draw.sample(range(len(copy)), max(1, len(copy) * draw.choice((1, 2, 3)) // 100)):
                copy[at] = f"w{draw.random()}"
            rows.append((len(rows), " ".join(copy)))
    return rows


def test_one_of_each_takes_all_similar_documents(spark, frame):
    # the pipeline's stage follows the SimHash contract (tests/llm/test_pipeline.py); this operator keeps its own
    rows = edited()
    done = similar.one_of_each(frame(rows, "doc_id long, text string"))
    want = plain_kept(rows)
    assert len(want) < len(rows)
    assert kept(done) == want


def test_awkward_rows(frame):
    done = similar.one_of_each(awkward(frame))
    assert done.columns == awkward(frame).columns
    assert kept(done) == plain_kept([(d, t) for d, t, _ in awkward_rows()])
    assert similar.one_of_each(nothing(frame)).count() == 0


def test_sketches_bound_the_difference():
    import numpy as np
    import pyarrow as pa

    from riftline.llm.blocks import Block

    value, first = similar.shingle_sets(Block(pa.array([text for _, text in edited()[:80]])))
    bits = similar.sketches(value, first).view(np.uint64)
    held = [set(value[a:b].tolist()) for a, b in zip(first[:-1], first[1:], strict=True)]
    for i in range(80):
        for j in range(i):
            assert np.bitwise_count(bits[i] ^ bits[j]).sum() <= len(held[i] ^ held[j])
