"""Hard negatives against a brute force in Python integers, on awkward rows and in small blocks."""

import math

import duckdb
import numpy as np
import pytest

from riftline.llm import negatives
from riftline.llm.negatives import hard_negatives, moduli_for, rns_scores
from riftline.llm.queries import OP13_SQL

SCHEMA = "vec_id long, embedding array<float>, label int, rid string, lab string, iv string, score double, place int"


def brute(rows):
    valid = []
    for vec_id, vector, label, *_ in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        lab = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        if lab < 0 and label + 1 < 0 and vec_id is not None and vec_id % 7 == 0:
            lab = -((-(label + 1)) % 10)  # remainder keeps the sign, as in SQL
        valid.append((vec_id, lab, [math.floor(256 * float(np.float32(x))) for x in vector]))

    def dot(a, b):
        return sum(x * y for x, y in zip(a, b))  # missing components count as 0

    def key(item):
        return (-item[0], item[1] is None, item[1] or 0)

    out = []
    for anchor_id, alab, av in valid:
        if anchor_id is None or anchor_id % 50:
            continue
        scored = [(dot(av, v), vid, lab) for vid, lab, v in valid]
        positives = sorted([s for s in scored if s[2] == alab and s[1] != anchor_id], key=key)[:5]
        for ps, pid, _ in positives:
            fits = sorted([s for s in scored if s[2] != alab and 50 * ps <= 100 * s[0] <= 95 * ps], key=key)[:3]
            out += [(anchor_id, pid, rank, nid, ps, ns) for rank, (ns, nid, _) in enumerate(fits, 1)]
    return sorted(out, key=repr)


def awkward():
    draw = np.random.default_rng(5)
    rows = []
    for i in range(-20, 260):
        vector = [float(x) for x in draw.normal(0, 0.3, 6).astype(np.float32)]
        rows.append((i, vector, int(draw.integers(0, 3)), "x", "x", "x", 1.0, 1))
    rows += [
        (None, [0.5] * 6, 1, "x", "x", "x", 1.0, 1), (None, [0.5] * 6, 1, "x", "x", "x", 1.0, 1),
        (300, None, 1, "x", "x", "x", 1.0, 1), (301, [0.1, None, 0.2], 1, "x", "x", "x", 1.0, 1),
        (302, [float("nan")] * 3, 1, "x", "x", "x", 1.0, 1), (303, [float("inf"), 0.0], 1, "x", "x", "x", 1.0, 1),
        (304, [0.2] * 6, None, "x", "x", "x", 1.0, 1), (350, [], 2, "x", "x", "x", 1.0, 1),
        (400, [0.3, 0.3], 1, "x", "x", "x", 1.0, 1), (401, [0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3, 0.3], 1, "x", "x", "x", 1.0, 1),
        (100, [0.25] * 6, 2, "x", "x", "x", 1.0, 1), (100, [0.25] * 6, 2, "x", "x", "x", 1.0, 1),  # a repeated anchor
        (402, [0.25] * 6, 2, "x", "x", "x", 1.0, 1), (403, [0.25] * 6, 0, "x", "x", "x", 1.0, 1),  # ties
    ]
    return rows


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("blocks", [(1024, 4096), (3, 7)])
def test_brute_force(spark, frame, monkeypatch, blocks):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", blocks[0])
    monkeypatch.setattr(negatives, "ROW_BLOCK", blocks[1])
    rows = awkward()
    got = collected(hard_negatives(frame(rows, SCHEMA)))
    assert got == brute(rows)
    assert len(got) > 50


def test_sql_agrees_on_awkward_rows(spark, frame):
    rows = awkward()
    embeddings = frame(rows, SCHEMA).toPandas()  # noqa: F841 - read by DuckDB by name
    want = sorted((tuple(None if v is None else int(v) for v in r) for r in duckdb.sql(OP13_SQL).fetchall()), key=repr)
    assert want == brute(rows)


def test_empty_and_anchorless(spark, frame):
    assert hard_negatives(frame([], SCHEMA)).count() == 0
    assert hard_negatives(frame([(1, [0.1], 1, "x", "x", "x", 1.0, 1)], SCHEMA)).count() == 0
    assert hard_negatives(frame([(50, [0.1], None, "x", "x", "x", 1.0, 1)], SCHEMA)).columns == [
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    ]


def test_residue_product_is_exact():
    draw = np.random.default_rng(1)
    for bound in (10, 1000, 2**20):
        a = draw.integers(-bound, bound + 1, (7, 300))
        b = draw.integers(-bound, bound + 1, (9, 300))
        limit = int(np.abs(a).sum(axis=1).max()) * bound
        if limit >= 2**54:
            continue
        exact = [[sum(int(x) * int(y) for x, y in zip(r, c)) for c in b] for r in a]
        assert rns_scores(a, b, moduli_for(limit)).tolist() == exact


def test_bound_too_large(spark, frame):
    with pytest.raises(ValueError):
        hard_negatives(frame([(50, [1e9] * 64, 1, "x", "x", "x", 1.0, 1), (51, [1e9] * 64, 1, "x", "x", "x", 1.0, 1)], SCHEMA)).count()


def random_rows(spread, ids, width=6, labels=(0, 1, 2, 3)):
    draw = np.random.default_rng(8)
    return [(i, [float(x) for x in draw.normal(0, spread, width).astype(np.float32)], int(draw.choice(labels))) for i in ids]


@pytest.mark.parametrize("rows", [
    random_rows(0.3, range(-60, 240)),
    random_rows(1e5, range(0, 200), 8),  # scores past 2 ** 54
    random_rows(0.3, [2**60 // 50 * 50 + i for i in range(200)] + [None] * 4),  # ids that no double holds, beside nulls
    random_rows(0.3, range(0, 200), labels=(-3, 0, 9)),
], ids=["many tasks", "large scores", "large ids", "negative labels"])
def test_blocks_meet_in_many_tasks(spark, frame, monkeypatch, rows):
    monkeypatch.setattr(negatives, "ANCHOR_BLOCK", 2)
    monkeypatch.setattr(negatives, "ROW_BLOCK", 17)
    setting = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "false")  # as on larger tables, where the tasks are not joined into one
    try:
        got = collected(hard_negatives(frame(rows, "vec_id long, embedding array<float>, label int")))
    finally:
        spark.conf.set(setting, before)
    assert got == brute(rows)
    assert len(got) > 20


def test_largest_label(frame):
    rows = [(0, [1.0], 2**31 - 1), (50, [1.0], 8), (51, [1.0], 8), (52, [0.75], 1)]
    assert collected(hard_negatives(frame(rows, "vec_id long, embedding array<float>, label int"))) == brute(rows)
