"""The pipeline stage by stage, each judged on its own input, and the registered queries."""

import hashlib

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline  # noqa: E402
from riftline.llm.shared import stored  # noqa: E402
from tests.llm.test_corpus import plain_components, plain_fingerprint  # noqa: E402
from tests.llm.test_rowwise import base_secrets, base_statistics, library  # noqa: E402

FOLDER = "/root/testdata/sf0.001"


def test_queries_are_registered():
    names = entry.queries()
    for n in range(1, 11):
        assert len([q for q in names if q.startswith(f"op{n}_")]) == 1
    assert "pipeline" in names
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "secrets", "mix", "tokens"]


def test_stages(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    inputs = {}
    for name, stage in corpus_pipeline.STAGES:
        inputs[name] = docs
        docs = stored(stage(spark, docs, FOLDER), f"test_{name}")
        if name != "tokens":
            assert docs.columns == inputs["quality"].columns
    held = {name: {r.doc_id: r for r in df.collect()} for name, df in inputs.items() if name != "tokens"}
    # rules: what the base rule fails is gone, and every clean labelled document that passes it stays
    failed = {d for d, r in held["quality"].items() if base_statistics(r.text)[5]}
    assert not failed & set(held["near_duplicates"])
    good = {r.doc_id for r in spark.read.parquet(f"{FOLDER}/labels.parquet").filter("quality = 1").collect()}
    assert len((good - failed) - set(held["near_duplicates"])) <= 1
    # near-duplicates: the smallest doc_id of each component
    ids = sorted(held["near_duplicates"])
    roots = plain_components([plain_fingerprint(held["near_duplicates"][d].text) for d in ids])
    least = {}
    for d, root in zip(ids, roots, strict=True):
        least.setdefault(root, d)
    assert set(held["secrets"]) == set(least.values())
    # secrets: none left, clean texts unchanged
    for d, r in held["mix"].items():
        before = held["secrets"][d].text
        assert sum(base_secrets(r.text)[:3]) == 0
        assert r.text == before or "[SECRET]" in r.text
    # encoding: as the library
    lib = library()
    want = sorted((r.doc_id, hashlib.sha256(np.array(lib.encode_ordinary(r.text), dtype="<u4").tobytes()).hexdigest()) for r in inputs["tokens"].collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in docs.collect()) == want


def test_run(spark):
    done = corpus_pipeline.run(spark, FOLDER)
    assert done.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"]
    assert done.count() > 0
