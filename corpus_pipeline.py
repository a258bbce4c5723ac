"""From raw documents to token ids: quality rules, near-duplicates, secrets, source mix, encoding.

Each stage works on all that the one before kept, and its decisions take effect: rejected documents go, of each group of
SimHash near-duplicates (4-word shingles, 4 bits) one document stays, secrets are replaced, sources are cut and repeated to their targets, and what is left
is encoded. Between stages the documents are written as Parquet and read again, which ends the lineage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riftline.llm.bpe import encode
from riftline.llm.mixing import mixed_documents
from riftline.llm.quality import passing
from riftline.llm.queries import rank_file, table
from riftline.llm.secrets import fit_network, redact
from riftline.llm.shared import stored
from riftline.llm.simhash import one_of_each


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the rules and the isolation forest."""
    return passing(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component: operator 9 with its contract's shingle of SHINGLE (4) words and links at
    BITS (4) or fewer differing bits; the smallest doc_id of each component stays, no word-similarity check beside."""
    return one_of_each(docs)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced."""
    return redact(docs, fit_network(docs))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as the mix takes them: a row per document and pass, with the words taken."""
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of each mixed document."""
    return encode(docs, rank_file())


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality), ("near_duplicates", near_duplicates), ("secrets", secrets), ("mix", mix), ("tokens", tokens),
]

# Forests, networks, hashes and merges are not SQL: the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline_{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
