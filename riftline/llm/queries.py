"""Queries of the corpus operators over the given tables, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riftline.llm.bpe import encode
from riftline.llm.fingerprint import edited_fingerprints
from riftline.llm.html import extract
from riftline.llm.licenses import license_scan
from riftline.llm.mixing import mix_report
from riftline.llm.negatives import hard_negatives
from riftline.llm.phrases import collocations
from riftline.llm.pii import fit_tagger, scan_pii
from riftline.llm.quality import quality_rules
from riftline.llm.secrets import fit_network, scan
from riftline.llm.simhash import near_duplicates
from riftline.llm.substrings import dedup_substrings
from riftline.llm.suffixes import dedup_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rank_file() -> str:
    """The ranks of the public 50k byte-level vocabulary."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_substrings(table(spark, sf_dir, "documents"), keep_text=False)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_bytes(table(spark, sf_dir, "documents"), keep_text=False)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), rank_file(), keep_ids=False)


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan(docs, fit_network(docs))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept"
    )


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(table(spark, sf_dir, "documents"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


def op12_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scan_pii(docs, fit_tagger(docs))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_fingerprints": op1_fingerprints,
    "op2_html_extract": op2_html_extract,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_secret_scan": op6_secret_scan,
    "op7_quality_rules": op7_quality_rules,
    "op8_source_mix": op8_source_mix,
    "op9_simhash": op9_simhash,
    "op10_license_scan": op10_license_scan,
    "op11_collocations": op11_collocations,
    "op12_pii": op12_pii,
    "op13_hard_negatives": op13_hard_negatives,
}

OP13_SQL = """
WITH v AS (
    SELECT vec_id,
           CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS lab,
           list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS iv
    FROM embeddings
    WHERE label IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), a AS (
    SELECT row_number() OVER () AS arow, vec_id, lab, iv FROM v WHERE vec_id % 50 = 0
), s AS (
    SELECT a.arow, a.vec_id AS anchor_id, a.lab AS alab, v.vec_id AS cand_id, v.lab AS clab,
           coalesce(list_sum(list_transform(range(1, greatest(len(a.iv), len(v.iv)) + 1),
                                            lambda i: coalesce(a.iv[i], 0) * coalesce(v.iv[i], 0))), 0) AS score
    FROM a CROSS JOIN v
), p AS (
    SELECT *, row_number() OVER (PARTITION BY arow ORDER BY score DESC, cand_id ASC NULLS LAST) AS place
    FROM s WHERE clab = alab AND cand_id IS DISTINCT FROM anchor_id
    QUALIFY place <= 5
)
SELECT p.anchor_id, p.cand_id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.arow, p.place ORDER BY n.score DESC, n.cand_id ASC NULLS LAST) AS INTEGER) AS rank,
       n.cand_id AS negative_id, CAST(p.score AS BIGINT) AS positive_score, CAST(n.score AS BIGINT) AS negative_score
FROM p JOIN s AS n ON n.arow = p.arow AND n.clab <> p.alab
                  AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

ORACLES: dict[str, str] = {"op13_hard_negatives": OP13_SQL}
