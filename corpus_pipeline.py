"""The corpus pipeline: quality rules, near dedup, substring dedup, mixing
sources to target weights, byte-level BPE encoding.

Each stage is a function (spark, docs, sf_dir) -> DataFrame over all rows its
predecessor kept; ``run`` writes each stage's result as Parquet into the shared
folder and reads it back as the next one's documents. All stages but the last
return the columns of ``documents``; a document that the mix takes twice is two
rows, and one of which it takes parts is a row of those parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarkframe.llm import bpe, mixing, neardup, quality_rules, substring
from quarkframe.llm.common import documents, store

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
NEAR_PERCENT = 80      # least similarity of near duplicates (op7_minhash: 85)


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base and the adaptive quality rules."""
    return quality_rules.filter_documents(docs)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (similarity 0.8 or more)."""
    return neardup.one_of_each(docs, NEAR_PERCENT)


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the 50-word passages that an earlier document has."""
    return substring.cut(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, or parts of them, that the mix of sources takes."""
    return mixing.mix(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every text of the mix."""
    import public_tokenizers as vocabularies

    shared = bpe.codec_broadcast(spark, vocabularies.path(VOCABULARY), vocabularies.PATTERN)
    return bpe.digest_documents(docs, shared)


STAGES = [
    ("quality rules", quality_stage),
    ("near dedup", near_dedup_stage),
    ("substring dedup", substring_stage),
    ("mixing", mixing_stage),
    ("byte-level BPE", encoding_stage),
]

#: No SQL: MinHash links, hash permutations and BPE merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = store(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
