"""The registered queries of the training-data operators: each applies its
operator, with production parameters, to its whole table."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (bpe, brown, conversations, langid, merkle, mixing, neardup, quality_mil, quality_rules, secrets, substring,
               toxicity, whitening)
from .common import doc_mod, documents


def _held_out(modulus: int, remainder: int) -> Column:
    """A null doc_id is not held out."""
    return F.coalesce(doc_mod(modulus) == remainder, F.lit(False))


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def op1_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    held_out = _held_out(7, 2)
    model = brown.fit(docs.where(~held_out))
    return brown.score(docs, model, held_out).withColumnRenamed("extra", "held_out")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(documents(spark, sf_dir))


def op3_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(documents(spark, sf_dir))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as vocabularies

    shared = bpe.codec_broadcast(spark, vocabularies.path("byte_bpe_multi_50k.tiktoken"), vocabularies.PATTERN)
    return bpe.digest_documents(documents(spark, sf_dir), shared)


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    out, q = quality_rules.judge(docs, payload=["doc_id", "lang", "source"])
    return out.select("doc_id", *[F.col(q)[c].alias(c) for c in (
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")])


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), _held_out(5, 0)
    model = toxicity.fit(docs, _labels(spark, sf_dir).where(~held_out))
    return toxicity.score(docs, model, held_out).withColumnRenamed("extra", "held_out")


def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir))


def op8_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.digest(documents(spark, sf_dir))


def op9_quality_mil(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = documents(spark, sf_dir).select("doc_id", "text"), _held_out(4, 2)
    model = quality_mil.fit(docs, _labels(spark, sf_dir).where(~held_out))
    return quality_mil.score(docs, model, held_out).withColumnRenamed("extra", "held_out")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    held_out = _held_out(3, 1)
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "accepted")


def op11_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet")
    fixed = conversations.repair(conversations.damaged(rows))
    sha = conversations.digests(fixed.turns).withColumnRenamed("conv_id", "of")
    return fixed.report.join(sha, F.col("conv_id").eqNullSafe(F.col("of"))).select(
        "conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"))


def op13_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("secrets", lambda s: s["kind"] != "entropy")
    n = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", n("assign"), n("access"), n("hex"),
                        F.sha2(secrets.listing(base), 256).alias("base_sha256"),
                        secrets.listing(F.col("secrets")).alias("spans"), n("entropy"))


QUERIES = {
    "pipeline": corpus_pipeline.run,
    "op1_brown": op1_brown,
    "op2_mixing": op2_mixing,
    "op3_substring": op3_substring,
    "op4_bpe": op4_bpe,
    "op5_quality_rules": op5_quality_rules,
    "op6_toxicity": op6_toxicity,
    "op7_minhash": op7_minhash,
    "op8_merkle": op8_merkle,
    "op9_quality_mil": op9_quality_mil,
    "op10_language_id": op10_language_id,
    "op11_conversations": op11_conversations,
    "op12_whitening": op12_whitening,
    "op13_secrets": op13_secrets,
}

ORACLE_SQL: dict[str, str] = {}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
