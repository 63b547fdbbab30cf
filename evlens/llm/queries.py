"""Registered queries of the training-data operators, with their production parameters."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evlens.llm import (ann, bpe, chat, interpolation, langid, lexical, license_scan, packing, quality, secret_scan, simhash,
                        substring, whitening)
from evlens.llm.common import read_table


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one that tries the escapes, read back from the emitted prefix tree."""
    tricky = "\\### Assistant: </turn> ok"
    probe = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)],
                                  "conv_id long, turn long, role string, text string")
    turns = chat.turns_of(read_table(spark, sf_dir, "conversations"))
    return chat.read_back(*chat.build(turns.unionByName(probe)))


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50."""
    return ann.nearest(read_table(spark, sf_dir, "embeddings"), lambda c: F.col(c) % 50 == 0)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rules and classifier verdict of every document."""
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices of every document."""
    return license_scan.scan(read_table(spark, sf_dir, "documents"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secret_scan.summary(read_table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded bytes of every document."""
    import public_tokenizers

    return bpe.digests(read_table(spark, sf_dir, "documents"),
                       public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces, placed in sequences of at most 1024 tokens."""
    import public_tokenizers

    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                        public_tokenizers.PATTERN)


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = read_table(spark, sf_dir, "documents")
    found = langid.predict(docs, langid.learn(docs))
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score", "rejected")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, and what is left without windows seen earlier."""
    return substring.digests(read_table(spark, sf_dir, "documents"))


def op11_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probability of every document under the interpolated model and the base model."""
    return interpolation.score(read_table(spark, sf_dir, "documents"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents of every benchmark item."""
    return lexical.search(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of every embedding."""
    return whitening.whiten(read_table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_chat_format, op3_nearest, op4_quality_rules, op5_license_scan,
                                    op6_secret_scan, op7_byte_bpe, op8_best_fit_packing, op9_language_id,
                                    op10_substring_dedup, op11_lm_scores, op12_ranked_search, op13_whitening)}


def oracle_sql() -> dict[str, str]:
    from evlens.llm import oracle

    return {"op2_chat_format": oracle.OP2, "op10_substring_dedup": oracle.OP10, "op12_ranked_search": oracle.OP12}
