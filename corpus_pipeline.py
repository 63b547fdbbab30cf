"""From documents to packed training sequences, in five stages.

Every stage is a function (spark, docs, sf_dir) -> DataFrame; what it returns is written
as Parquet and read again as the next stage's docs. All but the last return the columns
of documents. Of near-duplicate rows one stays, whatever ids they have or lack, and which
one it is depends on the rows alone.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evlens.llm import packing, quality, secret_scan, simhash, substring
from evlens.llm.common import read_table, stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the classifier."""
    return quality.keep(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate component: of the smallest id (null last), then the smallest hash of its text."""
    near = simhash.grouped(docs)
    stay = (near.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("least"))
            .select(F.col("least.doc_id").alias("stay_id"), F.col("least.text_hash").alias("stay_hash")))
    named = docs.withColumn("own_hash", F.xxhash64(F.col("text").cast("string")))
    kept = named.join(stay, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("own_hash") == F.col("stay_hash")), "left_semi")
    # Rows alike in id and text: the smallest by a hash of all columns.
    alike = Window.partitionBy("doc_id", "own_hash").orderBy(F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))
    return kept.withColumn("own_place", F.row_number().over(alike)).where("own_place = 1").select(docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the word windows that start earlier; documents that lose every word go."""
    cut = (substring.without_repeats(docs)
           .select(F.col("doc_id").alias("cut_id"), F.col("version").alias("cut_version"), F.col("text").alias("left_text"),
                   F.lit(True).alias("was_cut")))
    both = docs.withColumn("own_version", substring.text_version("text")).join(
        cut, F.col("doc_id").eqNullSafe(F.col("cut_id")) & (F.col("own_version") == F.col("cut_version")), "left")
    gone = F.col("was_cut") & (F.coalesce(F.col("left_text"), F.lit("")).rlike(r"^[\x20\x09-\x0D]*$"))
    return _with_text(both.where(~F.coalesce(gone, F.lit(False))), docs, F.when(F.col("was_cut"), F.col("left_text")))


def secrets_redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every secret replaced by a fixed mark."""
    return secret_scan.redact(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


def _with_text(rows: DataFrame, like: DataFrame, changed) -> DataFrame:
    """The columns of ``like`` with the new text where there is one, and its length."""
    text = F.coalesce(changed, F.col("text"))
    size = F.when(changed.isNotNull(), F.char_length(text).cast("long")).otherwise(F.col("n_chars"))
    new = {"text": text, "n_chars": size}
    return rows.select(*[(new[c] if c in new else F.col(f"`{c}`")).alias(c) for c in like.columns])


STAGES = [("quality_rules", quality_rules), ("simhash_near_dedup", simhash_near_dedup), ("substring_dedup", substring_dedup),
          ("secret_scan", secrets_redacted), ("best_fit_packing", best_fit_packing)]

# The classifier's verdicts and the fitted packing plan have no SQL form; the tests hold every
# stage against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
