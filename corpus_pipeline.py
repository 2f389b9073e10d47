"""The corpus pipeline: raw documents in, packed training sequences out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from haulwise.llm import langid, lines, neardup, packing, quality
from haulwise.llm.catalog import BYTE_BPE, BYTE_BPE_RANKS
from haulwise.session import configure, scratch_path


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines are content in the main; the field learns from the labels of documents still here."""
    return quality.retain(docs, quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that read like one of the languages of the corpus."""
    return langid.accept(docs, langid.fit(docs))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand earlier; one that consists of such passages only goes."""
    cleaned = lines.dedup_lines(docs).filter("n_removed = 0 or n_removed < n_lines")
    texts = {"text": F.col("text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType))
             .otherwise(F.col("row.n_chars"))}
    return cleaned.select(*[texts.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest doc_id."""
    return neardup.keep_one(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    import public_tokenizers as tokenizers
    return packing.pack_documents(docs, tokenizers.path(BYTE_BPE), tokenizers.path(BYTE_BPE_RANKS), tokenizers.PATTERN)


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("best_fit_packing", best_fit_packing),
]

# Learned fields and models, MinHash and the linear program are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = configure(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
