"""Registered queries of this subpackage: every operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import configure
from . import ann, codes, decontam, katz, langid, licenses, lines, neardup, negatives, packing, pieces, quality, urls

# The vocabulary files belong to an installed package and are only named here.
BYTE_BPE, BYTE_BPE_RANKS, PIECE_BPE = "byte_bpe_50k.json", "byte_bpe_50k.tiktoken", "piece_bpe_32k.model"


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{folder}/{name}.parquet")


def _fold(doc_id: Column, folds: int) -> Column:
    """Remainder of the checksum of doc_id as text; null for a null doc_id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def pack(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers
    docs = _table(spark, folder, "documents")
    packed = packing.pack_documents(docs, tokenizers.path(BYTE_BPE), tokenizers.path(BYTE_BPE_RANKS), tokenizers.PATTERN)
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def license_scan(spark: SparkSession, folder: str) -> DataFrame:
    scanned = licenses.scan(licenses.document_paths(_table(spark, folder, "documents")))
    return scanned.withColumnRenamed("key", "doc_id")


def url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = _table(spark, folder, "pages")
    found = urls.evaluate(urls.page_captures(pages), urls.page_entries(pages))
    return found.withColumns({c: F.unix_timestamp(c) for c in ("fetched", "active_since")})


def nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return ann.nearest(_table(spark, folder, "embeddings"), F.col("vec_id") % 50 == 0)


def quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return quality.judge(docs, quality.fit(docs, _table(spark, folder, "labels")))


def sentence_pieces(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as tokenizers
    return pieces.round_trip(_table(spark, folder, "documents"), tokenizers.path(PIECE_BPE))


def lm_score(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    fold = _fold(F.col("doc_id"), 7)
    scored = katz.score_documents(docs, fold != 2)
    return scored.select("doc_id", F.coalesce(fold == 2, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def minhash(spark: SparkSession, folder: str) -> DataFrame:
    return neardup.duplicate_groups(_table(spark, folder, "documents"), k=2)


def line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, folder, "documents")).select("row.doc_id", "text", "n_lines", "n_removed")


def language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    fold = _fold(F.col("doc_id"), 5)
    model = langid.fit(docs.filter(fold != 0))
    named = langid.identify(docs, model)
    return named.select("doc_id", F.coalesce(fold == 0, F.lit(False)).alias("held_out"), "lang_pred", "score", "entropy", "rejected")


def decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = decontam.find(_table(spark, folder, "documents"), _table(spark, folder, "benchmark"))
    hit = F.aggregate(F.zip_with("ends", "begins", lambda e, b: e - b), F.lit(0).cast("long"), lambda total, n: total + n)
    return found.select("doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("begins") > 0).alias("contaminated"))


def hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.hard_negatives(_table(spark, folder, "embeddings").withColumn("label", moved), F.col("vec_id") % 100 == 0)


def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    coded, books = codes.compress(_table(spark, folder, "embeddings"))
    return codes.with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(codes.digest(books)).alias("codebooks_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": pack,
        "op2_license_scan": license_scan,
        "op3_url_filter": url_filter,
        "op4_nearest_vectors": nearest_vectors,
        "op5_quality_rules": quality_rules,
        "op6_sentence_pieces": sentence_pieces,
        "op7_katz_score": lm_score,
        "op8_minhash_near_dedup": minhash,
        "op9_line_dedup": line_dedup,
        "op10_language_id": language_id,
        "op11_decontamination": decontamination,
        "op12_hard_negatives": hard_negatives,
        "op13_vector_codes": vector_codes,
    }


def sql() -> dict[str, str]:
    """DuckDB SQL for the queries that it can express."""
    return {"op3_url_filter": urls.SQL, "op9_line_dedup": lines.SQL, "op11_decontamination": decontam.SQL,
            "op12_hard_negatives": negatives.SQL, "op13_vector_codes": codes.SQL}
