"""Evidence corpus: field extraction, chunking, hybrid retrieval and bundles."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import HashingTF, IDF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fx
from ..plans import cells, postings
from ..plans.cells import Cells
from ..plans.postings import Postings
from ..plans.windows import top_per_key

# Patterns of the document fields.
FIELD_PATTERNS = {
    "supplier_reference": r"(?i)supplier[:# ]+([A-Za-z]*#?[0-9]+)",
    "total_amount": r"(?i)total[:$ ]+([0-9]+(?:\.[0-9]{1,2})?)",
    "document_date": r"([0-9]{4}-[0-9]{2}-[0-9]{2})",
}
LINE_PATTERN = r"item ([0-9]+) x ([0-9]+)"


def extract_fields(docs: DataFrame, text: str) -> DataFrame:
    """Supplier reference, total, date and line count; what is absent or malformed is NULL."""
    got = {n: F.nullif(F.regexp_extract(text, p, 1), F.lit("")) for n, p in FIELD_PATTERNS.items()}
    return docs.withColumns({
        "supplier_reference": got["supplier_reference"],
        "total_amount": got["total_amount"].try_cast("double"),
        "document_date": got["document_date"].try_cast("date"),
        "n_lines": F.size(F.regexp_extract_all(F.col(text), F.lit(LINE_PATTERN), F.lit(1))),
    })


def parse_status(extracted: DataFrame) -> DataFrame:
    """pending until the document has a text, parsed when all three fields are present, else failed, with the missing fields."""
    waiting = F.col("text").isNull() if "text" in extracted.columns else F.lit(False)
    missing = F.concat_ws(",", *[F.when(F.col(c).isNull(), F.lit(c)) for c in FIELD_PATTERNS])
    return extracted.withColumn("missing_fields", missing).withColumn(
        "parse_status", F.when(waiting, "pending").when(missing == "", "parsed").otherwise("failed"))


def chunk(docs: DataFrame, key: str, text: str, size: int = 400, overlap: int = 50) -> DataFrame:
    """Paragraph-aware chunks of at most ``size`` tokens, ``overlap`` of them repeated.

    Paragraphs are packed greedily; one longer than a chunk is first cut into
    pieces. A fold over the piece lengths finds the chunk starts, so a document is
    read once and never leaves its row until the final explode.
    """
    step = size - overlap
    words = lambda c: F.regexp_extract_all(c, F.lit(r"(\S+)"), 1)
    lengths = F.filter(F.transform(F.split(F.col(text), "\n"), lambda p: F.regexp_count(p, F.lit(r"\S+"))), lambda n: n > 0)
    pieces = F.flatten(F.transform(lengths, lambda n: F.transform(
        F.sequence(F.lit(0), F.floor((n - 1) / step).cast("int")), lambda i: F.least(F.lit(step), n - i * step).cast("int"))))
    start = F.struct(F.lit(0).alias("pos"), F.lit(0).alias("fill"), F.array(F.lit(0)).alias("starts"))

    def add(acc: Column, n: Column) -> Column:
        full = acc["fill"] + n > step
        return F.struct(
            (acc["pos"] + n).alias("pos"), F.when(full, n).otherwise(acc["fill"] + n).alias("fill"),
            F.when(full, F.concat(acc["starts"], F.array(acc["pos"]))).otherwise(acc["starts"]).alias("starts"))

    packed = docs.select(key, words(F.col(text)).alias("_t"), F.aggregate(pieces, start, add).alias("_p"))
    bounds = F.arrays_zip(F.col("_p.starts").alias("b"), F.concat(
        F.slice(F.col("_p.starts"), F.lit(2), F.greatest(F.size("_p.starts") - 1, F.lit(0))), F.array(F.col("_p.pos"))).alias("e"))

    def cut_out(span: Column, i: Column) -> Column:
        begin = F.greatest(F.lit(0), span["b"] - overlap)
        return F.struct(i.alias("chunk_index"), (span["e"] - begin).alias("n_tokens"),
                        F.array_join(F.slice(F.col("_t"), begin + 1, span["e"] - begin), " ").alias("chunk_text"))

    # the spans are cut inside the row, so token lists are never copied per chunk
    return packed.select(key, F.explode(F.transform(bounds, cut_out)).alias("_c")).select(
        key, "_c.*").filter(F.col("n_tokens") > 0)


def filter_metadata(chunks: DataFrame, collections: Sequence[str] = (), supplier_id: int | None = None,
                    since: str | None = None) -> DataFrame:
    """Scope the search by entity, collection and date before any ranking."""
    if collections:
        chunks = chunks.filter(F.col("collection").isin(*collections))
    if supplier_id is not None:
        chunks = chunks.filter(F.col("supplier_id") == supplier_id)
    if since:
        chunks = chunks.filter(F.col("published_at") >= F.lit(since).cast("date"))
    return chunks


def vector_index(chunks: DataFrame, write=None) -> Cells:
    """Coarse cells over the chunks that have a vector."""
    vectors = chunks.filter(F.col("embedding").isNotNull()).select(F.col("chunk_id").alias("item_id"), fx.unit(F.col("embedding")).alias("vec"))
    return cells.build(vectors.filter(F.col("vec").isNotNull()), write=write)


def vector_search(queries: DataFrame, chunks: DataFrame, n: int, index: Cells | None = None) -> DataFrame:
    """Cosine top-n chunks per query: cells that cannot hold one of them are not opened (``plans/cells.py``).

    Without an ``index`` one is made of ``chunks``.
    """
    q = queries.select("query_id", fx.unit(F.col("embedding")).alias("vec"))
    hits = cells.search(index or vector_index(chunks), q.filter(F.col("vec").isNotNull()), n)
    return hits.select("query_id", F.col("item_id").alias("chunk_id"), "similarity", F.col("rank").alias("vector_rank"))


def keyword_search(queries: DataFrame, chunks: DataFrame, n: int, index: Postings | None = None) -> DataFrame:
    """BM25 top-n chunks per query, by an inverted index in blocks (``plans/postings.py``).

    Without an ``index`` one is made of ``chunks``, whose ``terms`` are used where they are there.
    """
    return postings.search(index or keyword_index(chunks), queries, n)


def keyword_index(chunks: DataFrame, write=lambda df: df) -> Postings:
    """The inverted index of ``chunks``, whose ``terms`` and ``n_terms`` are used where they are there; ``write`` keeps it as a table."""
    words = F.col("terms") if "terms" in chunks.columns else fx.terms(F.col("chunk_text"))
    length = F.col("n_terms") if "n_terms" in chunks.columns else F.size(words)
    return postings.build(chunks, words, length, write=write)


def rrf(vector_hits: DataFrame, keyword_hits: DataFrame, c: int = 60) -> DataFrame:
    """Reciprocal rank fusion: sum of 1 / (c + rank) over both lists."""
    both = vector_hits.join(keyword_hits, ["query_id", "chunk_id"], "full_outer")
    part = lambda r: F.coalesce(1 / (F.lit(float(c)) + F.col(r)), F.lit(0.0))
    return both.withColumn("rrf", F.round(part("vector_rank") + part("keyword_rank"), 9)).select(
        "query_id", "chunk_id", "similarity", "vector_rank", "keyword_rank", "rrf")


def rerank(fused: DataFrame, chunks: DataFrame, queries: DataFrame, as_of: str, min_similarity: float = 0.1,
           recency: float = 0.005, exact: float = 0.01) -> DataFrame:
    """Boost recent chunks and exact entity matches, halve those below the minimum similarity.

    ``queries`` holds (query_id, supplier_id); the boosts are parameters.
    """
    meta = chunks.select("chunk_id", "doc_id", "collection", F.col("supplier_id").alias("chunk_supplier"), "published_at")
    age = F.datediff(F.lit(as_of).cast("date"), F.col("published_at"))
    base = fused.join(meta, "chunk_id").join(queries.select("query_id", F.col("supplier_id").alias("asked_supplier")), "query_id")
    score = F.col("rrf") + F.lit(recency) * F.greatest(F.lit(0.0), 1 - age / 365.0) + F.when(
        F.col("chunk_supplier") == F.col("asked_supplier"), F.lit(exact)).otherwise(F.lit(0.0))
    weak = F.coalesce(F.col("similarity"), F.lit(0.0)) < min_similarity
    return base.withColumn("final_score", F.round(F.when(weak, score / 2).otherwise(score), 9)).select(
        "query_id", "chunk_id", "doc_id", "collection", "rrf", "final_score")


def retrieve(queries: DataFrame, chunks: DataFrame, as_of: str, k: int = 5, n: int = 20,
             collections: Sequence[str] = (), since: str | None = None,
             vectors: Cells | None = None, words: Postings | None = None) -> DataFrame:
    """Metadata filter, vector and keyword search, fusion, re-ranking, top-k with citation fields.

    ``vectors`` and ``words`` are written indexes of all ``chunks``; a search in a part of them makes its own.
    A query without any hit has no row, which is a valid answer.
    """
    pool = filter_metadata(chunks, collections, since=since)
    if collections or since:
        vectors = words = None
    fused = rrf(vector_search(queries, pool, n, vectors), keyword_search(queries, pool, n, words))
    ranked = rerank(fused, pool, queries, as_of)
    return top_per_key(ranked, ["query_id"], [F.col("final_score").desc(), F.col("chunk_id")], k, rank="rank")


def content_hash(text: str) -> Column:
    return F.md5(F.col(text))


def index_increment(indexed: DataFrame, docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents that are new or whose content changed; the index is only added to."""
    fresh = docs.withColumn("content_hash", content_hash(text))
    return fresh.join(indexed.select(key, "content_hash"), [key, "content_hash"], "left_anti")


def isolate_failures(docs: DataFrame, parsed: Column, name: str) -> tuple[DataFrame, DataFrame]:
    """(parsed, failed): a document whose value does not parse never stops the others."""
    out = docs.withColumn(name, parsed)
    return out.filter(F.col(name).isNotNull()), out.filter(F.col(name).isNull()).drop(name)


def retrieval_relevance(results: DataFrame, queries: DataFrame, judged: DataFrame) -> DataFrame:
    """Share of queries with at least one relevant document among their hits.

    ``judged`` holds (query_id, doc_id); without a query_id its documents are relevant to every query.
    """
    keys = [c for c in ("query_id", "doc_id") if c in judged.columns]
    hit = results.join(judged.select(*keys).distinct(), keys, "left_semi").select("query_id").distinct().withColumn("_h", F.lit(1))
    return queries.select("query_id").join(hit, "query_id", "left").agg(
        F.count("*").alias("n_queries"), fx.r6(F.avg(F.coalesce("_h", F.lit(0)))).alias("relevance"))


def evidence_bundle(scores: DataFrame, breakdown: DataFrame, hits: DataFrame, factors: int = 3) -> DataFrame:
    """Per supplier: score, top factors, citations and whether any evidence supports it.

    ``hits`` is a top-k result, so both arrays are short by construction.
    """
    top = top_per_key(breakdown.filter(F.col("contribution").isNotNull()), ["supplier_id"],
                      [F.col("contribution").desc(), F.col("signal")], factors)
    f = top.groupBy("supplier_id").agg(F.array_sort(F.collect_list(F.struct("contribution", "signal"))).alias("top_factors"))
    c = hits.groupBy("supplier_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "doc_id", "collection"))).alias("citations"))
    return scores.join(f, "supplier_id", "left").join(c, "supplier_id", "left").withColumn(
        "grounded", F.coalesce(F.size("citations") > 0, F.lit(False)))


def embed_tfidf(docs: DataFrame, key: str, text: str, dims: int = 256) -> DataFrame:
    """Hashed TF-IDF vectors of unit length."""
    words = docs.select(key, fx.terms(F.col(text)).alias("words"))
    tf = HashingTF(inputCol="words", outputCol="tf", numFeatures=dims).transform(words)
    idf = IDF(inputCol="tf", outputCol="tfidf").fit(tf).transform(tf)
    return Normalizer(inputCol="tfidf", outputCol="v").transform(idf).select(key, vector_to_array("v").alias("embedding"))


# Intent rules, first match wins.
INTENT_RULES = [
    ("action_request", r"\b(approve|order|switch|reorder|execute|send|create)\b"),
    ("score_lookup", r"\b(score|risk|probability|status|how many|level)\b"),
    ("explanation", r"\b(why|explain|because|reason|cause)\b"),
]


def classify_intent(messages: DataFrame, text: str) -> DataFrame:
    """One of four intents by keyword rules."""
    low = F.lower(F.col(text))
    intent = None
    for name, pattern in INTENT_RULES:
        intent = (F if intent is None else intent).when(F.rlike(low, F.lit(pattern)), name)
    return messages.withColumn("intent", intent.otherwise("general"))


def session_summary(messages: DataFrame) -> DataFrame:
    """Turns per role, last turn and characters per session."""
    return messages.groupBy("conv_id").agg(
        F.count("*").alias("n_turns"), F.count_if(F.col("role") == "user").alias("n_user"),
        F.count_if(F.col("role") == "assistant").alias("n_assistant"), F.max("turn").alias("last_turn"),
        F.sum(F.length("text")).alias("n_chars"))


def embedding_coverage(chunks: DataFrame, vectors: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chunks that have no vector yet, to be retried."""
    return chunks.join(vectors.select(key), key, "left_anti")
