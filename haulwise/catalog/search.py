"""Similarity and evidence retrieval queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..plans import cells, postings
from ..operators import evidence as ev, risk as rk, similarity as sm
from ..sources.model import CHUNK_OVERLAP, CHUNK_SIZE
from .ctes import ora

AS_OF = "2025-01-01"
TOKS = r"list_filter(regexp_split_to_array({0}, '\s+'), lambda t: t <> '')"
STEP = CHUNK_SIZE - CHUNK_OVERLAP
EXTRA = {
    # -- suppliers as vectors
    "vecs": """SELECT vec_id supplier_id, label component_type, CAST(embedding AS DOUBLE[]) v,
        sqrt(list_sum(list_transform(CAST(embedding AS DOUBLE[]), lambda x: x * x))) nv, coalesce(n_chars > 300, false) is_active
        FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "risk_now": "SELECT entity_id supplier_id, delay_probability risk FROM latest",
    "flagged": "SELECT v.* FROM vecs v JOIN risk_now r ON r.supplier_id = v.supplier_id AND risk >= 0.5",
    "neighbors": """SELECT supplier_id query_id, item_id, similarity, CAST(rn AS INTEGER) "rank" FROM (
        SELECT a.supplier_id, b.supplier_id item_id, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) + 0.0 similarity,
          row_number() OVER (PARTITION BY a.supplier_id ORDER BY round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) DESC, b.supplier_id) rn
        FROM vecs a JOIN vecs b ON a.component_type = b.component_type AND a.supplier_id <> b.supplier_id) WHERE rn <= 5""",
    "ranked": """SELECT supplier_id, candidate_id, similarity, CAST(rn AS INTEGER) "rank" FROM (
        SELECT a.supplier_id, b.supplier_id candidate_id, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) + 0.0 similarity,
          row_number() OVER (PARTITION BY a.supplier_id ORDER BY round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) DESC, b.supplier_id) rn
        FROM flagged a JOIN vecs b ON a.component_type = b.component_type AND a.supplier_id <> b.supplier_id AND b.is_active) WHERE rn <= 5""",
    # -- chunks
    "doc_tokens": f"""SELECT doc_id, {TOKS.format('text')} toks,
        flatten(list_transform(list_filter(list_transform(string_split(text, chr(10)), lambda p: len({TOKS.format('p')})), lambda n: n > 0),
          lambda n: list_transform(range(0, (n - 1) // {STEP} + 1), lambda i: least({STEP}, n - i * {STEP})))) pieces FROM documents""",
    "packed": f"""SELECT doc_id, 1 i, pieces[1] pos, pieces[1] fill, 0 ci, 0::BIGINT start FROM doc_tokens WHERE len(toks) > 0
        UNION ALL SELECT p.doc_id, i + 1, pos + pieces[i + 1], CASE WHEN fill + pieces[i + 1] > {STEP} THEN pieces[i + 1] ELSE fill + pieces[i + 1] END,
          ci + CASE WHEN fill + pieces[i + 1] > {STEP} THEN 1 ELSE 0 END, CASE WHEN fill + pieces[i + 1] > {STEP} THEN pos ELSE start END
        FROM packed p JOIN doc_tokens d ON d.doc_id = p.doc_id AND i < len(pieces)""",
    "spans": f"""SELECT doc_id, ci, greatest(0, start - {CHUNK_OVERLAP}) b, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY ci), n) e FROM (
        SELECT doc_id, ci, min(start) start FROM packed GROUP BY 1, 2) JOIN (SELECT doc_id, len(toks) n FROM doc_tokens) USING (doc_id)""",
    "chunks": """SELECT doc_id * 100000 + ci chunk_id, doc_id, ci chunk_index,
        CASE doc_id % 3 WHEN 0 THEN 'incidents' WHEN 1 THEN 'contracts' ELSE 'supplier_history' END collection,
        doc_id % (SELECT count(*) FROM supplier) supplier_id, DATE '2024-01-01' + CAST(doc_id % 365 AS INTEGER) published_at,
        array_to_string(toks[b + 1 : e], ' ') chunk_text, CAST(e - b AS INTEGER) n_tokens, CAST(embedding AS DOUBLE[]) embedding
        FROM spans JOIN doc_tokens USING (doc_id) LEFT JOIN embeddings ON vec_id = doc_id""",
    "questions": """SELECT item_id query_id, text, CAST(embedding AS DOUBLE[]) embedding, item_id % (SELECT count(*) FROM supplier) supplier_id
        FROM benchmark JOIN embeddings ON vec_id = item_id""",
    "vec_hits": """SELECT query_id, chunk_id, similarity, CAST(rn AS INTEGER) vector_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, chunk_id) rn FROM (
          SELECT query_id, chunk_id, round(list_dot_product(q.embedding, c.embedding) / sqrt(list_dot_product(q.embedding, q.embedding)
            * list_dot_product(c.embedding, c.embedding)), 6) + 0.0 similarity FROM questions q, chunks c WHERE c.embedding IS NOT NULL)) WHERE rn <= 20""",
    "words": "SELECT chunk_id, len(w) dl, w FROM (SELECT chunk_id, regexp_extract_all(lower(chunk_text), '[a-z0-9]+') w FROM chunks)",
    "postings": "SELECT term, chunk_id, dl, count(*) tf FROM (SELECT chunk_id, dl, unnest(w) term FROM words) GROUP BY 1, 2, 3",
    "q_terms": "SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) term FROM questions",
    "kw_hits": """SELECT query_id, chunk_id, bm25, CAST(rn AS INTEGER) keyword_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY bm25 DESC, chunk_id) rn FROM (
          SELECT query_id, chunk_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) bm25
          FROM postings JOIN q_terms USING (term) JOIN (SELECT term, count(*)::DOUBLE df FROM postings GROUP BY 1) USING (term),
            (SELECT count(*)::DOUBLE n, avg(dl) avgdl FROM words) GROUP BY 1, 2)) WHERE rn <= 20""",
    "fused": """SELECT coalesce(v.query_id, k.query_id) query_id, coalesce(v.chunk_id, k.chunk_id) chunk_id, similarity, vector_rank, keyword_rank,
        round(coalesce(1 / (60.0::DOUBLE + vector_rank), 0) + coalesce(1 / (60.0::DOUBLE + keyword_rank), 0), 9) rrf
        FROM vec_hits v FULL JOIN kw_hits k ON k.query_id = v.query_id AND k.chunk_id = v.chunk_id""",
    "reranked": f"""SELECT query_id, chunk_id, doc_id, collection, rrf, round(CASE WHEN coalesce(similarity, 0) < 0.1 THEN s / 2 ELSE s END, 9) final_score FROM (
        SELECT f.*, c.doc_id, c.collection, rrf + 0.005::DOUBLE * greatest(0, 1 - (DATE '{AS_OF}' - published_at) / 365.0::DOUBLE)
          + CASE WHEN c.supplier_id = q.supplier_id THEN 0.01::DOUBLE ELSE 0 END s
        FROM fused f JOIN chunks c ON c.chunk_id = f.chunk_id JOIN questions q ON q.query_id = f.query_id)""",
    "retrieved": """SELECT query_id, chunk_id, doc_id, collection, rrf, final_score, CAST(rn AS INTEGER) "rank" FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY final_score DESC, chunk_id) rn FROM reranked) WHERE rn <= 5""",
    "invoices": """SELECT o_orderkey order_id, 'Invoice Supplier' || CASE WHEN o_orderkey % 11 = 0 THEN ' unknown' ELSE '#' || o_custkey END
          || ' item ' || o_custkey || ' x ' || (o_orderkey % 9 + 1) || CASE WHEN o_orderkey % 2 = 0 THEN ' item 7 x 3' ELSE '' END
          || CASE WHEN o_orderkey % 13 = 0 THEN '' ELSE ' Total: ' || CAST(CAST(o_totalprice AS DECIMAL(14,2)) AS VARCHAR) END
          || ' Date: ' || CASE WHEN o_orderkey % 17 = 0 THEN '1998-13-45' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS text FROM orders""",
    "extracted": r"""SELECT order_id, text, nullif(regexp_extract(text, '(?i)supplier[:# ]+([A-Za-z]*#?[0-9]+)', 1), '') supplier_reference,
        TRY_CAST(nullif(regexp_extract(text, '(?i)total[:$ ]+([0-9]+(?:\.[0-9]{1,2})?)', 1), '') AS DOUBLE) total_amount,
        TRY_CAST(nullif(regexp_extract(text, '([0-9]{4}-[0-9]{2}-[0-9]{2})', 1), '') AS DATE) document_date,
        CAST(len(regexp_extract_all(text, 'item ([0-9]+) x ([0-9]+)')) AS INTEGER) n_lines FROM invoices""",
}


def esql(sql: str) -> str:
    return ora(sql, EXTRA)


def vectors(m):
    """Suppliers with component type, unit vector and activity."""
    active = m.raw("documents").select(F.col("doc_id").alias("supplier_id"), (F.col("n_chars") > 300).alias("_a"))
    emb = m.raw("embeddings").select(F.col("vec_id").alias("supplier_id"), F.col("label").alias("component_type"), F.col("embedding").alias("vec"))
    return sm.unit_vectors(emb, "supplier_id", "vec").join(active, "supplier_id", "left").withColumn(
        "is_active", F.coalesce("_a", F.lit(False))).drop("_a")


def risk_now(m):
    return rk.latest_score(m.scores).select(F.col("entity_id").alias("supplier_id"), F.col("delay_probability").alias("risk"))


def flagged(m):
    return vectors(m).join(risk_now(m).filter(F.col("risk") >= 0.5).select("supplier_id"), "supplier_id", "left_semi")


def ranked(m):
    return sm.top_k_similar(flagged(m), sm.candidates(flagged(m), vectors(m)), 5)


def questions(m):
    n = m.raw("supplier").agg(F.count("*").alias("n")).scalar()
    return m.questions.withColumn("supplier_id", F.col("query_id") % n)


def invoices(m):
    """Invoice texts spelled out from the orders, some of them faulty."""
    k, c = F.col("o_orderkey"), F.col("o_custkey").cast("string")
    text = F.concat(
        F.lit("Invoice Supplier"), F.when(k % 11 == 0, " unknown").otherwise(F.concat(F.lit("#"), c)),
        F.lit(" item "), c, F.lit(" x "), (k % 9 + 1).cast("string"), F.when(k % 2 == 0, " item 7 x 3").otherwise(""),
        F.when(k % 13 == 0, "").otherwise(F.concat(F.lit(" Total: "), F.col("o_totalprice").cast("decimal(14,2)").cast("string"))),
        F.lit(" Date: "), F.when(k % 17 == 0, "1998-13-45").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")))
    return m.raw("orders").select(k.alias("order_id"), text.alias("text"))


def retrieved(m):
    return ev.retrieve(questions(m), m.index, AS_OF, vectors=m.cells, words=m.postings)


def bundle(m):
    scores = rk.enrich(m.supplier_signals)
    hits = retrieved(m).join(questions(m).select("query_id", "supplier_id"), "query_id")
    return ev.evidence_bundle(scores, rk.formula_breakdown(m.supplier_signals, "supplier_id"), hits)


def indexed(m):
    """The index before this batch: some documents missing, some in an older version."""
    return m.raw("documents").filter(F.col("doc_id") % 7 != 0).select(
        "doc_id", F.when(F.col("doc_id") % 5 == 0, F.md5(F.concat("text", F.lit("old")))).otherwise(F.md5("text")).alias("content_hash"))


def register(cat) -> None:
    # -- alternative suppliers ---------------------------------------------------------------
    cat.add("candidates", lambda m: sm.candidates(flagged(m), vectors(m)).select("supplier_id", "component_type"), esql("""
        SELECT supplier_id, component_type FROM vecs WHERE is_active AND component_type IN (SELECT component_type FROM flagged)"""))
    cat.add("cosine", lambda m: m.raw("embeddings").select(
        "vec_id", fx.r6(fx.cosine(fx.doubles(F.col("embedding")), F.reverse(fx.doubles(F.col("embedding"))))).alias("similarity")), """
        SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), list_reverse(CAST(embedding AS DOUBLE[]))), 6) + 0.0 similarity
        FROM embeddings""")
    cat.add("similar_to", lambda m: sm.similar_to(vectors(m), 5), esql("SELECT * FROM neighbors"))
    cat.add("top_k_similar", ranked, esql("SELECT * FROM ranked"))
    cat.add("lower_risk", lambda m: sm.lower_risk(ranked(m), risk_now(m)), esql("""
        SELECT r.supplier_id, candidate_id, similarity, "rank", a.risk own_risk, b.risk candidate_risk, round(a.risk - b.risk, 6) + 0.0 risk_reduction
        FROM ranked r JOIN risk_now a ON a.supplier_id = r.supplier_id JOIN risk_now b ON b.supplier_id = candidate_id
        WHERE round(a.risk - b.risk, 6) > 0"""))
    cat.add("unresolvable", lambda m: sm.unresolvable(
        m.orders.filter(F.col("status") == "at_risk").select(F.col("customer_id").alias("supplier_id")).distinct(), vectors(m)), esql("""
        SELECT DISTINCT customer_id supplier_id FROM ord WHERE status = 'at_risk' AND customer_id NOT IN (SELECT supplier_id FROM vecs)"""))
    cat.add("approx_neighbors", lambda m: sm.approx_neighbors(vectors(m), 5))
    cat.add("recall_at_k", lambda m: sm.recall_at_k(sm.similar_to(vectors(m).withColumn("component_type", F.lit(0)), 5),
                                                    sm.approx_neighbors(vectors(m), 5)))
    cat.add("neighbor_cost", lambda m: sm.neighbor_cost(vectors(m), 5))
    cat.add("certified_neighbors", lambda m: sm.certified_neighbors(vectors(m), 5), esql("""
        SELECT supplier_id query_id, item_id, similarity, CAST(rn AS INTEGER) "rank" FROM (
          SELECT a.supplier_id, b.supplier_id item_id, round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) + 0.0 similarity,
            row_number() OVER (PARTITION BY a.supplier_id ORDER BY round(list_dot_product(a.v, b.v) / (a.nv * b.nv), 6) DESC, b.supplier_id) rn
          FROM vecs a JOIN vecs b ON a.supplier_id <> b.supplier_id) WHERE rn <= 5"""))

    # -- evidence ----------------------------------------------------------------------------
    cat.add("extract_fields", lambda m: ev.extract_fields(invoices(m), "text"), esql("SELECT * FROM extracted"))
    cat.add("parse_status", lambda m: ev.parse_status(ev.extract_fields(invoices(m), "text")).groupBy("parse_status", "missing_fields").agg(
        F.count("*").alias("n")), esql("""
        SELECT CASE WHEN mf = '' THEN 'parsed' ELSE 'failed' END parse_status, mf missing_fields, count(*) n FROM (SELECT concat_ws(',',
          CASE WHEN supplier_reference IS NULL THEN 'supplier_reference' END, CASE WHEN total_amount IS NULL THEN 'total_amount' END,
          CASE WHEN document_date IS NULL THEN 'document_date' END) mf FROM extracted) GROUP BY 1, 2"""))
    cat.add("chunk", lambda m: m.chunks.select("chunk_id", "doc_id", "chunk_index", "n_tokens", F.md5("chunk_text").alias("text_md5")), esql("""
        SELECT chunk_id, doc_id, chunk_index, n_tokens, md5(chunk_text) text_md5 FROM chunks"""))
    cat.add("filter_metadata", lambda m: ev.filter_metadata(m.chunks, ["incidents", "contracts"], 7, "2024-03-01").select(
        "chunk_id", "collection", "supplier_id", "published_at"), esql("""
        SELECT chunk_id, collection, supplier_id, published_at FROM chunks WHERE collection IN ('incidents', 'contracts') AND supplier_id = 7
          AND published_at >= DATE '2024-03-01'"""))
    cat.add("vector_search", lambda m: ev.vector_search(questions(m), m.index, 20, m.cells), esql("SELECT * FROM vec_hits"))
    cat.add("keyword_search", lambda m: ev.keyword_search(questions(m), m.index, 20, m.postings), esql("SELECT * FROM kw_hits"))
    cat.add("keyword_search_cost", lambda m: postings.cost(m.postings, questions(m), 20).select("pairs_that_share"), esql("""
        SELECT count(*) pairs_that_share FROM (SELECT DISTINCT query_id, chunk_id FROM q_terms JOIN postings USING (term))"""))
    cat.add("keyword_search_scored", lambda m: postings.cost(m.postings, questions(m), 20))
    cat.add("rrf", lambda m: ev.rrf(ev.vector_search(questions(m), m.index, 20, m.cells), ev.keyword_search(questions(m), m.index, 20, m.postings)),
            esql("SELECT * FROM fused"))
    cat.add("rerank", lambda m: ev.rerank(ev.rrf(ev.vector_search(questions(m), m.index, 20, m.cells), ev.keyword_search(questions(m), m.index, 20, m.postings)),
                                          m.index, questions(m), AS_OF), esql("SELECT * FROM reranked"))
    cat.add("retrieve", lambda m: retrieved(m), esql("SELECT * FROM retrieved"))
    cat.add("index_increment", lambda m: ev.index_increment(indexed(m), m.raw("documents").select("doc_id", "text")).select("doc_id", "content_hash"),
            "SELECT doc_id, md5(text) content_hash FROM documents WHERE doc_id % 7 = 0 OR doc_id % 5 = 0")

    def isolate(m):
        value = F.regexp_extract("text", "([0-9]+)", 1).try_cast("int")
        good, bad = ev.isolate_failures(m.raw("documents").select("doc_id", "text"), value, "first_number")
        return good.select("doc_id", "first_number", F.lit("parsed").alias("state")).unionByName(
            bad.select("doc_id", F.lit(None).cast("int").alias("first_number"), F.lit("failed").alias("state")))
    cat.add("isolate_failures", isolate, """
        SELECT doc_id, v first_number, CASE WHEN v IS NULL THEN 'failed' ELSE 'parsed' END state FROM (
          SELECT doc_id, TRY_CAST(nullif(regexp_extract(text, '([0-9]+)', 1), '') AS INTEGER) v FROM documents)""")
    cat.add("retrieval_relevance", lambda m: ev.retrieval_relevance(
        retrieved(m), questions(m), m.raw("labels").filter("quality = 1")), esql("""
        SELECT count(*) n_queries, round(avg(CASE WHEN query_id IN (SELECT query_id FROM retrieved WHERE doc_id IN
          (SELECT doc_id FROM labels WHERE quality = 1)) THEN 1.0 ELSE 0.0 END), 6) relevance FROM questions"""))
    def judged(m):
        """A document is judged for the questions of its own supplier."""
        good = m.raw("labels").filter("quality = 1").select("doc_id")
        n = m.raw("supplier").agg(F.count("*").alias("n")).scalar()
        return good.withColumn("supplier_id", F.col("doc_id") % n).join(questions(m).select("query_id", "supplier_id"), "supplier_id").select("query_id", "doc_id")
    cat.add("retrieval_relevance_judged", lambda m: ev.retrieval_relevance(retrieved(m), questions(m), judged(m)), esql("""
        SELECT count(*) n_queries, round(avg(CASE WHEN query_id IN (SELECT r.query_id FROM retrieved r JOIN questions q ON q.query_id = r.query_id
          JOIN labels l ON l.doc_id = r.doc_id AND l.quality = 1 WHERE r.doc_id % (SELECT count(*) FROM supplier) = q.supplier_id)
          THEN 1.0 ELSE 0.0 END), 6) relevance FROM questions"""))
    cat.add("evidence_bundle", bundle)
    cat.add("evidence_bundle_citations", lambda m: bundle(m).select(
        "supplier_id", "grounded", F.size("top_factors").alias("n_factors"), F.explode_outer("citations").alias("c")).select(
        "supplier_id", "grounded", "n_factors", F.col("c.chunk_id").alias("chunk_id"), F.col("c.rank").alias("rank")), esql("""
        SELECT e.supplier_id, chunk_id IS NOT NULL grounded, CAST(least(3, (supplier_risk IS NOT NULL)::INT + (delay_risk IS NOT NULL)::INT
          + (inventory_risk IS NOT NULL)::INT + (demand_risk IS NOT NULL)::INT + (financial_risk IS NOT NULL)::INT) AS INTEGER) n_factors, chunk_id, "rank"
        FROM supplier_signals e LEFT JOIN (SELECT q.supplier_id, chunk_id, "rank" FROM retrieved r JOIN questions q ON q.query_id = r.query_id) h
          ON h.supplier_id = e.supplier_id"""))
    cat.add("embed_tfidf", lambda m: ev.embed_tfidf(m.raw("documents"), "doc_id", "text"))
    cat.add("classify_intent", lambda m: ev.classify_intent(m.raw("conversations"), "text").select("conv_id", "turn", "intent"), r"""
        SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), '\b(approve|order|switch|reorder|execute|send|create)\b') THEN 'action_request'
          WHEN regexp_matches(lower(text), '\b(score|risk|probability|status|how many|level)\b') THEN 'score_lookup'
          WHEN regexp_matches(lower(text), '\b(why|explain|because|reason|cause)\b') THEN 'explanation' ELSE 'general' END intent FROM conversations""")
    cat.add("session_summary", lambda m: ev.session_summary(m.raw("conversations")), """
        SELECT conv_id, count(*) n_turns, count(*) FILTER (role = 'user') n_user, count(*) FILTER (role = 'assistant') n_assistant,
          max(turn) last_turn, CAST(sum(length(text)) AS BIGINT) n_chars FROM conversations GROUP BY 1""")
    cat.add("embedding_coverage", lambda m: ev.embedding_coverage(
        m.chunks.select("chunk_id", "doc_id"), m.raw("embeddings").select(F.col("vec_id").alias("doc_id"))), esql("""
        SELECT chunk_id, doc_id FROM chunks WHERE doc_id NOT IN (SELECT vec_id FROM embeddings)"""))
