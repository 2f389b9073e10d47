"""An inverted index in blocks with their largest impact, and top-n search that skips.

The impact of a posting is its share of the BM25 score without the term's weight; it needs
nothing but the chunk and the mean length, so it is written once. Postings of a term are
grouped by shard (a hash of the chunk, about ``SHARD`` chunks) and by size of impact. A block is
bounded by the shard, so a term that is in every chunk has many blocks and is no hot group. Chunks move to
their shard once, as they are; words, frequencies and blocks are made there.

A query first scores the best chunks of its rarest terms, which gives a score that its n-th answer reaches at least. Terms
whose bounds together stay under that score cannot bring up a chunk alone and are not opened; nor are blocks
whose largest impact is too small. Chunks that can still reach the score are scored in full.

Scores are added up inside tasks, each of one shard, which holds the blocks of the asked terms and returns the first n of
each query. The terms of a bounded number of queries are sent to all tasks, so only the blocks of asked terms move, once for
these queries: what is shuffled grows with the index, not with the pairs of a query and a chunk that share a word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as fx
from ..session import cut, written
from .tiles import first_per_row
from .windows import top_per_key

K1, B = 1.2, 0.75
SHARD = 2048
STEP = 0.1
# Answers to look for among the rarest terms, as a multiple of n.
SEEDS = 4
# Share of that score that terms left closed may add up to: more closes more terms, but leaves more chunks to score.
CLOSED = 0.3
# Queries whose scores in a shard a task holds at a time, and whose terms are sent to all tasks at once.
ASKING = 256
SENT = 4096


class Postings:
    """``blocks`` (term, shard, level, n, top, postings), the number of chunks and of shards."""

    def __init__(self, blocks: DataFrame, n: int, shards: int) -> None:
        self.blocks, self.n, self.shards = blocks, n, shards


def impact(tf: Column, length: Column, mean: float, k1: float, b: float) -> Column:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * length / F.lit(mean)))


def build(chunks: DataFrame, words: Column, length: Column, k1: float = K1, b: float = B, write=lambda df: df) -> Postings:
    """The index of ``chunks`` (chunk_id, ...) with their ``words`` and number of words; ``write`` keeps the blocks as a table."""
    row = chunks.agg(F.count("*").alias("n"), F.avg(length).alias("mean")).first()
    shards = max(1, -(-row.n // SHARD))
    # the chunks move to their shards before their words are taken; all that follows stays in the task of a shard
    dealt = chunks.withColumn("shard", F.pmod(F.xxhash64("chunk_id"), F.lit(shards)).cast("int")).repartition(shards, "shard")
    flat = dealt.select("shard", "chunk_id", words.alias("w")).select("shard", "chunk_id", F.size("w").alias("dl"), F.explode("w").alias("term"))
    tf = flat.groupBy("shard", "term", "chunk_id", "dl").agg(F.count("*").alias("tf"))
    weighed = tf.select("shard", "term", "chunk_id", impact(F.col("tf"), F.col("dl"), row.mean or 1.0, k1, b).alias("impact"))
    blocks = weighed.groupBy("term", "shard", F.floor(F.col("impact") / STEP).cast("int").alias("level")).agg(
        F.count("*").alias("n"), F.max("impact").alias("top"), F.collect_list(F.struct("chunk_id", "impact")).alias("postings"))
    return Postings(write(blocks), row.n, shards)


def _asks(index: Postings, queries: DataFrame) -> DataFrame:
    """(query_id, term) with the term's document frequency, weight and the most it can add."""
    q = queries.select("query_id", F.explode(F.array_distinct(fx.terms(F.col("text")))).alias("term"))
    stats = index.blocks.join(q.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df"), F.max("top").alias("top"))
    idf = F.ln(1 + (F.lit(float(index.n)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return q.join(stats, "term").select("query_id", "term", "df", idf.alias("idf"), (idf * F.col("top")).alias("bound"))


def _opened(index: Postings, asks: DataFrame, keep: Column | None = None) -> DataFrame:
    """Matches (query_id, chunk_id, part) of the terms in ``asks``, from the blocks that ``keep`` does not rule out."""
    met = index.blocks.join(asks, "term")
    met = met if keep is None else met.filter(keep)
    return met.select("query_id", "idf", F.inline("postings")).select("query_id", "chunk_id", (F.col("idf") * F.col("impact")).alias("part"))


def _of_asked(index: Postings, asks: DataFrame) -> DataFrame:
    """The blocks of the terms of a bounded number of queries."""
    return index.blocks.join(F.broadcast(asks.select("term").distinct()), "term", "left_semi")


def _in_turns(asks: DataFrame) -> Iterator[Column]:
    """Conditions on query_id, each for about ``SENT`` of the queries at most."""
    turns = max(1, -(-asks.select("query_id").distinct().count() // SENT))
    for i in range(turns):
        yield F.pmod(F.xxhash64("query_id"), F.lit(turns)) == i


def _united(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def _scored(index: Postings, asks: DataFrame, pairs: DataFrame) -> DataFrame:
    """Full scores of (query_id, chunk_id), a bounded number for each query, from the blocks of its terms."""
    def scored(turn: Column) -> DataFrame:
        some, wanted = asks.filter(turn).select("query_id", "term", "idf"), pairs.filter(turn)
        held = _of_asked(index, some).select("term", F.inline("postings")).join(F.broadcast(wanted.select("chunk_id").distinct()), "chunk_id", "left_semi")
        met = wanted.join(held, "chunk_id").join(some, ["query_id", "term"])
        return met.groupBy("query_id", "chunk_id").agg(F.sum(F.col("idf") * F.col("impact")).alias("score"))
    return _united([written(scored(turn), "scored") for turn in _in_turns(asks)])


_NONE = np.iinfo(np.int64).min


class Shard:
    """The blocks of one shard that hold a term asked by some queries; scores are arrays of a row per query and a column per chunk."""

    def __init__(self, blocks: pa.Table, asks: pa.Table) -> None:
        terms = pc.unique(asks.column("term")).sort()
        code, asked = (pc.index_in(t.column("term"), value_set=terms).fill_null(-1).to_numpy() for t in (blocks, asks))
        both = np.intersect1d(code, asked)
        blocks, code = blocks.filter(pa.array(np.isin(code, both))), code[np.isin(code, both)]
        asks, asked = asks.filter(pa.array(np.isin(asked, both))), asked[np.isin(asked, both)]
        order = np.lexsort((blocks.column("level").to_numpy(), code))
        blocks, code = blocks.take(pa.array(order)), code[order]
        order = np.argsort(asked, kind="stable")
        asks, asked = asks.take(pa.array(order)), asked[order]
        # the queries that ask for the term of every block
        self._from, self._to = np.searchsorted(asked, code, "left"), np.searchsorted(asked, code, "right")
        self.columns = {c: blocks.column(c).combine_chunks() for c in blocks.column_names}
        # chunks and queries without an id match, but are no answers
        flat = lambda c: self.columns[c].flatten()
        self.chunks, self._chunk = np.unique(flat("chunk_id").fill_null(int(_NONE)).to_numpy(), return_inverse=True)
        self.queries, first, self._query = np.unique(asks.column("query_id").fill_null(int(_NONE)).to_numpy(), return_index=True, return_inverse=True)
        self._impact = flat("impact").to_numpy()
        self.asked = {c: asks.column(c).to_numpy() for c in asks.column_names if c in ("idf", "open", "least", "floor", "rest")}
        self.per_query = {c: self.asked[c][first] for c in ("floor", "rest") if c in self.asked}

    def _bounds(self, name: str) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.columns[name].value_lengths().to_numpy())])

    def scores(self, opened: bool = False, wanted: np.ndarray | None = None) -> np.ndarray:
        """Sums over the asked terms; with ``opened`` over the blocks that are not passed over, with ``wanted`` for these chunks only."""
        out = np.zeros((len(self.queries), len(self.chunks)))
        posted = self._bounds("chunk_id")
        top = self.columns["top"].to_numpy()
        for i in range(len(top)):
            at, impact = self._chunk[posted[i]:posted[i + 1]], self._impact[posted[i]:posted[i + 1]]
            if wanted is not None:
                at, impact = at[wanted[at]], impact[wanted[at]]
            span = slice(self._from[i], self._to[i])
            query, idf = self._query[span], self.asked["idf"][span]
            if opened:
                use = self.asked["open"][span] & (top[i] * idf >= self.asked["least"][span])
                query, idf = query[use], idf[use]
            if not len(at) or not len(query):
                continue
            if len(at) > 1 and len(once := np.unique(at)) < len(at):
                at, impact = once, np.bincount(np.searchsorted(once, at), impact)
            if len(np.unique(query)) == len(query):
                out[np.ix_(query, at)] += idf[:, None] * impact
            else:
                for q, weight in zip(query, idf):
                    out[q, at] += weight * impact
        return out

    def candidates(self) -> np.ndarray:
        """Which pairs can be among a query's first."""
        part = self.scores(opened=True)
        limit = {c: v[:, None] for c, v in self.per_query.items()}
        return (part > 0) & (part + limit["rest"] + 1e-6 >= limit["floor"]) & (self.queries != _NONE)[:, None]

    def first(self, score: np.ndarray, n: int) -> pa.Table:
        score[self.queries == _NONE] = -np.inf
        score[:, self.chunks == _NONE] = -np.inf
        rows, cols = first_per_row(score, n)
        return pa.table({"query_id": pa.array(self.queries[rows]), "chunk_id": pa.array(self.chunks[cols]), "score": pa.array(score[rows, cols])})


def _in_shards(index: Postings, asks: DataFrame, work, schema: str) -> DataFrame:
    """``work`` of every ``Shard`` and some of the queries of ``asks`` (query_id, term, idf, ...)."""
    def found(turn: Column) -> DataFrame:
        some = asks.filter(turn)
        shared = asks.sparkSession.sparkContext.broadcast(some.toArrow())

        def of_shard(blocks: pa.Table) -> pa.Table:
            ids = shared.value.column("query_id")
            each = pc.unique(ids)
            slices = [each[i:i + ASKING] for i in range(0, len(each), ASKING)]
            held = (Shard(blocks, shared.value.filter(pc.is_in(ids, value_set=s))) for s in slices)
            # every block is of an asked term, so some queries have one here
            return pa.concat_tables([work(shard) for shard in held if len(shard.queries)])
        # a task for a shard
        met = _of_asked(index, some).select("shard", "term", "level", "top", F.col("postings.chunk_id").alias("chunk_id"), F.col("postings.impact").alias("impact"))
        return met.repartition(index.shards, "shard").groupBy("shard").applyInArrow(of_shard, schema)
    return _united([written(found(turn), "found") for turn in _in_turns(asks)])


FOUND = "query_id long, chunk_id long, score double"


def limits(index: Postings, queries: DataFrame, n: int) -> DataFrame:
    """The asked terms with what decides which blocks and chunks are passed over."""
    asks = cut(_asks(index, queries))
    # a query has no more terms than its text has words
    rare = W.partitionBy("query_id").orderBy("df", "term").rowsBetween(W.unboundedPreceding, -1)
    seeds = asks.withColumn("before", F.coalesce(F.sum("df").over(rare), F.lit(0))).filter(F.col("before") < SEEDS * n).select("query_id", "term", "idf")

    def likeliest(shard: Shard) -> pa.Table:
        part = shard.scores()
        return shard.first(np.where(part > 0, part, -np.inf), SEEDS * n)
    partial = _in_shards(index, cut(seeds), likeliest, FOUND)
    likely = top_per_key(partial, ["query_id"], [F.col("score").desc(), F.col("chunk_id")], SEEDS * n).select("query_id", "chunk_id")
    kth = top_per_key(_scored(index, asks, likely), ["query_id"], [F.col("score").desc(), F.col("chunk_id")], n, rank="r").groupBy("query_id").agg(
        F.when(F.count("*") >= n, F.min("score") * (1 - 1e-9) - 1e-6).otherwise(0.0).alias("floor"))
    small = W.partitionBy("query_id").orderBy("bound", "term").rowsBetween(W.unboundedPreceding, 0)
    known = asks.join(kth, "query_id", "left").withColumn("floor", F.coalesce("floor", F.lit(0.0))).select(
        "*", F.sum("bound").over(small).alias("upto"), F.sum("bound").over(W.partitionBy("query_id")).alias("every"))
    closed = F.col("upto") < F.col("floor") * CLOSED
    rest = F.coalesce(F.max(F.when(closed, F.col("upto"))).over(W.partitionBy("query_id")), F.lit(0.0))
    # a chunk in a block that adds less than the least, whatever else it holds, is out of reach
    return cut(known.select("query_id", "term", "idf", (~closed).alias("open"), (F.col("floor") - (F.col("every") - F.col("bound"))).alias("least"), "floor", rest.alias("rest")))


def search(index: Postings, queries: DataFrame, n: int) -> DataFrame:
    """BM25 top-n: query_id, chunk_id, bm25, keyword_rank."""
    def best(shard: Shard) -> pa.Table:
        can = shard.candidates()
        score = np.round(shard.scores(wanted=can.any(axis=0)), 6)
        return shard.first(np.where(can, score, -np.inf), n)
    found = _in_shards(index, limits(index, queries, n), best, FOUND)
    scored = found.select("query_id", "chunk_id", fx.r6(F.col("score")).alias("bm25"))
    return top_per_key(scored, ["query_id"], [F.col("bm25").desc(), F.col("chunk_id")], n, rank="keyword_rank")


def cost(index: Postings, queries: DataFrame, n: int) -> DataFrame:
    """One row: (query, chunk) pairs that share a word, and those that were scored."""
    def counted(shard: Shard) -> pa.Table:
        return pa.table({"share": pa.array([int((shard.scores() > 0).sum())]), "scored": pa.array([int(shard.candidates().sum())])})
    found = _in_shards(index, limits(index, queries, n), counted, "share long, scored long")
    return found.agg(F.coalesce(F.sum("share"), F.lit(0)).alias("pairs_that_share"), F.coalesce(F.sum("scored"), F.lit(0)).alias("pairs_scored"))
