"""Approximate nearest neighbours by collision-counting hashing.

Vectors are dealt into blocks. A block keeps, for each of ``PROJECTIONS`` random
directions, its vectors sorted by their projection. A query opens a window around its
own projection in every sorted array; the windows widen together with the search
radius (virtual rehashing), and each vector counts the windows it has been in. Vectors
that reach the collision threshold are verified with their exact cosine; the search
ends when the k-th best verified vector lies within the radius, or the windows cover
all. A vector at the radius is missed with the probability of ``SLACK`` standard
deviations. Blocks answer separately and the best k of all blocks are the result, so
every vector is indexed and no task holds more than a block and a group of queries.

Defined results: vectors that are null, zero, or hold null or non-finite components
take no part, nor do rows with a null id; only vectors of equal length are compared;
rows that share an id appear once, with the best score, and count once towards ``k``; of several query rows with one
id the smallest vector asks; ties go to the smaller id.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

PROJECTIONS = 80
BLOCK = 16384
QUERY_BLOCK = 512
# Half a window as a multiple of the radius, the radii, and the slack under the expected collisions.
WINDOW = 1.0
RADII = [0.3 * 1.2 ** i for i in range(11)]
SLACK = 2.0
OUT = "query_id long, vec_id long, score double"


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((PROJECTIONS, dim))


def _threshold() -> int:
    p = math.erf(WINDOW / math.sqrt(2))
    return max(1, math.floor(PROJECTIONS * p - SLACK * math.sqrt(PROJECTIONS * p * (1 - p))))


def _matrix(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids, vectors scaled by their largest component, and unit vectors."""
    column = table.column("v").combine_chunks()
    ids = table.column("id").to_numpy()
    v = column.flatten().to_numpy().astype(float).reshape(len(ids), -1)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return ids, v, v / np.sqrt((v * v).sum(axis=1, keepdims=True))


class Index:
    """Sorted projections of one block."""

    def __init__(self, ids: np.ndarray, v: np.ndarray, unit: np.ndarray) -> None:
        self.ids, self.v, self.unit = ids, v, unit
        names, self.name = np.unique(ids, return_inverse=True)
        self.repeats = len(names) < len(ids)
        self.norm = np.sqrt((v * v).sum(axis=1))
        self.axes = directions(v.shape[1])
        at = (unit @ self.axes.T).T
        order = np.argsort(at, axis=1)
        self.sorted = np.take_along_axis(at, order, 1)
        self.order = np.ascontiguousarray(order.astype(np.int32)).ravel()

    def _distinct(self, rows: np.ndarray) -> int:
        return len(np.unique(self.name[rows])) if self.repeats else len(rows)

    def _first(self, rows: np.ndarray) -> np.ndarray:
        """The first row of every id, in the order of ``rows``."""
        return rows[np.sort(np.unique(self.name[rows], return_index=True)[1])] if self.repeats else rows

    def search(self, ids: np.ndarray, v: np.ndarray, unit: np.ndarray, k: int) -> tuple[list, list, list]:
        n, floor = len(self.ids), _threshold()
        spots = unit @ self.axes.T
        reach = WINDOW * np.array(RADII)
        low = np.stack([np.searchsorted(s, spots[:, [j]] - reach) for j, s in enumerate(self.sorted)], 2)
        high = np.stack([np.searchsorted(s, spots[:, [j]] + reach, "right") for j, s in enumerate(self.sorted)], 2)
        rows = np.arange(PROJECTIONS) * n
        low, high = low + rows, high + rows
        out: tuple[list, list, list] = ([], [], [])
        for q in range(len(ids)):
            hits, near = np.zeros(n, np.int64), np.full(n, -2.0)
            own = self.ids == ids[q]
            a = b = None
            for r, radius in enumerate(RADII):
                x, y = low[q, r], high[q, r]
                parts = zip(x, y) if a is None else [*zip(x, a), *zip(b, y)]
                new = np.concatenate([self.order[s:e] for s, e in parts])
                hits += np.bincount(new, minlength=n)
                a, b = x, y
                fresh = np.flatnonzero((hits >= floor) & (near < -1.5) & ~own)
                near[fresh] = self.unit[fresh] @ unit[q]
                if self._distinct(np.flatnonzero(near >= 1 - radius * radius / 2)) >= k:
                    break
            else:
                # the windows cover all vectors of the block
                rest = np.flatnonzero((near < -1.5) & ~own)
                near[rest] = self.unit[rest] @ unit[q]
            found = np.flatnonzero(near > -1.5)
            if len(found) > k:
                heads = self._first(found[np.argsort(-near[found])]) if self.repeats else found
                if len(heads) > k:
                    found = found[near[found] >= np.partition(near[heads], -k)[-k] - 1e-9]
            score = (self.v[found] * v[q]).sum(axis=1) / (self.norm[found] * np.sqrt((v[q] * v[q]).sum()))
            ranked = np.lexsort((self.ids[found], -score))
            if self.repeats:
                ranked = ranked[np.sort(np.unique(self.name[found][ranked], return_index=True)[1])]
            best = ranked[:k]
            out[0].extend([ids[q]] * len(best))
            out[1].extend(self.ids[found][best])
            out[2].extend(score[best])
        return out


def _valid(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    v = F.col(embedding)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.filter(F.col(vec_id).isNotNull() & v.isNotNull() & good & F.exists(v, lambda x: x != 0))
    return rows.select(F.col(vec_id).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def nearest(vectors: DataFrame, is_query: Column, k: int = 5, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id and score of the ``k`` nearest found for every row where ``is_query`` holds."""
    asked = _valid(vectors.filter(is_query), vec_id, embedding).groupBy("id", "dim").agg(F.min("v").alias("v"))
    rows = _valid(vectors, vec_id, embedding)
    sizes = {r.dim: (r.n, r.q) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.lit(0).alias("q")).collect()}
    for r in asked.groupBy("dim").agg(F.count("*").alias("q")).collect():
        sizes[r.dim] = (sizes[r.dim][0], r.q)
    shapes = [(d, math.ceil(n / BLOCK), math.ceil(q / QUERY_BLOCK)) for d, (n, q) in sizes.items() if q]
    shape = vectors.sparkSession.createDataFrame(shapes, "dim int, blocks int, groups int")
    # equal rows are one candidate; a row per vector length: few, and each is one number
    rows = rows.distinct().join(F.broadcast(shape), "dim")
    rows = rows.select("id", "v", "dim", F.pmod(F.xxhash64("id", "v"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("groups") - 1)).alias("part"))
    asked = asked.join(F.broadcast(shape), "dim").select(
        "id", "v", "dim", F.pmod(F.xxhash64("id"), "groups").cast("int").alias("part"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))

    def work(block: pa.Table, group: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        kinds = (pa.int64(), pa.int64(), pa.float64())
        found = Index(*_matrix(block)).search(*_matrix(group), k) if block.num_rows and group.num_rows else ([], [], [])
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(found, kinds)], names)
    keys = ["dim", "block", "part"]
    found = rows.groupBy(*keys).cogroup(asked.groupBy(*keys)).applyInArrow(work, OUT)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
