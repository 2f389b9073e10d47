"""Hard negatives by anchor-clustered shared lists.

Anchors are clustered by direction. Within a cluster of centre c and widest member angle r, the score of a row i and
an anchor u is at most |u| |i| cos(max(0, angle(i, c) - r)); rows are sorted by that bound
once for the cluster, and every member walks the list from its top until the bound certifies that nothing behind
can enter its answer. The list is dealt out: rows lie in cells around centres of their
own, a cell whose best bound is too small for all members of a bundle of clusters is
never sent to it, and the part of the list in one cell is sorted and walked in one task of
at most about ``CELL_ROWS`` rows and ``BUNDLE_ROWS`` anchors. Crowded cells and bundles are dealt to several tasks by a hash of the id.

First each anchor walks its own cell, which gives it a floor for its positives; then the
positives are found, and with their scores the windows of the negatives. Scores are exact integers.
Centres are fitted to about ``SAMPLE`` rows; they decide what is skipped, not what is found.

Defined results: rows with a null id or label, a null or empty vector, null or non-finite components, or a
component of ``LIMIT`` or more after scaling take no part. Of several rows with one id, the
smallest (label, vector) counts. Only vectors of equal length are compared. A positive
of a negative score has no negatives; a zero vector scores 0 with every row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from collections.abc import Iterator
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .codes import scaled
from .store import staged

SCALE = 256
CELL_ROWS, BUNDLE_ROWS, CLUSTER_ROWS = 8192, 4096, 64
# At most so many centres of cells and of clusters, for each length of vectors.
CENTRES = 1024
SAMPLE = 16384
LLOYD = 5
FIRST_CHUNK, CHUNK = 128, 2048


def _unit(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    norm = np.sqrt((v * v).sum(axis=1))
    return v / np.where(norm > 0, norm, 1)[:, None], norm


def centres(v: np.ndarray, n: int) -> np.ndarray:
    """At most ``n`` unit vectors that the rows of ``v`` gather around (spherical k-means)."""
    unit, norm = _unit(v[np.argsort(np.random.default_rng(7).random(len(v)))].astype(float))
    unit = unit[norm > 0]
    if not len(unit):
        return np.zeros((1, v.shape[1]))
    held = unit[:n]
    for _ in range(LLOYD):
        own = (unit @ held.T).argmax(axis=1)
        total = np.zeros_like(held)
        np.add.at(total, own, unit)
        moved, size = _unit(total)
        held = np.where(size[:, None] > 0, moved, held)
    return held


def angles(unit: np.ndarray, centre: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(unit @ centre.T, -1, 1))


def _placed(rows: DataFrame, cells: dict[int, np.ndarray], clusters: dict[int, np.ndarray]) -> DataFrame:
    """Every row with its norm, its cell and its cluster, and the angles to their centres."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                v = part.column("v").flatten().to_numpy().reshape(-1, dim)
                unit, norm = _unit(v.astype(float))
                out = {"id": part.column("id"), "label": part.column("label"), "asked": part.column("asked"), "dim": part.column("dim"),
                       "v": pa.array([r.tobytes() for r in np.ascontiguousarray(v, np.int32)], pa.binary()), "norm": pa.array(norm)}
                for name, held in (("cell", cells), ("cluster", clusters)):
                    turn = angles(unit, held[int(dim)])
                    own = turn.argmin(axis=1)
                    out |= {name: pa.array(own, pa.int32()), f"{name}_angle": pa.array(turn[np.arange(len(own)), own])}
                yield pa.record_batch(out)
    return rows.mapInArrow(work, "id long, label string, asked boolean, dim int, v binary, norm double, cell int, cell_angle double, cluster int, cluster_angle double")


class Side:
    """Rows of a task as arrays."""

    def __init__(self, table: pa.Table, dim: int) -> None:
        self.id, self.label = table.column("id").to_numpy(), np.array(table.column("label").to_pylist(), object)
        self.v = np.frombuffer(b"".join(table.column("v").to_pylist()), np.int32).reshape(-1, dim).astype(np.int64)
        self.norm = table.column("norm").to_numpy()


def _best(held: np.ndarray, fresh: np.ndarray) -> np.ndarray:
    """The largest values of both, as many as ``held`` has columns, in falling order."""
    both = np.concatenate([held, fresh], axis=1)
    k = held.shape[1]
    return -np.sort(np.partition(-both, k - 1, axis=1)[:, :k], axis=1)


def walk(rows: Side, asked: Side, cluster: np.ndarray, turn: np.ndarray, low: np.ndarray, high: np.ndarray, centre: np.ndarray,
         k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, window, row and score of the first ``k`` rows in every window [low, high] of every anchor.

    ``low`` and ``high`` have a row per anchor; ``same`` asks for rows of the anchor's label, else for the others.
    """
    unit, _ = _unit(rows.v.astype(float))
    top = np.abs(rows.v).max(initial=0).item() * np.abs(asked.v).max(initial=0).item() * rows.v.shape[1]
    kind = float if top < 1 << 53 else np.int64
    values, queries = rows.v.astype(kind), asked.v.astype(kind)
    labels = {x: i for i, x in enumerate(set(rows.label) | set(asked.label))}
    row_label, own_label = (np.array([labels[x] for x in s.label], np.int64) for s in (rows, asked))
    out: list[tuple] = []
    for c in np.unique(cluster):
        members = np.flatnonzero(cluster == c)
        # the shared list of the cluster
        bound = rows.norm * np.cos(np.maximum(0, angles(unit, centre[[c]])[:, 0] - turn[members].max()))
        order = np.argsort(-bound, kind="stable")
        bound = bound[order]
        best = np.full((len(members), low.shape[1], k), -np.inf)
        need = low[members].astype(float)
        at, size = 0, FIRST_CHUNK
        while at < len(order):
            reach = bound[at] * asked.norm[members] * (1 + 1e-9) + 1e-6
            live = np.flatnonzero(reach >= need.min(axis=1))
            if not len(live):
                break
            chunk = order[at:at + size]
            who = members[live]
            score = (queries[who] @ values[chunk].T).astype(np.int64)
            fits = (own_label[who][:, None] == row_label[chunk]) == same
            fits &= asked.id[who][:, None] != rows.id[chunk]
            for j in range(low.shape[1]):
                hit = fits & (score >= need[live, j][:, None]) & (score <= high[who, j][:, None])
                some = np.flatnonzero(hit.any(axis=1))
                if len(some):
                    best[live[some], j] = _best(best[live[some], j], np.where(hit[some], score[some], -np.inf))
                    need[live[some], j] = np.maximum(need[live[some], j], best[live[some], j, -1])
                    q, r = np.nonzero(hit)
                    out.append((who[q], np.full(len(q), j), chunk[r], score[q, r]))
            at, size = at + size, min(2 * size, CHUNK)
    if not out:
        return (np.zeros(0, np.int64),) * 4
    q, j, r, s = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((rows.id[r], -s, j, q))
    q, j, r, s = q[order], j[order], r[order], s[order]
    fresh = np.ones(len(q), bool)
    fresh[1:] = (q[1:] != q[:-1]) | (j[1:] != j[:-1])
    keep = np.arange(len(q)) - np.maximum.accumulate(np.where(fresh, np.arange(len(q)), 0)) < k
    return q[keep], j[keep], r[keep], s[keep]


FOUND = "anchor long, slot int, id long, score long"


def _padded(column: pa.ChunkedArray, fill: float) -> np.ndarray:
    rows = column.to_pylist()
    width = max(map(len, rows), default=1)
    return np.array([[*r, *[fill] * (width - len(r))] for r in rows], float).reshape(len(rows), -1)


def _walked(left: DataFrame, right: DataFrame, keys: list[str], clusters: dict[int, np.ndarray], k: int, same: bool) -> DataFrame:
    """The answers of all tasks: rows and anchors (with ``low`` and ``high``) that share ``keys``."""
    def work(rows: pa.Table, asked: pa.Table) -> pa.Table:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64())
        names = ["anchor", "slot", "id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in kinds], names)
        dim = asked.column("dim")[0].as_py()
        a, b = Side(rows, dim), Side(asked, dim)
        got = walk(a, b, asked.column("cluster").to_numpy(), asked.column("cluster_angle").to_numpy(), _padded(asked.column("low"), np.inf),
                   _padded(asked.column("high"), -np.inf), clusters[dim], k, same)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip((b.id[got[0]], got[1], a.id[got[2]], got[3]), kinds)], names)
    # new columns on both sides, which come from the same table
    left, right = (df.select(*[F.col(c).alias(c) for c in df.columns]) for df in (left, right))
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(work, FOUND)


def _first(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


class Mine:
    """Rows placed in cells, anchors in clusters, and the searches over them."""

    def __init__(self, vectors: DataFrame, is_anchor: Column, vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding", scale: int = SCALE) -> None:
        self.spark = vectors.sparkSession
        rows = scaled(vectors.filter(F.col(vec_id).isNotNull() & F.col(label).isNotNull()), embedding, scale).select(
            F.col(vec_id).cast("long").alias("id"), F.col(label).cast("string").alias("label"), F.coalesce(is_anchor, F.lit(False)).alias("asked"), F.col("_v").alias("v"))
        sizes = {r.dim: r for r in rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.sum(F.col("asked").cast("long")).alias("anchors")).collect()}
        some = lambda df, n: df.filter(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).select("v").toArrow().column("v").to_pylist()
        held = [some(df, sum(getattr(r, c) for r in sizes.values())) for df, c in ((rows, "n"), (rows.filter("asked"), "anchors"))]

        def fitted(sample: list, column: str, per: int) -> dict[int, np.ndarray]:
            out = {}
            for dim, r in sizes.items():
                v = np.array([x for x in sample if len(x) == dim], np.int64).reshape(-1, dim)
                out[dim] = centres(v, min(CENTRES, -(-getattr(r, column) // per) or 1))
            return out
        self.cells, self.clusters = fitted(held[0], "n", CELL_ROWS), fitted(held[1], "anchors", CLUSTER_ROWS)
        rows = rows.groupBy("id").agg(F.min(F.struct("label", "v")).alias("row"), F.max("asked").alias("asked"))
        rows = rows.select("id", "row.label", "asked", F.size("row.v").alias("dim"), "row.v")
        self.rows = staged(_placed(rows, self.cells, self.clusters), "placed")
        self.anchors = self.rows.filter("asked")
        self.stats = {(r.dim, r.cell): r for r in self.rows.groupBy("dim", "cell").agg(
            F.count("*").alias("n"), F.max("cell_angle").alias("wide"), F.max("norm").alias("norm")).collect()}

    def floors(self, k: int) -> DataFrame:
        """Anchors with ``low``, the k-th best score of their own label in their own cell, and no upper limit."""
        parts = self.spark.createDataFrame([(d, c, -(-r.n // CELL_ROWS)) for (d, c), r in self.stats.items()], "dim int, cell int, parts int")
        # at most CENTRES rows per length of vectors
        dealt = lambda df: df.join(F.broadcast(parts), ["dim", "cell"]).withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
        asked = dealt(self.anchors).withColumns({"low": F.array(F.lit(float("-inf"))), "high": F.array(F.lit(float("inf")))})
        found = _walked(dealt(self.rows), asked, ["dim", "cell", "part"], self.clusters, k, True)
        kth = found.groupBy("anchor").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
        low = F.when(F.col("n") >= k, F.col("kth").cast("double")).otherwise(F.lit(float("-inf")))
        return self.anchors.join(kth, self.anchors["id"] == kth["anchor"], "left").select(
            self.anchors["*"], F.array(F.coalesce(low, F.lit(float("-inf")))).alias("low"), F.array(F.lit(float("inf"))).alias("high"))

    def search(self, asked: DataFrame, k: int, same: bool) -> DataFrame:
        """The first ``k`` rows in every window of the anchors ``asked``; cells beyond every member's reach are left out."""
        least = F.array_min("low")
        need = asked.groupBy("dim", "cluster").agg(F.count("*").alias("n"), F.max("cluster_angle").alias("wide"), F.min(
            F.when(F.col("norm") > 0, least / F.col("norm")).when(least <= 0, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))).alias("need")).collect()
        bundles, pairs = [], []
        for dim in {r.dim for r in need}:
            mine = sorted((r for r in need if r.dim == dim), key=lambda r: r.cluster)
            cells = [(c, r) for (d, c), r in self.stats.items() if d == dim]
            turn = angles(self.clusters[dim], self.cells[dim][[c for c, _ in cells]])
            wide, norm = (np.array([getattr(r, f) for _, r in cells], float) for f in ("wide", "norm"))
            wanted, size, number = np.zeros(len(cells), bool), 0, 0
            for i, r in enumerate(mine):
                reach = norm * np.maximum(0, np.cos(np.maximum(0, turn[r.cluster] - r.wide - wide)))
                wanted |= reach * (1 + 1e-9) + 1e-6 >= r.need
                bundles.append((dim, r.cluster, number))
                size += r.n
                if size >= BUNDLE_ROWS or i + 1 == len(mine):
                    pairs += [(dim, number, -(-size // BUNDLE_ROWS), c, -(-s.n // CELL_ROWS)) for (c, s), w in zip(cells, wanted) if w]
                    wanted, size, number = np.zeros(len(cells), bool), 0, number + 1
        # at most CENTRES * CENTRES pairs of a bundle and a cell per length of vectors, whatever the table's size
        pairs = F.broadcast(self.spark.createDataFrame(pairs, "dim int, bundle int, pieces int, cell int, parts int"))
        bundles = F.broadcast(self.spark.createDataFrame(bundles, "dim int, cluster int, bundle int"))
        every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
        own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
        left = self.rows.join(pairs, ["dim", "cell"]).select("id", "label", "v", "norm", "dim", "bundle", "cell", own("parts").alias("part"), every("pieces").alias("piece"))
        right = asked.join(bundles, ["dim", "cluster"]).drop("cell").join(pairs, ["dim", "bundle"]).select(
            "id", "label", "v", "norm", "dim", "cluster", "cluster_angle", "low", "high", "bundle", "cell", every("parts").alias("part"), own("pieces").alias("piece"))
        return _first(_walked(left, right, ["dim", "bundle", "piece", "cell", "part"], self.clusters, k, same), k)


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, low: int = 80, high: int = 100,
                   vec_id: str = "vec_id", label: str = "label", embedding: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Positives of an anchor are its ``positives`` best rows of the same label; the negatives of a pair are
    the first rows of other labels that score from ``low`` to ``high`` percent of the positive.
    """
    mine = Mine(vectors, is_anchor, vec_id, label, embedding)
    best = staged(mine.search(staged(mine.floors(positives), "floors"), positives, True), "positives")
    limit = lambda percent, up: (F.ceil if up else F.floor)(F.col("score") * percent / F.lit(100).cast("decimal(3,0)"))
    windows = best.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"),
                          limit(low, True).cast("double").alias("from"), limit(high, False).cast("double").alias("to"))
    # at most ``positives`` windows an anchor; one that is empty stays, so that slots are ranks
    per = windows.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("slot", "from", "to"))).alias("w"))
    asked = mine.anchors.join(per.filter(F.exists("w", lambda x: x["from"] <= x["to"])), mine.anchors["id"] == per["anchor"]).select(
        mine.anchors["*"], F.transform("w", lambda x: F.when(x["from"] <= x["to"], x["from"]).otherwise(F.lit(float("inf")))).alias("low"),
        F.col("w.to").alias("high"))
    found = mine.search(staged(asked, "windows"), negatives, False)
    return found.join(windows, ["anchor", "slot"]).select(
        F.col("anchor").alias("anchor_id"), "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
  list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
p AS (SELECT a, b, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) <= 5)
SELECT p.a AS anchor_id, p.b AS positive_id, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.b)::INTEGER AS rank,
  s.b AS negative_id, p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.score <= 100 * s.score AND 100 * s.score <= 100 * p.score
QUALIFY rank <= 5
"""
