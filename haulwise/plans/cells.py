"""Vector search in coarse cells, below quadratic where vectors gather.

Unit vectors are dealt to the nearest of a bounded number of trained centres and written as a table
partitioned by cell. A query's similarity to a vector in a cell is at most the cosine of the
angle to the cell's centre less the cell's radius. The certified search opens the nearest
cells first, which gives each query a similarity that its k-th neighbour reaches at least, and then only
the cells whose bound reaches it: the answer is exact. The approximate search opens a fixed number of
cells; ``probes_for`` finds the number that reaches a recall on a bounded sample of queries.
Neighbouring cells are gathered into tiles of bounded size, and tiles into pieces that are sent to all tasks one after
the other (``tiles.in_pieces``): queries stay in their tasks and are compared with the tiles that hold a cell they
open. A cell with a third of all vectors is many tiles.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.functions import pandas_udf

from ..session import cut, scratch_path
from . import tiles
from .tiles import SLICE, TILE_ROWS, best
from .windows import top_per_key

# Vectors of a cell on average, most cells there can be, and vectors the centres are trained on.
CELL_ROWS = 32
MAX_CELLS = 1024
SAMPLE = 16384
# Queries whose exact neighbours decide the number of probes.
TRIALS = 256
# Cells that the certified search opens first.
FIRST = 4
EPSILON = 2e-6


class Cells(NamedTuple):
    """``rows`` (cell, item_id, vec), the centres, and per cell its number of rows and radius."""

    rows: DataFrame
    centres: np.ndarray
    size: np.ndarray
    radius: np.ndarray


def _angles(vectors: pd.Series, centres: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(np.stack(vectors.to_numpy()) @ centres.T, -1, 1)) if len(vectors) else np.zeros((0, len(centres)))


def _sampled(vectors: DataFrame, n: int, rows: int) -> DataFrame:
    """About ``n`` of ``rows`` rows, by a hash of the id."""
    return vectors.filter(F.pmod(F.xxhash64("item_id", F.lit(5)), F.lit(max(1, rows // n))) == 0)


def build(vectors: DataFrame, cells: int | None = None, write=None) -> Cells:
    """The index of unit vectors (item_id, vec), written by cell."""
    rows = vectors.count()
    if not rows:
        return Cells(vectors.select(F.lit(0).alias("cell"), "item_id", "vec"), np.zeros((0, 0)), np.zeros(0, int), np.zeros(0))
    n = cells or int(min(MAX_CELLS, max(1, rows // CELL_ROWS)))
    train = _sampled(vectors, SAMPLE, rows).select(array_to_vector("vec").alias("features")).cache()
    if n > 1 and train.count() > n:
        fitted = KMeans(k=n, distanceMeasure="cosine", initMode="random", maxIter=4, seed=3).fit(train)
        centres = np.array(fitted.clusterCenters())
    else:
        centres = np.array([r.features.toArray() for r in train.limit(n).collect()]) if train.count() else np.ones((1, len(vectors.first().vec)))
    train.unpersist()
    length = np.linalg.norm(centres, axis=1, keepdims=True)
    centres = centres / np.where(length > 0, length, 1)

    @pandas_udf("struct<cell: int, angle: double>")
    def nearest(vec: pd.Series) -> pd.DataFrame:
        own, angle = np.zeros(len(vec), np.int32), np.zeros(len(vec))
        for i in range(0, len(vec), SLICE):
            turn = _angles(vec[i:i + SLICE], centres)
            own[i:i + SLICE], angle[i:i + SLICE] = turn.argmin(axis=1), turn.min(axis=1)
        return pd.DataFrame({"cell": own, "angle": angle})
    placed = vectors.withColumn("_at", nearest("vec")).select(F.col("_at.cell").alias("cell"), F.col("_at.angle").alias("angle"), "item_id", "vec")
    if write is None:
        spark, path = vectors.sparkSession, scratch_path(vectors.sparkSession, "cells")
        placed.repartition("cell").write.partitionBy("cell").parquet(path)
        held = spark.read.parquet(path).select("cell", "angle", "item_id", "vec")
    else:
        held = write(placed)
    # at most MAX_CELLS rows
    stats = held.groupBy("cell").agg(F.count("*").alias("n"), F.max("angle").alias("radius")).collect()
    size, radius = np.zeros(len(centres), int), np.zeros(len(centres))
    for r in stats:
        size[r.cell], radius[r.cell] = r.n, r.radius
    return Cells(held.select("cell", "item_id", "vec"), centres, size, radius)


# Which of the cells ``some`` queries open, from their angles to the centres and the similarities they must reach.
Opens = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _places(turn: np.ndarray) -> np.ndarray:
    """Place of every cell for every query, nearest centre first: a wide cell has a large bound without holding the nearest vectors."""
    order = np.argsort(turn, axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None, :], axis=1)
    return place


def _nearest_cells(n: int) -> Opens:
    return lambda turn, floor: _places(turn) < n


def _reached(radius: np.ndarray) -> Opens:
    """Cells after the first that can hold a vector of the similarity to be reached; all, where none is known."""
    def opens(turn: np.ndarray, floor: np.ndarray) -> np.ndarray:
        reach = np.isnan(floor)[:, None] | (np.cos(np.maximum(0, turn - radius)) + EPSILON >= floor[:, None])
        return (_places(turn) >= FIRST) & reach
    return opens


def _tiles_of(counts: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """First tile and number of tiles of every cell: small cells in a row share a tile, a large one has several."""
    first, parts, tile, held = np.zeros(len(counts), int), np.ones(len(counts), int), 0, 0
    for i, n in enumerate(counts):
        if held and held + n > rows:
            tile, held = tile + 1, 0
        first[i], parts[i] = tile, max(1, -(-int(n) // rows))
        held += n
        if parts[i] > 1:
            tile, held = tile + parts[i], 0
    return first, parts


def _chain(centres: np.ndarray) -> np.ndarray:
    """The centres in an order in which neighbours are near."""
    left, order = np.ones(len(centres), bool), [0]
    for _ in range(len(centres) - 1):
        left[order[-1]] = False
        order.append(int(np.argmax(np.where(left, centres @ centres[order[-1]], -np.inf))))
    return np.array(order)


def _opened(index: Cells, asked: DataFrame, k: int, exclude_self: bool, opens: Callable[[np.ndarray], Opens], tile_rows: int | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank) of ``asked`` (query_id, vec, floor) among the cells each query opens."""
    tile_rows = tile_rows or TILE_ROWS
    some = np.flatnonzero(index.size)
    if not len(some):
        return asked.select("query_id", F.col("query_id").alias("item_id"), F.lit(0.0).alias("similarity"), F.lit(0).alias("rank")).limit(0)
    some = some[_chain(index.centres[some])]
    centres, wanted = index.centres[some], opens(index.radius[some])
    at = np.full(len(index.centres), -1)
    at[some] = np.arange(len(some))

    def opened(vec: pd.Series, floor: pd.Series) -> tuple[np.ndarray, np.ndarray]:
        turn = _angles(vec, centres)
        return turn, wanted(turn, floor.to_numpy(float))

    # at most MAX_CELLS cells
    first, parts = _tiles_of(index.size[some], tile_rows)
    numbers = asked.sparkSession.createDataFrame([(int(c), int(i), int(first[i]), int(parts[i])) for i, c in enumerate(some)], "in_cell int, place int, first int, parts int")
    tile = (F.col("first") + F.pmod(F.xxhash64("item_id"), F.col("parts"))).cast("int")
    items = index.rows.join(F.broadcast(numbers), F.col("cell") == F.col("in_cell")).select("cell", "item_id", "vec", "place", tile.alias("tile"))
    total, each = int((first + parts).max()), max(1, tiles.PIECE_ROWS // tile_rows)

    def held(piece: int) -> list:
        """Ids, vectors and places of the tiles of a piece."""
        low, high = piece * each, (piece + 1) * each
        inside = [int(c) for c, f, n in zip(some, first, parts) if f < high and f + n > low]
        rows = items.filter(F.col("cell").isin(inside) & (F.col("tile") >= low) & (F.col("tile") < high)).select("item_id", "vec", "place", "tile").toArrow().to_pandas()
        return [(df["item_id"].to_numpy(), np.stack(df["vec"].to_numpy()), df["place"].to_numpy()) for _, df in rows.sort_values(["tile", "item_id"]).groupby("tile")]

    def compared(df: pd.DataFrame, piece: list) -> Iterator[pd.DataFrame]:
        open_, qids, vec = opened(df["vec"], df["floor"])[1], df["query_id"].to_numpy(), np.stack(df["vec"].to_numpy())
        for ids, vectors, place in piece:
            hit = open_[:, np.unique(place)].any(axis=1)
            if hit.any():
                yield best(qids[hit], vec[hit], ids, vectors, k, exclude_self, open_[hit][:, place])
    q = asked.select("query_id", "vec", F.col("floor").cast("double").alias("floor"))
    found = tiles.in_pieces(q, -(-total // each), held, compared)
    return top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("item_id")], k, rank="rank")


def search(index: Cells, queries: DataFrame, k: int, exclude_self: bool = False, probes: int | None = None) -> DataFrame:
    """(query_id, item_id, similarity, rank) of unit vectors ``queries`` (query_id, vec).

    Exact without ``probes``, else among the vectors of the ``probes`` nearest cells.
    """
    unknown = queries.select("query_id", "vec", F.lit(None).cast("double").alias("floor"))
    if probes:
        return _opened(index, unknown, k, exclude_self, lambda radius: _nearest_cells(probes))
    # at most k rows of a query
    first = cut(_opened(index, unknown, k, exclude_self, lambda radius: _nearest_cells(FIRST)).drop("rank"))
    floor = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("similarity")).alias("floor"))
    rest = queries.select("query_id", "vec").join(floor, "query_id", "left")
    found = first.unionByName(_opened(index, rest, k, exclude_self, _reached).drop("rank"))
    return top_per_key(found, ["query_id"], [F.col("similarity").desc(), F.col("item_id")], k, rank="rank")


def probes_for(index: Cells, k: int, recall: float) -> int:
    """Cells to open so that a sample of the indexed vectors finds ``recall`` of its ``k`` nearest others."""
    trial = cut(_sampled(index.rows, TRIALS, int(index.size.sum())).select(F.col("item_id").alias("query_id"), "vec"))
    exact = search(index, trial, k, exclude_self=True)
    own = index.rows.select("item_id", "cell")
    # the cell of each true neighbour: as many rows as a sample has neighbours
    rows = exact.join(own, "item_id").join(trial, "query_id").select("vec", "cell").toPandas()
    some = np.flatnonzero(index.size)
    at = np.searchsorted(some, rows["cell"].to_numpy(int))
    found = np.sort(np.concatenate([np.zeros(0, int), *(_places(_angles(rows["vec"][i:i + SLICE], index.centres[some]))[np.arange(len(at[i:i + SLICE])), at[i:i + SLICE]]
                                                     for i in range(0, len(rows), SLICE))]))
    return int(found[min(len(found) - 1, int(np.ceil(recall * len(found))))]) + 1 if len(found) else 1


def cost(index: Cells, queries: DataFrame, probes: int) -> DataFrame:
    """One row: cells, probes, pairs of a query and a vector, and those that are compared."""
    some = np.flatnonzero(index.size)
    centres, size = index.centres[some], index.size[some]

    @pandas_udf("long")
    def met(vec: pd.Series) -> pd.Series:
        parts = ((_places(_angles(vec[i:i + SLICE], centres)) < probes) @ size for i in range(0, len(vec), SLICE))
        return pd.Series(np.concatenate([np.zeros(0, np.int64), *parts]))
    pairs = int(index.size.sum())
    return queries.select("query_id", met("vec").alias("n")).agg(F.sum("n").alias("pairs_compared"), (F.count_distinct("query_id") * pairs).alias("pairs")).select(
        F.lit(len(index.centres)).alias("cells"), F.lit(probes).alias("probes"), "pairs", "pairs_compared",
        F.round(F.col("pairs_compared") / F.col("pairs"), 6).alias("share"))
