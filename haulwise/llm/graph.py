"""Connected components: trees grown inside tasks, joined by alternating large-star and small-star steps."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import staged


# Edges that a task joins.
TASK_EDGES = 200_000


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of a task's edges points to the smallest node that these edges connect it with."""
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x
    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
            low, high = sorted((top(x), top(y)))
            parent[high] = low
    moved = [x for x in parent if top(x) != x]
    yield pa.record_batch([pa.array([top(x) for x in moved], pa.int64()), pa.array(moved, pa.int64())], ["a", "b"])


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node points to the smallest node around it."""
    both = edges.select("a", "b").union(edges.select("b", "a")).toDF("u", "v")
    low = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    return both.join(low, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the smallest of these."""
    low = edges.groupBy("b").agg(F.min("a").alias("m"))
    moved = edges.join(low, "b").filter("a > m").select(F.col("m").alias("a"), F.col("a").alias("b"))
    return moved.union(low.select(F.col("m").alias("a"), "b"))


def linked(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for the nodes of ``edges`` (a < b) that are not the root, as a written table.

    A round first joins the edges of every task, then takes a step between tasks; what fits one task
    needs no step. Each round is a written table; the loop ends when a round changes nothing, which is
    read from a count and a checksum of the edges.
    """
    edges = staged(edges.select("a", "b"), "edges")
    state = None
    while True:
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        tasks = -(-now[0] // TASK_EDGES)
        if tasks <= 1:
            edges = staged(edges.coalesce(1).mapInArrow(_joined, "a long, b long"), "edges") if tasks else edges
        if now == state or tasks <= 1:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root"))
        state = now
        edges = staged(edges.repartition(tasks).mapInArrow(_joined, "a long, b long"), "edges")
        edges = staged(_small_star(_large_star(edges.distinct()).distinct()).distinct(), "edges")


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` for all nodes of ``edges`` (a < b), the roots included."""
    moved = linked(edges)
    return moved.union(moved.select("root", "root")).distinct()
