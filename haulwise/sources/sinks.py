"""Append-only writes: scores, warnings, graph snapshots, evaluation metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def append_scores(df: DataFrame, path: str, ts: str = "scored_at") -> None:
    """Append score rows, partitioned by day for pruning; never updates."""
    dated = df.withColumn("scored_date", F.to_date(ts))
    dated.repartition("scored_date", F.pmod(F.xxhash64(*df.columns), F.lit(8))).write.mode(
        "append").partitionBy("scored_date").parquet(path)


def write_warnings(df: DataFrame, path: str) -> None:
    """Quality warnings as JSON lines."""
    df.write.mode("append").json(path)


def write_graph_snapshot(nodes: DataFrame, edges: DataFrame, path: str, snapshot_id: str) -> None:
    """Persist one graph version; writing the same id again replaces only its partitions."""
    def put(df: DataFrame, part: str, kind: str) -> None:
        (df.withColumn("snapshot_id", F.lit(snapshot_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id", kind).parquet(f"{path}/{part}"))
    put(nodes, "nodes", "node_type")
    put(edges, "edges", "edge_type")


def read_graph_snapshot(spark: SparkSession, path: str, snapshot_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of one snapshot; the id filter prunes partitions."""
    pick = lambda part: (spark.read.parquet(f"{path}/{part}")
                         .filter(F.col("snapshot_id") == snapshot_id).drop("snapshot_id"))
    return pick("nodes"), pick("edges")


METRIC_KEY = ["model_version", "metric_name", "dataset_split"]


def new_eval_metrics(metrics: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Metric rows not recorded yet, one per (version, metric, split)."""
    fresh = metrics.groupBy(*METRIC_KEY).agg(F.max("metric_value").alias("metric_value"))
    return fresh if existing is None else fresh.join(existing, METRIC_KEY, "left_anti")


def write_eval_metrics(metrics: DataFrame, path: str, existing: DataFrame | None = None) -> None:
    new_eval_metrics(metrics, existing).write.mode("append").parquet(path)
