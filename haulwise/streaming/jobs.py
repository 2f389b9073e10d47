"""Incremental jobs on Structured Streaming.

Event-time columns of the sources carry no zone and are cast before a watermark.
Sinks inside ``foreachBatch`` write one folder per batch id in overwrite mode, so
a replayed batch replaces its own output and nothing else.

Operators that need the order of an entity's events (crossings, lockouts) keep
their small state per entity in a table per batch and run the batch operator on
each micro-batch. A grouped state function would hand all of a hot entity's rows
of a batch to one task.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators import alerts as al, evidence as ev
from ..plans.windows import latest_per_key
from ..session import scratch_path
from ..sources.tables import SCHEMAS

BATCH = "batch_id"


def stream_source(spark: SparkSession, path: str, table: str, max_files: int | None = None) -> DataFrame:
    """File stream over a folder (or file) of one source table."""
    reader = spark.readStream.schema(SCHEMAS[table])
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def with_event_time(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)


def run_to_files(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what is available into an exactly-once file sink."""
    (df.writeStream.format("parquet").outputMode(mode).option("path", path)
     .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_batches(df: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> None:
    (df.writeStream.foreachBatch(handle).outputMode(mode).option("checkpointLocation", checkpoint)
     .trigger(availableNow=True).start().awaitTermination())


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")


def read_output(spark: SparkSession, path: str) -> DataFrame:
    """All batches of a ``foreachBatch`` job."""
    return spark.read.parquet(path)


def _before(spark: SparkSession, path: str, batch_id: int) -> DataFrame | None:
    """State written by the previous batch."""
    return spark.read.parquet(f"{path}/{BATCH}={batch_id - 1}") if batch_id > 0 else None


# -- stateless and natively stateful jobs ----------------------------------------------------------

def stream_changes(stream: DataFrame, table: str, key: str) -> DataFrame:
    """Arriving rows as (table_name, row_id, operation)."""
    return stream.select(F.lit(table).alias("table_name"), F.col(key).cast("bigint").alias("row_id"),
                         F.lit("insert").alias("operation"))


def stream_alerts(scores: DataFrame, thr: DataFrame) -> DataFrame:
    """Threshold breaches of arriving scores (stream-static join)."""
    return al.evaluate_thresholds(scores, thr)


def stream_dedup_alerts(alerts: DataFrame, ts: str, delay: str) -> DataFrame:
    """Exactly one alert per score and threshold among repeats within the delay."""
    return with_event_time(alerts, ts, delay).dropDuplicatesWithinWatermark(["score_id", "threshold_id"])


def tumbling_rates(events: DataFrame, who: str, ts: str, window: str, delay: str) -> DataFrame:
    """Events per user and tumbling window: in append mode when it closes, in update mode with every change."""
    return (with_event_time(events, ts, delay).groupBy(F.window(ts, window).alias("w"), who)
            .agg(F.count("*").alias("n"), F.max(ts).alias("newest"))
            .select(who, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "newest"))


def sliding_demand(events: DataFrame, key: str, value: str, ts: str, size: str, slide: str, delay: str) -> DataFrame:
    """Volume per key over a moving window."""
    return (with_event_time(events, ts, delay).groupBy(F.window(ts, size, slide).alias("w"), key)
            .agg(F.count("*").alias("n"), F.round(F.sum(value), 4).alias("volume"), F.max(ts).alias("newest"))
            .select(key, F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "volume", "newest"))


def sessions(events: DataFrame, who: str, ts: str, gap: str, delay: str) -> DataFrame:
    """Inactivity sessions per user."""
    return (with_event_time(events, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), who)
            .agg(F.count("*").alias("n")).select(who, F.col("w.start").alias("started_at"), F.col("w.end").alias("ended_at"), "n"))


# -- jobs with their own state tables -----------------------------------------------------------------

def stream_graph_upsert(edges: DataFrame, keys: list[str], version: str, path: str, checkpoint: str) -> None:
    """Append each batch's newest row per key; readers merge with ``current_rows``.

    Work per batch follows the size of the change, not of the graph.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        rest = [F.col(c) for c in batch.columns if c not in keys and c != version]
        _put(latest_per_key(batch, keys, [F.col(version).desc(), *rest]), path, batch_id)
    run_batches(edges, handle, checkpoint)


def current_rows(spark: SparkSession, path: str, keys: list[str], version: str) -> DataFrame:
    """Merge on read: the highest version per key over all batches."""
    rows = read_output(spark, path)
    return latest_per_key(rows, keys, [F.col(version).desc(), F.col(BATCH).desc()]).drop(BATCH)


def upsert_windows(windows: DataFrame, path: str, checkpoint: str) -> None:
    """Store the windows that a batch changed, open ones too; a later batch's row replaces an earlier one."""
    run_batches(windows, lambda batch, batch_id: _put(batch, path, batch_id), checkpoint, "update")


def current_windows(spark: SparkSession, path: str, keys: list[str], delay: str) -> DataFrame:
    """Newest state of every window; ``closed`` when no event in time can change it any more."""
    rows = read_output(spark, path)
    limit = rows.agg(F.max("newest").alias("t")).scalar() - F.expr(f"INTERVAL {delay}")
    return latest_per_key(rows, [*keys, "window_start"], [F.col(BATCH).desc()]).withColumn(
        "closed", F.col("window_end") <= limit).drop(BATCH, "newest")


def _with_history(batch: DataFrame, keys: list[str], path: str, batch_id: int) -> DataFrame:
    """The batch and all earlier rows of the keys that it touches.

    Only the batch itself and its keys are stored, so writing follows the change.
    """
    _put(batch, f"{path}/rows", batch_id)
    _put(batch.select(*keys).distinct(), f"{path}/touched", batch_id)
    stored = read_output(batch.sparkSession, f"{path}/rows").filter(F.col(BATCH) <= batch_id)
    touched = batch.sparkSession.read.parquet(f"{path}/touched/{BATCH}={batch_id}")
    return stored.drop(BATCH).join(touched, keys, "left_semi")


def current_result(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """Results as of now: those of the newest batch that touched their key, which correct all earlier ones."""
    newest = read_output(spark, f"{path}/touched").groupBy(*keys).agg(F.max(BATCH).alias(BATCH))
    return read_output(spark, f"{path}/out").join(newest, [*keys, BATCH]).drop(BATCH)


def stateful_crossings(scores: DataFrame, thr: DataFrame, path: str, checkpoint: str) -> None:
    """Upward crossings of the entities that a batch touches, from their whole history; read with ``current_result``.

    A late score can make a later one no crossing, or one at all, so the entity's
    crossings are found anew and replace the earlier ones.
    """
    def handle(batch: DataFrame, batch_id: int) -> None:
        rows = _with_history(batch, ["entity_type", "entity_id"], path, batch_id)
        _put(al.threshold_crossings(rows, thr), f"{path}/out", batch_id)
    run_batches(scores, handle, checkpoint)


def stream_lockouts(audit: DataFrame, n: int, path: str, checkpoint: str) -> None:
    """Lockouts of the actors that a batch touches, from their whole history; read with ``current_result``."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        _put(al.lockouts(_with_history(batch, ["actor_id"], path, batch_id), n), f"{path}/out", batch_id)
    run_batches(audit, handle, checkpoint)


def late_rows(events: DataFrame, ts: str, delay: str, path: str, checkpoint: str) -> None:
    """Rows older than the newest event of earlier batches minus ``delay`` go to quarantine."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = _before(spark, f"{path}/state", batch_id)
        newest = batch.agg(F.max(ts).alias("newest"))
        if last is None:
            tagged = batch.withColumn("is_late", F.lit(False))
        else:
            limit = last.agg(F.max("newest").alias("n")).scalar() - F.expr(f"INTERVAL {delay}")
            tagged = batch.withColumn("is_late", F.coalesce(F.col(ts) < limit, F.lit(False)))
            newest = newest.unionByName(last).agg(F.max("newest").alias("newest"))
        _put(tagged.filter(~F.col("is_late")).drop("is_late"), f"{path}/accepted", batch_id)
        _put(tagged.filter("is_late").drop("is_late"), f"{path}/quarantine", batch_id)
        _put(newest, f"{path}/state", batch_id)
    run_batches(events, handle, checkpoint)


def stream_index(docs: DataFrame, path: str, checkpoint: str, size: int, overlap: int) -> None:
    """New or changed documents become searchable chunks; the index is only added to."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.select("doc_id", "text").withColumn("content_hash", ev.content_hash("text")).dropDuplicates(["doc_id", "content_hash"])
        if batch_id > 0:
            done = spark.read.parquet(f"{path}/docs").filter(F.col(BATCH) < batch_id)
            fresh = fresh.join(done.select("doc_id", "content_hash"), ["doc_id", "content_hash"], "left_anti")
        _put(fresh.select("doc_id", "content_hash"), f"{path}/docs", batch_id)
        _put(ev.chunk(fresh, "doc_id", "text", size, overlap), f"{path}/chunks", batch_id)
    run_batches(docs, handle, checkpoint)


def landing_runs(spark: SparkSession, table: DataFrame, name: str, drops: list, job: Callable[[DataFrame, str], None]) -> None:
    """Land ``table`` in several drops and run ``job`` after each on the same checkpoint.

    ``drops`` are conditions; each selects the rows of one drop.
    """
    landing, checkpoint = scratch_path(spark, f"{name}-landing"), scratch_path(spark, f"{name}-checkpoint")
    for cond in drops:
        table.filter(cond).write.mode("append").parquet(landing)
        job(spark.readStream.schema(table.schema).parquet(landing), checkpoint)
