"""Streaming queries; each is compared with its batch meaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import alerts as al
from ..session import scratch_path
from ..sources.model import CHUNK_OVERLAP, CHUNK_SIZE
from ..sources.tables import SCHEMAS
from ..streaming import jobs as st
from .ctes import ora
from .decisions import dsql
from .search import esql

MID = "2024-01-16"


def source(m, table="events"):
    # a pattern matches a table stored as one file and one stored as a folder
    return st.stream_source(m.spark, f"{m.folder}/{table}.{{parquet}}", table)


def to_files(m, name, stream, schema=None):
    path = scratch_path(m.spark, name)
    st.run_to_files(stream, path, scratch_path(m.spark, f"{name}-checkpoint"))
    return m.spark.read.parquet(path)


def halves():
    ts = F.col("ts")
    mid = F.lit(MID).cast("timestamp_ntz")
    return [ts < mid, ts >= mid]


def mixed():
    """Three drops by number, so that every drop but the first brings late rows."""
    return [F.col("event_id") % 3 == k for k in range(3)]


class _Over:
    """The canonical tables with another frame in place of the stored events."""

    def __init__(self, m, events):
        from ..sources.model import Model

        class Sub(Model):
            def raw(self, name):
                return events if name == "events" else super().raw(name)
        self.model = Sub(m.spark, m.folder)


def over(m, events):
    return _Over(m, events).model


def ntz(df, *cols):
    """Back to zone-less timestamps, as in the source tables."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in cols})


def register(cat) -> None:
    cat.add("stream_source", lambda m: to_files(m, "source", source(m).select("event_id", "user_id", "event_type", "value")),
            "SELECT event_id, user_id, event_type, value FROM events")
    cat.add("stream_changes", lambda m: to_files(m, "changes", st.stream_changes(source(m), "events", "event_id")),
            "SELECT 'events' table_name, event_id row_id, 'insert' operation FROM events")

    def graph(m):
        path = scratch_path(m.spark, "graph-deltas")

        def job(stream, checkpoint):
            edges = stream.select(F.col("user_id").alias("src"), F.col("event_type").alias("dst"), "event_id", "value")
            st.stream_graph_upsert(edges, ["src", "dst"], "event_id", path, checkpoint)
        st.landing_runs(m.spark, m.raw("events"), "graph", halves(), job)
        return st.current_rows(m.spark, path, ["src", "dst"], "event_id")
    cat.add("stream_graph_upsert", graph, """
        SELECT user_id src, event_type dst, max(event_id) event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2""")
    cat.add("stream_alerts", lambda m: to_files(m, "alerts", st.stream_alerts(over(m, source(m)).scores, al.thresholds(m.spark))),
            dsql("SELECT * FROM breaches"))

    def dedup(m):
        alerts = al.evaluate_thresholds(over(m, source(m)).scores, al.thresholds(m.spark))
        twice = alerts.withColumn("at_ts", F.lit("2024-01-01").cast("timestamp")).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
        return to_files(m, "dedup", st.stream_dedup_alerts(twice, "at_ts", "1 hour").select("score_id", "threshold_id", "severity"))
    cat.add("stream_dedup_alerts", dedup, dsql("SELECT score_id, threshold_id, severity FROM breaches"))
    def windows(m, name, keys, job):
        # the second drop goes on with windows that the first left open
        path = scratch_path(m.spark, name)
        st.landing_runs(m.spark, m.raw("events"), name, halves(), lambda s, c: st.upsert_windows(job(s), path, c))
        return ntz(st.current_windows(m.spark, path, keys, "10 MINUTES"), "window_start", "window_end")
    cat.add("tumbling_rates", lambda m: windows(m, "rates", ["user_id"], lambda s: st.tumbling_rates(
        s.select("user_id", "ts"), "user_id", "ts", "1 hour", "10 minutes")).drop("window_end"), """
        SELECT user_id, date_trunc('hour', ts) window_start, count(*) n,
          date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE closed FROM events GROUP BY 1, 2""")
    cat.add("sliding_demand", lambda m: windows(m, "demand", ["event_type"], lambda s: st.sliding_demand(
        s.select("event_type", "value", "ts"), "event_type", "value", "ts", "3 days", "1 day", "10 minutes")), """
        SELECT event_type, ws window_start, ws + INTERVAL 3 DAY window_end, count(*) n, round(sum(value), 4) volume,
          ws + INTERVAL 3 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE closed FROM (
          SELECT event_type, value, date_trunc('day', ts) - to_days(CAST(i AS INTEGER)) ws FROM events, range(0, 3) r(i)) GROUP BY 1, 2""")
    cat.add("sessions", lambda m: ntz(to_files(m, "sessions", st.sessions(
        source(m).select("user_id", "ts"), "user_id", "ts", "6 hours", "10 minutes")), "started_at", "ended_at"), """
        SELECT user_id, min(ts) started_at, max(ts) + INTERVAL 6 HOUR ended_at, count(*) n FROM (
          SELECT *, sum(CAST(p IS NULL OR ts - p >= INTERVAL 6 HOUR AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) s FROM (
            SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) p FROM events)) GROUP BY user_id, s
        HAVING max(ts) + INTERVAL 6 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE""")

    def crossings(m):
        path = scratch_path(m.spark, "crossings")
        thr = al.thresholds(m.spark)
        st.landing_runs(m.spark, m.raw("events"), "crossings", mixed(),
                        lambda s, c: st.stateful_crossings(over(m, s).scores, thr, path, c))
        return st.current_result(m.spark, path, ["entity_type", "entity_id"])
    cat.add("stateful_crossings", crossings, cat.sql["threshold_crossings"])

    def late(m):
        path = scratch_path(m.spark, "late")
        # a tenth of the rows arrives after everything else
        slow = F.col("event_id") % 10 == 0
        st.landing_runs(m.spark, m.raw("events"), "late", [~slow, slow],
                        lambda s, c: st.late_rows(s.select("event_id", "ts", "event_type"), "ts", "5 DAYS", path, c))
        count = lambda part: st.read_output(m.spark, f"{path}/{part}").groupBy("event_type").agg(
            F.count("*").alias("n")).withColumn("part", F.lit(part))
        return count("accepted").unionByName(count("quarantine"))
    cat.add("late_rows", late, """
        SELECT event_type, CASE WHEN event_id % 10 = 0 AND ts < (SELECT max(ts) FROM events WHERE event_id % 10 <> 0) - INTERVAL 5 DAY
          THEN 'quarantine' ELSE 'accepted' END part, count(*) n FROM events GROUP BY 1, 2""")

    def index(m):
        path = scratch_path(m.spark, "index")
        # the second drop brings all documents again
        st.landing_runs(m.spark, m.raw("documents"), "index", [F.col("doc_id") % 2 == 0, F.lit(True)],
                        lambda s, c: st.stream_index(s, path, c, CHUNK_SIZE, CHUNK_OVERLAP))
        return st.read_output(m.spark, f"{path}/chunks").select("doc_id", "chunk_index", "n_tokens", F.md5("chunk_text").alias("text_md5"))
    cat.add("stream_index", index, esql("SELECT doc_id, chunk_index, n_tokens, md5(chunk_text) text_md5 FROM chunks"))

    def lock(m):
        path = scratch_path(m.spark, "lockouts")
        st.landing_runs(m.spark, m.raw("events"), "lockouts", mixed(),
                        lambda s, c: st.stream_lockouts(over(m, s).audit_log, 5, path, c))
        return st.current_result(m.spark, path, ["actor_id"])
    cat.add("stream_lockouts", lock, cat.sql["lockouts"])
