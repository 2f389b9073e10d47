"""Threshold alerts, approval invariants and audit analytics."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..functions import columns as fx
from ..plans.windows import lagged, latest_per_key, running_last, running_sum, top_per_key

METRICS = ["delay_probability", "shortage_risk", "impact_score"]

# Default thresholds (our choice): (id, entity type, metric, value).
DEFAULT_THRESHOLDS = [
    (1, "supplier", "delay_probability", 0.80), (2, "product", "delay_probability", 0.85),
    (3, "order", "delay_probability", 0.75), (4, "shipment", "delay_probability", 0.90),
    (5, "supplier", "shortage_risk", 0.90), (6, "product", "shortage_risk", 0.70),
    (7, "supplier", "impact_score", 0.50), (8, "shipment", "impact_score", 0.60),
]


def thresholds(spark: SparkSession, rows: Sequence[tuple] = DEFAULT_THRESHOLDS) -> DataFrame:
    """Thresholds from a list that the driver holds; marked, so that every join sends them to the scores."""
    return F.broadcast(spark.createDataFrame(rows, "threshold_id int, entity_type string, metric string, threshold_value double"))


def metric_rows(scores: DataFrame) -> DataFrame:
    """One row per score and metric."""
    ids = [F.col(c) for c in ("score_id", "entity_type", "entity_id", "scored_at")]
    return scores.unpivot(ids, [F.col(c) for c in METRICS], "metric", "metric_value")


def evaluate_thresholds(scores: DataFrame, thr: DataFrame) -> DataFrame:
    """Breaches: value at or above the threshold of its (type, metric)."""
    return metric_rows(scores).join(thr, ["entity_type", "metric"]).filter(
        F.col("metric_value") >= F.col("threshold_value")).select(
        "score_id", "threshold_id", "entity_type", "entity_id", "metric", "metric_value",
        fx.category(F.col("metric_value")).alias("severity"))


def threshold_crossings(scores: DataFrame, thr: DataFrame) -> DataFrame:
    """Only upward crossings; a first score at or above the threshold counts as one."""
    rows = metric_rows(scores).withColumn("_day", F.to_date("scored_at"))
    prev = lagged(rows, ["entity_type", "entity_id", "metric"], "_day", ["scored_at", "score_id"], {"_prev": "metric_value"})
    hit = prev.join(thr, ["entity_type", "metric"]).filter(
        (F.col("metric_value") >= F.col("threshold_value"))
        & (F.coalesce("_prev", F.lit(-1.0)) < F.col("threshold_value")))
    return hit.select("score_id", "threshold_id", "entity_type", "entity_id", "metric", "metric_value")


def severity(df: DataFrame, score: str) -> DataFrame:
    return df.withColumn("severity", fx.category(F.col(score)))


def new_alerts(breaches: DataFrame, existing: DataFrame) -> DataFrame:
    """Exactly one alert per score and threshold that has none yet."""
    key = ["score_id", "threshold_id"]
    return breaches.join(existing.select(*key), key, "left_anti").dropDuplicates(key)


def threshold_sweep(scored: DataFrame, score: str, label: str, grid: Sequence[float]) -> DataFrame:
    """Alert volume and false-positive share for every candidate threshold.

    Each row counts once into the band between two candidates; the few band
    totals are then added up from the top. Nothing is multiplied by the grid.
    """
    grid = sorted(grid)
    band = F.lit(0)
    for g in grid:
        band = band + F.when(F.col(score) >= g, 1).otherwise(0)
    bands = scored.groupBy(band.alias("_band")).agg(
        F.count("*").alias("_n"), F.count_if(F.col(label)).alias("_pos"))
    candidates = F.explode(F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(g)).alias("threshold_value"))
                                     for i, g in enumerate(grid)])).alias("c")
    return (bands.select("*", candidates).filter(F.col("_band") >= F.col("c._i"))
            .groupBy("c.threshold_value").agg(F.sum("_n").alias("n_alerts"), F.sum("_pos").alias("n_true"))
            .withColumn("false_positive_rate", fx.r6(1 - F.col("n_true") / F.col("n_alerts"))))


def notification_records(alerts: DataFrame, owners: DataFrame) -> DataFrame:
    """One record per alert, channel and owner role of the entity type; nothing is sent."""
    return alerts.join(owners, "entity_type").select(
        "score_id", "threshold_id", "channel", "recipient", "severity")


def delivery_summary(records: DataFrame) -> DataFrame:
    return records.groupBy("channel", "status").agg(F.count("*").alias("n"))


# Allowed status moves.
REQUEST_MOVES = [("pending", "approved"), ("pending", "rejected"), ("approved", "executed"), ("approved", "failed")]
REGISTRY_MOVES = [("training", "evaluating"), ("evaluating", "candidate"), ("candidate", "active"),
                  ("candidate", "archived"), ("active", "archived")]


def illegal_moves(history: DataFrame, key: str, allowed: Sequence[tuple[str, str]], first: str) -> DataFrame:
    """Status changes outside the allowed pairs; an entity must start with ``first``."""
    rows = history.withColumn("_day", F.to_date("changed_at"))
    prev = lagged(rows, [key], "_day", ["changed_at", "change_id"], {"previous_status": "status"})
    ok = F.col("previous_status").isNull() & (F.col("status") == first)
    for a, b in allowed:
        ok = ok | F.coalesce((F.col("previous_status") == a) & (F.col("status") == b), F.lit(False))
    return prev.filter(~ok).select("change_id", key, "previous_status", "status", "changed_at")


def executed_without_approval(requests: DataFrame, log: DataFrame) -> DataFrame:
    """Execution rows whose request was not approved; must be empty."""
    approved = requests.filter(F.col("status") == "approved").select("request_id")
    return log.join(approved, "request_id", "left_anti")


def missing_decision_trace(requests: DataFrame) -> DataFrame:
    """Decided requests without a trace, or with an empty one."""
    trace = F.from_json("decision_trace", "map<string,string>")
    empty = F.col("decision_trace").isNull() | trace.isNull() | (F.size(F.map_keys(trace)) == 0)
    return requests.filter((F.col("status") != "pending") & empty)


def missing_reject_reason(requests: DataFrame) -> DataFrame:
    return requests.filter((F.col("status") == "rejected") & (F.trim(F.coalesce("rejection_reason", F.lit(""))) == ""))


def execution_rates(log: DataFrame) -> DataFrame:
    return log.groupBy("target_system").agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("n_success")).withColumn(
        "success_rate", fx.r6(F.try_divide("n_success", "n")))


def double_decisions(history: DataFrame) -> DataFrame:
    """Every decision on a request after its first; the first one wins."""
    decided = history.filter(F.col("status").isin("approved", "rejected"))
    first = decided.groupBy("request_id").agg(
        F.min(F.struct("changed_at", "change_id")).alias("_f"), F.count("*").alias("_n")).filter(F.col("_n") > 1).select(
        "request_id", F.col("_f.change_id").alias("first_change_id"))
    return decided.join(first, "request_id").filter(F.col("change_id") != F.col("first_change_id"))


def failure_runs(audit: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Length of the running streak of failed logins at every login event.

    Streak = failures so far minus failures at the last success; both are running
    values over day segments. ``carried`` (actor_id, carried) adds the streak an
    actor had before these events.
    """
    ev = audit.filter(F.col("event_type").isin("login_failed", "login_success")).select(
        "actor_id", "audit_id", "created_at", F.to_date("created_at").alias("_day"),
        (F.col("event_type") == "login_failed").cast("int").alias("_fail"))
    order = ["created_at", "audit_id"]
    total = running_sum(ev, ["actor_id"], "_day", order, {"_fails": F.col("_fail")})
    mark = running_last(total, ["actor_id"], "_day", order, {"_base": F.when(F.col("_fail") == 0, F.col("_fails"))})
    before = F.lit(0)
    if carried is not None:
        mark, before = mark.join(carried, "actor_id", "left"), F.coalesce("carried", F.lit(0))
    return mark.withColumn("run_length", F.col("_fails") - F.coalesce(F.col("_base"), -before)).select(
        "actor_id", "audit_id", "created_at", (F.col("_fail") == 1).alias("is_failure"), "run_length")


def locked(runs: DataFrame, n: int) -> DataFrame:
    return runs.filter(F.col("is_failure") & (F.col("run_length") == n)).select("actor_id", "audit_id", "created_at")


def lockouts(audit: DataFrame, n: int = 5) -> DataFrame:
    """The event that completes ``n`` failed logins in a row."""
    return locked(failure_runs(audit), n)


def rate_breaches(events: DataFrame, who: str, ts: str, limit: int = 100, window: str = "1 minute") -> DataFrame:
    """Users above ``limit`` events in a tumbling window."""
    return (events.groupBy(who, F.window(ts, window).alias("w")).agg(F.count("*").alias("n"))
            .filter(F.col("n") > limit).select(who, F.col("w.start").alias("window_start"), "n"))


def eligible_actions(requests: DataFrame) -> DataFrame:
    """Newest approved request per entity; older ones are superseded."""
    approved = requests.filter(F.col("status") == "approved")
    return latest_per_key(approved, ["entity_type", "entity_id"], [F.col("created_at").desc(), F.col("request_id").desc()])


def false_positive_rate(alerts: DataFrame, truth: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Share of alerts without a true incident, per severity."""
    t = truth.select(*keys).distinct().withColumn("_true", F.lit(1))
    return alerts.join(t, list(keys), "left").groupBy("severity").agg(
        F.count("*").alias("n_alerts"), fx.r6(F.avg(F.when(F.col("_true").isNull(), 1.0).otherwise(0.0))).alias("false_positive_rate"))
