"""Stateful streaming jobs must not depend on the order in which rows arrive."""

import datetime as dt

from haulwise.operators import alerts as al
from haulwise.session import scratch_path
from haulwise.streaming import jobs as st


def day(n):
    return dt.datetime(2024, 1, n)


def drops(spark, schema, batches, job):
    landing, checkpoint = scratch_path(spark, "late-landing"), scratch_path(spark, "late-checkpoint")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(landing)
        job(spark.readStream.schema(schema).parquet(landing), checkpoint)


def test_late_score_makes_no_false_crossing(spark):
    schema = ("score_id bigint, entity_type string, entity_id bigint, scored_at timestamp, "
              "delay_probability double, shortage_risk double, impact_score double")
    row = lambda i, d, v: (i, "supplier", 7, day(d), v, None, None)
    batches = [[row(1, 1, 0.9), row(2, 10, 0.9)], [row(3, 5, 0.95)], [row(4, 7, 0.1)]]
    path = scratch_path(spark, "late-crossings")
    drops(spark, schema, batches, lambda s, c: st.stateful_crossings(s, al.thresholds(spark), path, c))
    got = st.current_result(spark, path, ["entity_type", "entity_id"]).collect()
    want = al.threshold_crossings(spark.createDataFrame(sum(batches, []), schema), al.thresholds(spark)).collect()
    assert {(r.score_id, r.threshold_id) for r in got} == {(r.score_id, r.threshold_id) for r in want} == {(1, 1), (2, 1)}


def test_late_failures_lock(spark):
    schema = "audit_id bigint, actor_id bigint, event_type string, created_at timestamp"
    fail = lambda i, d: (i, 1, "login_failed", day(d))
    batches = [[fail(1, 1), fail(2, 2), fail(3, 3), (4, 1, "login_success", day(9))], [fail(5, 4), fail(6, 5)]]
    path = scratch_path(spark, "late-lockouts")
    drops(spark, schema, batches, lambda s, c: st.stream_lockouts(s, 5, path, c))
    assert [r.audit_id for r in st.current_result(spark, path, ["actor_id"]).collect()] == [6]
