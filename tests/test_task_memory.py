"""Bounded work per task."""

from haulwise.operators import traversal as tv
from haulwise.session import MOST_BYTES, configure, deal_finer


def test_few_sources_leave_edges_unshuffled(spark):
    """sources of an unknown size were sorted and shuffled together with all edges."""
    values = spark.createDataFrame([("supplier", str(i), i / 10) for i in range(5)] + [("component", "1", 0.5), (None, "1", 0.9)], "node_type string, node_id string, x double")
    edges = spark.createDataFrame(
        [("S", "supplier", str(i % 6), "component", str(i % 3)) for i in range(12)] + [("U", "component", "1", "product", "p"), ("V", "component", "1", "product", "p")],
        "edge_type string, src_type string, src string, dst_type string, dst string")
    out = tv.typed_aggregate(values, edges, "x", ["S", "U"])
    assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
    assert {(r.node_type, r.node_id): (r.mean_s, r.mean_u) for r in out.collect()} == {
        ("component", "0"): (0.15, None), ("component", "1"): (0.25, None), ("component", "2"): (0.2, None), ("product", "p"): (None, 0.5)}
    assert tv.typed_aggregate(values.limit(0), edges, "x", ["S", "U"]).count() == 0


def test_input_per_task_is_bounded(spark):
    """with Spark's own settings a task's hash tables grew with the input."""
    keys = [*MOST_BYTES, "spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.initialPartitionNum"]
    before = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k in MOST_BYTES:
            spark.conf.unset(k)
        assert {k: spark.conf.get(k) for k in configure(spark).conf.getAll if k in MOST_BYTES} == {k: f"{v}b" for k, v in MOST_BYTES.items()}
        for k in MOST_BYTES:
            spark.conf.set(k, "8m")
        assert [configure(spark).conf.get(k) for k in MOST_BYTES] == ["8m", "8m"]
        for parts, want in ((4, "32"), (12, "96"), (200, "200"), (600, "600")):
            spark.conf.set(keys[2], parts)
            assert deal_finer(spark).conf.get(keys[3]) == want
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
