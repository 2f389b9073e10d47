"""Graph assembly, maintenance and traversal queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import features as ft, graph as g, scenario as sc, traversal as tv
from ..session import scratch_path
from ..sources import sinks
from .ctes import CAT, ora

NODES_SQL = """
    SELECT 'supplier' node_type, CAST(s_suppkey AS VARCHAR) node_id, 18 n_features FROM supplier
    UNION ALL SELECT 'component', CAST(p_partkey AS VARCHAR), 12 FROM part
    UNION ALL SELECT DISTINCT 'product', p_brand, 9 FROM part
    UNION ALL SELECT DISTINCT 'factory', CAST(s_nationkey AS VARCHAR), 12 FROM supplier
    UNION ALL SELECT DISTINCT 'warehouse', CAST(c_nationkey AS VARCHAR), 12 FROM customer
    UNION ALL SELECT 'shipment', CAST(order_id * 10 + line_no AS VARCHAR), 5 FROM lines
    UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 6 FROM orders
    UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 3 FROM customer"""
EDGES_SQL = """
    SELECT 'SUPPLIES' edge_type, 'supplier' src_type, CAST(supplier_id AS VARCHAR) src, 'component' dst_type,
      CAST(component_id AS VARCHAR) dst, NULL::DOUBLE quantity, NULL::DOUBLE threshold, NULL::DATE due, NULL::VARCHAR status
      FROM supplier_components
    UNION ALL SELECT 'USED_IN', 'component', CAST(p_partkey AS VARCHAR), 'product', p_brand, p_size, NULL, NULL, NULL FROM part
    UNION ALL SELECT 'STOCKED_AT', 'product', product_id, 'warehouse', CAST(warehouse_id AS VARCHAR), stock_level,
      reorder_threshold, NULL, NULL FROM inventory
    UNION ALL SELECT 'MANUFACTURED_AT', 'product', product_id, 'factory', CAST(factory_id AS VARCHAR), NULL, NULL, NULL, NULL
      FROM made_at
    UNION ALL SELECT 'SHIPS_FROM', 'shipment', CAST(shipment_id AS VARCHAR), 'supplier', CAST(supplier_id AS VARCHAR),
      NULL, NULL, NULL, NULL FROM shipments
    UNION ALL SELECT 'SHIPS_TO', 'shipment', CAST(shipment_id AS VARCHAR), 'warehouse', CAST(warehouse_id AS VARCHAR),
      NULL, NULL, eta, status FROM routed
    UNION ALL SELECT 'FULFILLS', 'shipment', CAST(shipment_id AS VARCHAR), 'order', CAST(order_id AS VARCHAR),
      NULL, NULL, NULL, NULL FROM shipments
    UNION ALL SELECT 'ORDERED', 'order', CAST(order_id AS VARCHAR), 'product', product_id, sum(quantity), NULL, NULL, NULL
      FROM items GROUP BY order_id, product_id
    UNION ALL SELECT 'PLACED_BY', 'order', CAST(o_orderkey AS VARCHAR), 'customer', CAST(o_custkey AS VARCHAR),
      NULL, NULL, NULL, NULL FROM orders"""
EXTRA = {
    "made_at": """SELECT DISTINCT product_id, factory_id FROM routed WHERE order_id IN (
        SELECT order_id FROM routed GROUP BY 1 HAVING min(factory_id) = max(factory_id))""",
    "all_nodes": NODES_SQL,
    "all_edges": EDGES_SQL,
    "worst": """SELECT supplier_id FROM reliability_now ORDER BY reliability, supplier_id LIMIT 1""",
    "flow": """
        SELECT 'supplier' src_type, CAST(supplier_id AS VARCHAR) src, 'component' dst_type, CAST(component_id AS VARCHAR) dst
          FROM supplier_components
        UNION ALL SELECT 'component', CAST(p_partkey AS VARCHAR), 'product', p_brand FROM part
        UNION ALL SELECT 'product', product_id, 'order', CAST(order_id AS VARCHAR) FROM order_products""",
    "reach": """
        SELECT 'supplier' node_type, CAST(supplier_id AS VARCHAR) node_id, 0 hop FROM worst
        UNION SELECT dst_type, dst, hop + 1 FROM reach JOIN flow ON src_type = node_type AND src = node_id WHERE hop < 3""",
    "base_risk": """
        SELECT 'supplier' node_type, CAST(s_suppkey AS VARCHAR) node_id, round(1 - coalesce(reliability, 0.5), 6) risk
          FROM supplier LEFT JOIN reliability_now r ON r.supplier_id = s_suppkey
        UNION ALL SELECT 'component', CAST(p_partkey AS VARCHAR), 0.0::DOUBLE FROM part
        UNION ALL SELECT DISTINCT 'product', p_brand, 0.0::DOUBLE FROM part
        UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 0.0::DOUBLE FROM orders""",
}
HOP = """SELECT b.node_type, b.node_id, CASE WHEN mm IS NULL THEN risk ELSE risk * 0.4::DOUBLE + mm * 0.6::DOUBLE END score
    FROM base_risk b LEFT JOIN (SELECT dst_type, dst, avg(score) mm FROM {prev} JOIN flow ON src_type = node_type
    AND src = node_id GROUP BY 1, 2) x ON dst_type = node_type AND dst = node_id"""
EXTRA["hop0"] = "SELECT node_type, node_id, risk score FROM base_risk"
for _i in (1, 2, 3):
    EXTRA[f"hop{_i}"] = HOP.format(prev=f"hop{_i - 1}")
# two whole runs, without and with the overrides
STRONG = HOP.replace("0.4::DOUBLE", "0.050000000000000044::DOUBLE").replace("0.6::DOUBLE", "0.95::DOUBLE")
EXTRA["simulated_risk"] = """
    SELECT b.node_type, b.node_id, CASE WHEN node_type = 'supplier' AND k % 11 <> 0 AND k % 13 <> 0 AND (k % 3 = 0 OR k % 5 = 0)
      THEN round(greatest(0, least(1, 1 - CASE WHEN k % 3 = 0 THEN 0.05::DOUBLE ELSE coalesce(reliability, 1 - risk) END
        + coalesce(CASE WHEN k % 5 = 0 THEN (42 + k % 30 - lead_time_days) * (1 / 90.0::DOUBLE) END, 0))), 6) ELSE risk END risk
    FROM (SELECT *, CASE WHEN node_type = 'supplier' THEN CAST(node_id AS BIGINT) END k FROM base_risk) b
    LEFT JOIN suppliers s ON s.supplier_id = k LEFT JOIN reliability_now r ON r.supplier_id = k"""
for _run, _base in (("now", "base_risk"), ("then", "simulated_risk")):
    EXTRA[f"{_run}0"] = f"SELECT node_type, node_id, risk score FROM {_base}"
    for _i in (1, 2, 3):
        EXTRA[f"{_run}{_i}"] = STRONG.format(prev=f"{_run}{_i - 1}").replace("FROM base_risk b", f"FROM {_base} b")
EXTRA["what_if"] = f"""
    SELECT node_type, node_id, base_score, {CAT.format('base_score')} base_category, simulated_score, {CAT.format('simulated_score')} simulated_category,
      round(simulated_score - base_score, 6) + 0.0 change FROM (
      SELECT a.node_type, a.node_id, round(a.score + 1e-9, 6) + 0.0 base_score, round(b.score + 1e-9, 6) + 0.0 simulated_score
      FROM now3 a JOIN then3 b ON a.node_type = b.node_type AND a.node_id = b.node_id) WHERE round(simulated_score - base_score, 6) <> 0"""


def gsql(sql: str) -> str:
    return ora(sql, EXTRA)


def worst_supplier(m):
    """The least reliable supplier (a top-1 report)."""
    return ft.reliability_now(m.shipments).orderBy("reliability", "supplier_id").limit(1).select("supplier_id")


def flow_edges(m):
    """Edges in the direction in which a disruption travels."""
    fwd = g.build_edges(m, ["SUPPLIES", "USED_IN"]).select("src_type", "src", "dst_type", "dst")
    back = m.items.select("order_id", "product_id").distinct().select(
        F.lit("product").alias("src_type"), F.col("product_id").alias("src"),
        F.lit("order").alias("dst_type"), F.col("order_id").cast("string").alias("dst"))
    return fwd.unionByName(back)


def stored_flow(m):
    """The flow graph as a written table: every hop reads it again."""
    return m.written(flow_edges(m.staged), "flow")


def _supplier_risk(m, rel):
    """Suppliers with their reliability, null if unknown, and their own risk: unreliability."""
    return m.raw("supplier").select(F.col("s_suppkey").alias("supplier_id")).join(rel, "supplier_id", "left").select(
        F.lit("supplier").alias("node_type"), F.col("supplier_id").cast("string").alias("node_id"),
        fx.r6(1 - F.coalesce("reliability", F.lit(0.5))).alias("risk"), "reliability")


def _with_other_nodes(m, sup):
    """``sup`` and the other nodes on the flow graph, whose own risk is 0."""
    zero = lambda df, t, c: df.select(F.lit(t).alias("node_type"), F.col(c).cast("string").alias("node_id"), F.lit(0.0).alias("risk"))
    for other in (zero(m.raw("part"), "component", "p_partkey"), zero(m.raw("part").select("p_brand").distinct(), "product", "p_brand"),
                  zero(m.raw("orders"), "order", "o_orderkey")):
        sup = sup.unionByName(other, allowMissingColumns=True)
    return sup


def base_risk(m):
    """Own risk of every node on the flow graph: unreliability for suppliers, else 0."""
    return _with_other_nodes(m, _supplier_risk(m, ft.reliability_now(m.shipments)).drop("reliability"))


def supplier_features(m):
    """Own risk of every node on the flow graph, with the features of the suppliers."""
    known = m.suppliers.select(F.col("supplier_id").cast("string").alias("node_id"), F.col("lead_time_days").cast("double"))
    return _with_other_nodes(m, _supplier_risk(m, ft.reliability_now(m.shipments)).join(known, "node_id", "left"))


def feature_overrides(m):
    """Unreliable and slow suppliers; some values are out of range, of no feature or of no supplier."""
    k = F.col("s_suppkey")
    one = lambda keep, feature, value: m.raw("supplier").filter(keep).select(
        F.lit("supplier").alias("node_type"), k.cast("string").alias("node_id"), F.lit(feature).alias("feature"), value.cast("double").alias("value"))
    none = m.raw("supplier").agg(F.max("s_suppkey").alias("m")).select(
        F.lit("supplier").alias("node_type"), (F.col("m") + 1).cast("string").alias("node_id"), F.lit("reliability").alias("feature"), F.lit(0.5).alias("value"))
    return (one(k % 3 == 0, "reliability", F.lit(0.05)).unionByName(one(k % 5 == 0, "lead_time_days", 42 + k % 30))
            .unionByName(one(k % 11 == 0, "lead_time_days", F.lit(-5))).unionByName(one(k % 13 == 0, "colour", F.lit(1))).unionByName(none))


def what_if(m):
    """Every node whose score changes in the scenario of ``feature_overrides``."""
    base = m.written(supplier_features(m.staged), "features")
    usable = m.written(sc.check_features(m.written(feature_overrides(m), "overrides"), base)[0], "usable")
    changed = sc.changed_risk(base, usable).select("node_type", "node_id", (F.col("simulated") - F.col("risk")).alias("delta"))
    flow = stored_flow(m)
    now = tv.propagate_risk(base.select("node_type", "node_id", "risk"), flow, 3, 0.95, digits=None)
    return sc.rescored_nodes(now, sc.spread_change(changed, flow, 3, 0.95))


def supplier_values(m):
    return m.raw("supplier").select("s_suppkey").join(
        ft.reliability_now(m.shipments), F.col("supplier_id") == F.col("s_suppkey"), "left").select(
        F.col("s_suppkey").cast("string").alias("node_id"), F.coalesce("reliability", F.lit(0.5)).alias("reliability"))


def component_values(m):
    return ft.minmax_scale(m.components, "unit_cost").select(
        F.col("component_id").cast("string").alias("node_id"), fx.r6(F.col("unit_cost_scaled")).alias("reliability"))


def _snapshot(m):
    path = scratch_path(m.spark, "graph")
    kinds = ["supplier", "component", "product", "customer"]
    sinks.write_graph_snapshot(g.build_nodes(m, kinds), g.build_edges(m, ["SUPPLIES", "USED_IN", "PLACED_BY"]), path, "s1")
    nodes, edges = sinks.read_graph_snapshot(m.spark, path, "s1")
    return g.graph_summary(nodes, edges)


def _current_and_changed(m):
    """Stored edges and a batch in which two thirds of the quantities changed."""
    edges = g.build_edges(m, ["USED_IN"]).select("src", "dst", "quantity").withColumn("version", F.lit(1))
    changed = edges.filter(F.col("src").cast("bigint") % 3 != 0).withColumn(
        "quantity", F.col("quantity") + 1).withColumn("version", F.lit(2))
    return edges, changed


def register(cat) -> None:
    cat.add("write_graph_snapshot", _snapshot, gsql("""
        SELECT 'node' kind, node_type part, count(*) n FROM all_nodes
          WHERE node_type IN ('supplier', 'component', 'product', 'customer') GROUP BY 1, 2
        UNION ALL SELECT 'edge', edge_type, count(*) FROM all_edges WHERE edge_type IN ('SUPPLIES', 'USED_IN', 'PLACED_BY') GROUP BY 1, 2"""))
    cat.add("build_nodes", lambda m: g.build_nodes(m.staged).select("node_type", "node_id", F.size("features").alias("n_features")),
            gsql("SELECT * FROM all_nodes"))
    cat.add("build_edges", lambda m: g.build_edges(m.staged), gsql("SELECT * FROM all_edges"))
    cat.add("infer_manufactured_at", lambda m: g.infer_manufactured_at(m.routed)[0], gsql("SELECT * FROM made_at"))
    cat.add("ambiguous_factories", lambda m: g.infer_manufactured_at(m.routed)[1], ora("""
        SELECT 'orders' table_name, order_id row_id, 'factory_id' AS field, 'ambiguous factory' reason
        FROM routed GROUP BY order_id HAVING min(factory_id) < max(factory_id)"""))
    cat.add("node_id_map", lambda m: g.node_id_map(g.build_nodes(m, ["supplier", "component", "order", "customer"])), gsql("""
        SELECT node_type, node_id, row_number() OVER (PARTITION BY node_type ORDER BY substr(md5(node_id), 1, 3), node_id) - 1 node_index
        FROM all_nodes WHERE node_type IN ('supplier', 'component', 'order', 'customer')"""))
    cat.add("edge_features", lambda m: ft.edge_features(
        g.build_edges(m, ["USED_IN", "STOCKED_AT", "SHIPS_TO", "ORDERED"]), m.as_of), gsql("""
        SELECT e.edge_type, src, dst, round(coalesce(CASE
            WHEN e.edge_type = 'STOCKED_AT' THEN quantity / nullif(threshold, 0)
            WHEN e.edge_type = 'SHIPS_TO' THEN CAST(due - (SELECT d FROM snap) AS DOUBLE)
            ELSE (quantity - lo) / nullif(hi - lo, 0) END, 0), 6) edge_feature
        FROM all_edges e JOIN (SELECT edge_type, min(quantity) lo, max(quantity) hi FROM all_edges GROUP BY 1) s
          ON s.edge_type = e.edge_type WHERE e.edge_type IN ('USED_IN', 'STOCKED_AT', 'SHIPS_TO', 'ORDERED')"""))
    cat.add("degenerate_features", lambda m: ft.degenerate_features(
        m.raw("documents").join(m.raw("labels"), "doc_id", "left").select(
            F.lit("document").alias("node_type"), F.col("doc_id").cast("string").alias("node_id"),
            F.array(F.col("quality").cast("double"), F.col("toxic").cast("double")).alias("features"))), """
        SELECT 'document' node_type, CAST(d.doc_id AS VARCHAR) node_id,
          CASE WHEN quality IS NULL THEN 'all_missing' ELSE 'all_zero' END problem
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE quality IS NULL OR (quality = 0 AND toxic = 0)""")
    cat.add("apply_changes", lambda m: g.apply_changes(*_current_and_changed(m), ["src", "dst"]), """
        SELECT CAST(p_partkey AS VARCHAR) src, p_brand dst, CAST(p_size + CAST(p_partkey % 3 <> 0 AS INT) AS DOUBLE) quantity,
          1 + CAST(p_partkey % 3 <> 0 AS INT) "version" FROM part""")

    def merge_twice(m):
        edges, changed = _current_and_changed(m)
        once = g.merge_idempotent(edges, changed, ["src", "dst"], "version")
        return g.merge_idempotent(once, changed, ["src", "dst"], "version")
    cat.add("merge_idempotent", merge_twice, cat.sql["apply_changes"])
    cat.add("needs_full_rebuild", lambda m: g.needs_full_rebuild(
        m.shipments.filter(F.col("created_at") < F.lit("2000-01-01")), m.shipments, "status"), ora("""
        SELECT a.status part, n_before, n_after, 'drift' reason FROM (
          SELECT status, count(*) FILTER (created_at < DATE '2000-01-01') n_before, count(*) n_after FROM shipments GROUP BY 1) a
        WHERE abs(n_after - n_before) / greatest(n_before, 1) > 0.2"""))

    def validate(m):
        # the graph one day late: newest shipments have edges but no node yet
        m = m.staged
        nodes = g.build_nodes(m, ["supplier", "component", "product", "customer", "order"])
        return g.validate_graph(nodes, g.build_edges(m, ["SUPPLIES", "USED_IN", "FULFILLS", "PLACED_BY"]))
    cat.add("validate_graph", validate, gsql("""
        SELECT 'shipment' node_type, CAST(shipment_id AS VARCHAR) node_id, 'dangling_edge' problem FROM shipments
        UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'orphan_node' FROM supplier WHERE s_suppkey NOT IN (SELECT supplier_id FROM lines)
        UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR), 'orphan_node' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)"""))
    def placed_by(m):
        # links of at-risk orders have not arrived yet
        linked = m.orders.filter(F.col("status") != "at_risk").select(F.col("order_id").cast("string").alias("src"))
        edges = g.build_edges(m, ["PLACED_BY"]).join(linked, "src", "left_semi")
        return g.validate_placed_by(g.build_nodes(m, ["order", "customer"]), edges)
    cat.add("validate_placed_by", placed_by, """
        SELECT 'customer' node_type, CAST(c_custkey AS VARCHAR) node_id, 'notice' AS "level" FROM customer
        WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus <> 'P')
        UNION ALL SELECT 'order', CAST(o_orderkey AS VARCHAR), 'error' FROM orders WHERE o_orderstatus = 'P'""")

    def equal(m):
        a = g.build_edges(m, ["USED_IN"]).select("src", "dst", "quantity")
        b = m.raw("part").select(F.col("p_partkey").cast("string").alias("src"), F.col("p_brand").alias("dst"),
                                 F.greatest(F.col("p_size"), F.lit(3)).cast("double").alias("quantity"))
        return g.graph_equal(a, b)
    cat.add("graph_equal", equal, """
        SELECT CAST(p_partkey AS VARCHAR) src, p_brand dst, CAST(p_size AS DOUBLE) quantity, 'left_only' side FROM part WHERE p_size < 3
        UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_brand, 3.0::DOUBLE, 'right_only' FROM part WHERE p_size < 3""")
    cat.add("graph_summary", lambda m: g.graph_summary(g.build_nodes(m.staged), g.build_edges(m.staged)), gsql("""
        SELECT 'node' kind, node_type part, count(*) n FROM all_nodes GROUP BY 1, 2
        UNION ALL SELECT 'edge', edge_type, count(*) FROM all_edges GROUP BY 1, 2"""))
    cat.add("degree", lambda m: g.degree(g.build_edges(m.staged)), gsql("""
        SELECT node_type, node_id, CAST(sum(i) AS BIGINT) in_degree, CAST(sum(o) AS BIGINT) out_degree FROM (
          SELECT src_type node_type, src node_id, 0 i, 1 o FROM all_edges UNION ALL SELECT dst_type, dst, 1, 0 FROM all_edges)
        GROUP BY 1, 2"""))

    # -- traversal ---------------------------------------------------------------------------
    cat.add("blast_radius", lambda m: tv.blast_radius(stored_flow(m), worst_supplier(m.staged).select(
        F.lit("supplier").alias("node_type"), F.col("supplier_id").cast("string").alias("node_id")), 3),
        gsql("SELECT node_type, node_id, min(hop) hop FROM reach GROUP BY 1, 2"))
    cat.add("supplier_dependents", lambda m: tv.supplier_dependents(
        m.supplier_components, m.product_components, worst_supplier(m)), gsql("""
        SELECT DISTINCT supplier_id, component_id, p_brand product_id FROM supplier_components JOIN part ON p_partkey = component_id
        WHERE supplier_id IN (SELECT supplier_id FROM worst)"""))
    cat.add("orders_affected_by", lambda m: tv.orders_affected_by(
        m.supplier_components, m.product_components, m.items, worst_supplier(m)), gsql("""
        SELECT DISTINCT order_id FROM items WHERE product_id IN (SELECT p_brand FROM supplier_components
          JOIN part ON p_partkey = component_id WHERE supplier_id IN (SELECT supplier_id FROM worst))"""))

    def induced(m):
        comps = m.components.filter(F.col("component_type") == "ECONOMY").select(
            F.lit("component").alias("node_type"), F.col("component_id").cast("string").alias("node_id"))
        sup = m.raw("supplier").filter(F.col("s_acctbal") < 2000).select(
            F.lit("supplier").alias("node_type"), F.col("s_suppkey").cast("string").alias("node_id"))
        cust = m.raw("customer").filter(F.col("c_acctbal") < 0).select(
            F.lit("customer").alias("node_type"), F.col("c_custkey").cast("string").alias("node_id"))
        return tv.induced_subgraph(g.build_edges(m, ["SUPPLIES", "PLACED_BY"]), comps.unionByName(sup).unionByName(cust))
    cat.add("induced_subgraph", induced, _induced_sql())
    cat.add("sample_neighbors", lambda m: tv.sample_neighbors(g.build_edges(m, ["SUPPLIES", "PLACED_BY"]), 5, 7), gsql("""
        SELECT edge_type, src, dst FROM all_edges WHERE edge_type IN ('SUPPLIES', 'PLACED_BY')
        QUALIFY row_number() OVER (PARTITION BY edge_type, src ORDER BY md5('7|' || src || '|' || dst), dst) <= 5"""))
    cat.add("mean_aggregate", lambda m: tv.mean_aggregate(
        supplier_values(m), g.build_edges(m, ["SUPPLIES"]), ["reliability"]), ora("""
        SELECT CAST(component_id AS VARCHAR) node_id, count(*) n_neighbors, round(avg(coalesce(reliability, 0.5)), 6) mean_reliability
        FROM supplier_components sc LEFT JOIN reliability_now r ON r.supplier_id = sc.supplier_id GROUP BY 1"""))
    cat.add("attention_aggregate", lambda m: tv.attention_aggregate(
        supplier_values(m), component_values(m), g.build_edges(m, ["SUPPLIES"]), ["reliability"]), ora("""
        SELECT CAST(component_id AS VARCHAR) node_id, round(sum(exp(-abs(rel - cost)) * rel) / sum(exp(-abs(rel - cost))), 6) att_reliability
        FROM (SELECT component_id, coalesce(reliability, 0.5::DOUBLE) rel, round((p_retailprice - lo) / (hi - lo), 6) AS cost
          FROM supplier_components sc LEFT JOIN reliability_now r ON r.supplier_id = sc.supplier_id
          JOIN part ON p_partkey = component_id, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part)) GROUP BY 1"""))

    def typed(m):
        m = m.staged
        values = base_risk(m).withColumnRenamed("risk", "x")
        comp = component_values(m).select(F.lit("component").alias("node_type"), "node_id", F.col("reliability").alias("x"))
        values = values.filter(F.col("node_type") == "supplier").unionByName(comp)
        rev = lambda e: e.select("edge_type", F.col("dst_type").alias("src_type"), F.col("dst").alias("src"),
                                 F.col("src_type").alias("dst_type"), F.col("src").alias("dst"))
        edges = g.build_edges(m, ["SUPPLIES", "USED_IN"]).select("edge_type", "src_type", "src", "dst_type", "dst")
        ships = rev(g.build_edges(m, ["SHIPS_FROM"]))
        return tv.typed_aggregate(values, edges.unionByName(ships), "x", ["SUPPLIES", "USED_IN", "SHIPS_FROM"])
    cat.add("typed_aggregate", typed, gsql("""
        SELECT 'component' node_type, CAST(component_id AS VARCHAR) node_id, round(avg(risk), 6) mean_supplies,
          NULL::DOUBLE mean_used_in, NULL::DOUBLE mean_ships_from
        FROM supplier_components JOIN base_risk ON node_type = 'supplier' AND node_id = CAST(supplier_id AS VARCHAR) GROUP BY 1, 2
        UNION ALL SELECT 'product', p_brand, NULL, round(avg(round((p_retailprice - lo) / (hi - lo), 6)), 6), NULL
        FROM part, (SELECT min(p_retailprice) lo, max(p_retailprice) hi FROM part) GROUP BY 1, 2
        UNION ALL SELECT 'shipment', CAST(shipment_id AS VARCHAR), NULL, NULL, round(risk, 6)
        FROM shipments JOIN base_risk ON node_type = 'supplier' AND node_id = CAST(supplier_id AS VARCHAR)"""))
    cat.add("what_if_rejected", lambda m: sc.check_features(feature_overrides(m), base_risk(m))[1], gsql("""
        SELECT 'supplier' node_type, CAST(s_suppkey AS VARCHAR) node_id, 'lead_time_days' feature, -5.0::DOUBLE "value", 'out of range' reason
        FROM supplier WHERE s_suppkey % 11 = 0 UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR), 'colour', 1.0, 'unknown feature' FROM supplier
        WHERE s_suppkey % 13 = 0 UNION ALL SELECT 'supplier', CAST(max(s_suppkey) + 1 AS VARCHAR), 'reliability', 0.5, 'unknown node' FROM supplier"""))
    cat.add("rescore_downstream", what_if, gsql("SELECT * FROM what_if"))
    cat.add("shifted_downstream", lambda m: sc.shifted_nodes(what_if(m)), gsql("""
        SELECT * FROM what_if WHERE node_type IN ('order', 'product') AND base_category <> simulated_category"""))
    cat.add("propagate_risk", lambda m: tv.propagate_risk(m.written(base_risk(m.staged), "base"), stored_flow(m), 3, 0.6),
            gsql("SELECT node_type, node_id, round(score, 9) score FROM hop3"))


def _induced_sql() -> str:
    return ora("""
        SELECT * FROM ie UNION ALL SELECT NULL, t, i, NULL, NULL FROM ids
        WHERE t || i NOT IN (SELECT src_type || src FROM ie) AND t || i NOT IN (SELECT dst_type || dst FROM ie)""", {
        **EXTRA,
        "ids": """SELECT 'component' t, CAST(p_partkey AS VARCHAR) i FROM part WHERE p_type = 'ECONOMY'
            UNION ALL SELECT 'supplier', CAST(s_suppkey AS VARCHAR) FROM supplier WHERE s_acctbal < 2000
            UNION ALL SELECT 'customer', CAST(c_custkey AS VARCHAR) FROM customer WHERE c_acctbal < 0""",
        "ie": """SELECT edge_type, src_type, src, dst_type, dst FROM all_edges JOIN ids a ON a.t = src_type AND a.i = src
            JOIN ids b ON b.t = dst_type AND b.i = dst WHERE edge_type IN ('SUPPLIES', 'PLACED_BY')"""})
