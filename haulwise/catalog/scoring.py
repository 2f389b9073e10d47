"""Risk scoring and dashboard queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import features as ft, graph as g, risk as rk, views as vw
from .ctes import CAT, ora
from .graphs import supplier_values

EXTRA = {
    "touched": "SELECT supplier_id, count(DISTINCT order_id) affected_orders FROM lines GROUP BY 1",
    "current_scores": f"SELECT *, {CAT.format('delay_probability')} risk_category FROM latest",
    "attr": """
        SELECT dst, src, round(delta, 6) + 0.0 delta, round(CASE WHEN s > 1e-12 THEN abs(delta) / s ELSE 1.0 / n END, 6) weight FROM (
          SELECT *, sum(abs(delta)) OVER (PARTITION BY dst) s FROM (
            SELECT dst, src, n, round(CASE WHEN n > 1 THEN (x - mu) / (n - 1) ELSE x END, 9) delta FROM (
              SELECT CAST(component_id AS VARCHAR) dst, CAST(sc.supplier_id AS VARCHAR) src, coalesce(reliability, 0.5::DOUBLE) x,
                avg(coalesce(reliability, 0.5::DOUBLE)) OVER (PARTITION BY component_id) mu, count(*) OVER (PARTITION BY component_id) n
              FROM supplier_components sc LEFT JOIN reliability_now r ON r.supplier_id = sc.supplier_id)))""",
    "natives": """
        SELECT supplier_id, round((coalesce(0.6 * delay_risk, 0) + coalesce(0.4 * inventory_risk, 0)) / nullif(
          (CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.6 END + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.4 END), 0), 6) native_score
        FROM supplier_signals""",
    "formula": """
        SELECT supplier_id, round((coalesce(0.3 * supplier_risk, 0) + coalesce(0.25 * delay_risk, 0) + coalesce(0.2 * inventory_risk, 0)
            + coalesce(0.15 * demand_risk, 0) + coalesce(0.1 * financial_risk, 0))
          / nullif(CASE WHEN supplier_risk IS NULL THEN 0 ELSE 0.3 END + CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.25 END
            + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.2 END + CASE WHEN demand_risk IS NULL THEN 0 ELSE 0.15 END
            + CASE WHEN financial_risk IS NULL THEN 0 ELSE 0.1 END, 0), 6) impact_score FROM supplier_signals""",
}


def ssql(sql: str) -> str:
    return ora(sql, EXTRA)


def component_attribution(m):
    return rk.attribution(supplier_values(m), g.build_edges(m, ["SUPPLIES"]), "reliability")


def open_cells(m):
    from ..operators.decisions import open_demand
    return open_demand(m)


def register(cat) -> None:
    cat.add("suppliers_at_risk", lambda m: rk.at_risk_suppliers(m.staged), ssql("""
        SELECT e.*, coalesce(affected_orders, 0) affected_orders
        FROM (SELECT * FROM enriched ORDER BY impact_score DESC, supplier_id LIMIT 20) e LEFT JOIN touched t ON t.supplier_id = e.supplier_id
        """).replace("e.*", "e.supplier_id, e.name AS name, impact_score, confidence, risk_category, scoring_method, model_version, architecture"))
    cat.add("supplier_signals", lambda m: m.supplier_signals, ora("SELECT * FROM supplier_signals"))
    cat.add("weighted_formula", lambda m: rk.weighted_formula(m.supplier_signals).select("supplier_id", "impact_score"), ora("""
        SELECT supplier_id, round(0.3 * supplier_risk + 0.25 * delay_risk + 0.2 * inventory_risk + 0.15 * demand_risk
          + 0.1 * financial_risk, 6) impact_score FROM supplier_signals"""))
    cat.add("redistribute_weights", lambda m: rk.redistribute_weights(m.supplier_signals).select("supplier_id", "impact_score"),
            ssql("SELECT * FROM formula"))
    cat.add("native_impact", lambda m: rk.native_impact(m.scores, "delay_probability", "shortage_risk").select(
        "score_id", "native_score"), ora("""
        SELECT score_id, round(0.6 * delay_probability + 0.4 * shortage_risk, 6) native_score FROM scores"""))
    cat.add("confidence", lambda m: rk.confidence(m.scores.select("score_id", "delay_probability"), "delay_probability"), ora("""
        SELECT score_id, delay_probability, round(least(1, abs(delay_probability - 0.5) * 2), 6) confidence FROM scores"""))
    cat.add("categorize", lambda m: rk.categorize(m.scores.select("score_id", "delay_probability"), "delay_probability"), ora(f"""
        SELECT score_id, delay_probability, {CAT.format('delay_probability')} risk_category FROM scores"""))
    cat.add("enrich", lambda m: rk.enrich(m.supplier_signals), ora("SELECT * FROM enriched"))
    cat.add("latest_score", lambda m: rk.latest_score(m.scores), ora("SELECT * FROM latest"))
    cat.add("formula_breakdown", lambda m: rk.formula_breakdown(m.supplier_signals, "supplier_id"), ora("\nUNION ALL\n".join(
        f"SELECT supplier_id, '{n}' signal, {w}::DOUBLE weight, {n} AS value, round({n} * {w}, 6) contribution FROM supplier_signals"
        for n, w in fx.RISK_WEIGHTS.items())))
    cat.add("confidence_coverage", lambda m: rk.confidence_coverage(rk.confidence(m.scores, "delay_probability")),
            "SELECT count(*) n, 1.0::DOUBLE coverage FROM events")
    cat.add("attribution", component_attribution, ssql("SELECT * FROM attr"))
    cat.add("explanation_record", lambda m: rk.explanation_record(component_attribution(m), "supplier", "component", "SUPPLIES"))
    def nodes(m):
        rec = rk.explanation_record(component_attribution(m), "supplier", "component", "SUPPLIES")
        both = F.explode(F.arrays_zip("nodes", "edges")).alias("x")
        return rec.select("entity_type", "entity_id", both).select(
            "entity_type", "entity_id", F.col("x.nodes.entity_id").alias("node_id"), F.col("x.edges.target").alias("target"),
            F.col("x.nodes.contribution_weight").alias("weight"))
    cat.add("explanation_record_nodes", nodes, ssql("""
        SELECT 'component' entity_type, dst entity_id, src node_id, dst target, weight FROM attr"""))
    cat.add("explanation_coverage", lambda m: rk.explanation_coverage(
        vw.current_scores(m.scores).select("score_id", "entity_type", "entity_id", "risk_category"),
        m.audit_log.filter(F.col("event_type").isin("click", "view")).select(F.col("audit_id").alias("score_id"))), ssql("""
        SELECT score_id, entity_type, entity_id, risk_category FROM current_scores WHERE risk_category IN ('high', 'critical')
          AND score_id NOT IN (SELECT event_id FROM events WHERE event_type IN ('click', 'view'))"""))
    cat.add("explanations_containing", lambda m: rk.explanations_containing(
        rk.explanation_record(component_attribution(m), "supplier", "component", "SUPPLIES"), "5"), ora("""
        SELECT DISTINCT 'component' entity_type, CAST(component_id AS VARCHAR) entity_id FROM supplier_components WHERE supplier_id = 5"""))
    cat.add("method_divergence", lambda m: rk.method_divergence(m.supplier_signals), ssql("""
        SELECT supplier_id, native_score, impact_score formula_score, round(impact_score - native_score, 6) + 0.0 divergence
        FROM formula JOIN natives USING (supplier_id)"""))

    # -- dashboard ---------------------------------------------------------------------------
    cat.add("severity_tiles", lambda m: vw.severity_tiles(vw.current_scores(m.scores)), ssql("""
        SELECT coalesce(entity_type, 'all') entity_type, coalesce(risk_category, 'all') risk_category, count(*) n
        FROM current_scores GROUP BY ROLLUP (current_scores.entity_type, current_scores.risk_category)"""))
    cat.add("top_at_risk", lambda m: vw.top_at_risk(vw.current_scores(m.scores), "delay_probability", "entity_id", 10), ssql("""
        SELECT * FROM current_scores ORDER BY delay_probability DESC, entity_id LIMIT 10"""))
    cat.add("at_risk_table", lambda m: vw.at_risk_table(
        rk.enrich(m.supplier_signals), m.lines, vw.RiskFilter(("medium", "high", "critical"), 0.3, ("weighted_formula",))), ssql("""
        SELECT e.supplier_id, e.name AS name, impact_score, confidence, risk_category, scoring_method, model_version, architecture,
          coalesce(affected_orders, 0) affected_orders
        FROM enriched e LEFT JOIN touched t ON t.supplier_id = e.supplier_id
        WHERE risk_category IN ('medium', 'high', 'critical') AND impact_score >= 0.3 AND scoring_method = 'weighted_formula'"""))
    cat.add("list_entities", lambda m: vw.list_entities(
        rk.enrich(m.supplier_signals), ["name"], ["medium", "high"], "R#00000000").select(
        "supplier_id", "name", "risk_category", "impact_score"), ora("""
        SELECT supplier_id, name AS name, risk_category, impact_score FROM enriched
        WHERE risk_category IN ('medium', 'high') AND lower(name) LIKE '%r#00000000%'"""))
    cat.add("entity_detail", lambda m: vw.entity_detail(
        m.staged.suppliers, "supplier_id", {
            "components": (m.staged.supplier_components.join(m.components, "component_id"), "component_id"),
            "shipments": (m.staged.shipments.select("supplier_id", "shipment_id", "status", "eta"), "shipment_id")},
        rk.enrich(m.supplier_signals).drop("name")))
    cat.add("entity_detail_sizes", lambda m: vw.entity_detail(
        m.raw("supplier").select(F.col("s_suppkey").alias("supplier_id")), "supplier_id", {
            "components": (m.supplier_components, "component_id"),
            "shipments": (m.shipments.select("supplier_id", "shipment_id", "status"), "shipment_id")},
        rk.reliability_now(m.shipments)).groupBy("supplier_id", "relation", "reliability").agg(
        F.sum(F.size("rows")).alias("n")), ora("""
        SELECT supplier_id, 'components' relation, reliability, count(*) n FROM supplier_components JOIN reliability_now USING (supplier_id) GROUP BY 1, 2, 3
        UNION ALL SELECT supplier_id, 'shipments', reliability, count(*) FROM shipments JOIN reliability_now USING (supplier_id) GROUP BY 1, 2, 3"""))
    cat.add("score_trend", lambda m: vw.score_trend(m.scores, "supplier", 8, "2024-01-05", "2024-01-20"), ora("""
        SELECT * FROM scores WHERE entity_type = 'supplier' AND entity_id = 8 AND scored_at >= TIMESTAMP '2024-01-05'
          AND scored_at < TIMESTAMP '2024-01-20'"""))
    cat.add("compare_trends", lambda m: vw.compare_trends(m.scores, [4, 8, 12], "delay_probability"), ora("""
        SELECT CAST(scored_at AS DATE) AS day, round(avg(delay_probability) FILTER (entity_id = 4), 6) entity_4,
          round(avg(delay_probability) FILTER (entity_id = 8), 6) entity_8, round(avg(delay_probability) FILTER (entity_id = 12), 6) entity_12
        FROM scores WHERE entity_id IN (4, 8, 12) GROUP BY 1"""))
    cat.add("worsening", lambda m: vw.worsening(m.scores, "delay_probability", 2), ora("""
        SELECT entity_type, entity_id, round(regr_slope(v, x), 6) + 0.0 slope, count(*) n_weeks, coalesce(arg_max(streak, wk), false) still_rising FROM (
          SELECT *, coalesce(sum(rise) OVER l = 2 AND count(rise) OVER l = 2, false) streak FROM (
            SELECT *, (wk - DATE '2024-01-01') / 7.0 x, CAST(v > lag(v) OVER (PARTITION BY entity_type, entity_id ORDER BY wk) AS INT) rise FROM (
              SELECT entity_type, entity_id, CAST(date_trunc('week', scored_at) AS DATE) wk, round(avg(delay_probability), 9) v
              FROM scores GROUP BY 1, 2, 3))
          WINDOW l AS (PARTITION BY entity_type, entity_id ORDER BY wk ROWS BETWEEN 1 PRECEDING AND CURRENT ROW))
        GROUP BY 1, 2"""))
    cat.add("activity_feed", lambda m: vw.activity_feed({
        "audit": (m.audit_log, "audit_id", "created_at"), "execution": (m.action_log, "log_id", "executed_at"),
        "request": (m.requests, "request_id", "created_at")}, 25), ora("""
        SELECT * FROM (SELECT 'audit' AS source, audit_id row_id, created_at happened_at FROM audit_log
          UNION ALL SELECT 'execution', log_id, executed_at FROM action_log UNION ALL SELECT 'request', request_id, created_at FROM requests)
        ORDER BY happened_at DESC, source, row_id DESC LIMIT 25"""))
    cat.add("inventory_view", lambda m: vw.inventory_view(ft.inventory_risk(m.inventory), 0.2, 0.9), ora("""
        SELECT product_id, warehouse_id, stock_level, reorder_threshold, inventory_risk FROM cell_risk
        WHERE inventory_risk BETWEEN 0.2 AND 0.9"""))
    cat.add("shipment_list", lambda m: vw.shipment_list(m.routed, m.factories, m.warehouses, ["delayed", "in_transit"], None), ora("""
        SELECT shipment_id, order_id, supplier_id, status, eta, f.n_name origin, w.n_name destination
        FROM routed JOIN nation f ON f.n_nationkey = factory_id JOIN nation w ON w.n_nationkey = warehouse_id
        WHERE status IN ('delayed', 'in_transit')"""))
    cat.add("warehouse_view", lambda m: vw.warehouse_view(m.warehouses, m.inventory, open_cells(m)), ora("""
        SELECT w.warehouse_id, w.location AS location, w.capacity_units, stock, n_products, open_units,
          round(stock / nullif(w.capacity_units, 0), 6) capacity_use FROM warehouses w
        LEFT JOIN (SELECT warehouse_id, CAST(sum(stock_level) AS BIGINT) stock, count(*) n_products FROM inventory GROUP BY 1) i
          ON i.warehouse_id = w.warehouse_id
        LEFT JOIN (SELECT warehouse_id, CAST(sum(demand) AS BIGINT) open_units FROM cells_open GROUP BY 1) o ON o.warehouse_id = w.warehouse_id"""))
    cat.add("product_view", lambda m: vw.product_view(m.products, m.product_components, m.inventory, m.items), ora("""
        SELECT p.product_id, p.category, n_components, units_required, stock, short_cells, n_orders FROM products p
        LEFT JOIN (SELECT p_brand, count(*) n_components, CAST(sum(p_size) AS BIGINT) units_required FROM part GROUP BY 1) b ON b.p_brand = p.product_id
        LEFT JOIN (SELECT product_id, CAST(sum(stock_level) AS BIGINT) stock, count(*) FILTER (stock_level < reorder_threshold) short_cells
          FROM inventory GROUP BY 1) i ON i.product_id = p.product_id
        LEFT JOIN (SELECT product_id, count(DISTINCT order_id) n_orders FROM items GROUP BY 1) o ON o.product_id = p.product_id"""))
    cat.add("audit_view", lambda m: vw.audit_view(m.audit_log, "2024-01-10", "2024-01-20", ["login_failed", "action_executed"]), ora("""
        SELECT * FROM audit_log WHERE created_at >= TIMESTAMP '2024-01-10' AND created_at < TIMESTAMP '2024-01-20'
          AND event_type IN ('login_failed', 'action_executed')"""))
    cat.add("audit_counts", lambda m: vw.audit_counts(m.audit_log), ora(
        "SELECT event_type, count(*) n, max(created_at) last_at FROM audit_log GROUP BY 1"))
    cat.add("customers_by_tier", lambda m: vw.customers_by_tier(m.customers, m.orders), ora("""
        SELECT priority_tier, count(*) n_customers, CAST(coalesce(sum(n), 0) AS BIGINT) n_orders, CAST(coalesce(sum(o), 0) AS BIGINT) n_open,
          CAST(sum(v) AS DOUBLE) total_value FROM customers c LEFT JOIN (
            SELECT customer_id, count(*) n, sum(CAST(order_value AS DECIMAL(18,2))) v, count(*) FILTER (status = 'open') o FROM ord GROUP BY 1) x
          ON x.customer_id = c.customer_id GROUP BY 1"""))
