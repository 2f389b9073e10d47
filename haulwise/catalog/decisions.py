"""Alert, approval, decision and scenario queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import alerts as al, decisions as dc, features as ft, graph as g, quality as q, risk as rk
from .ctes import ora
from .scoring import CAT

EXTRA = {
    "thr": "SELECT * FROM (VALUES " + ", ".join(
        f"({i}::INTEGER, '{t}', '{mt}', {v}::DOUBLE)" for i, t, mt, v in al.DEFAULT_THRESHOLDS) + ") t(threshold_id, entity_type, metric, threshold_value)",
    "metric_rows": "\nUNION ALL\n".join(
        f"SELECT score_id, entity_type, entity_id, scored_at, '{mt}' metric, {mt} metric_value FROM scores" for mt in al.METRICS),
    "breaches": f"""SELECT score_id, threshold_id, r.entity_type, entity_id, r.metric, metric_value, {CAT.format('metric_value')} severity
        FROM metric_rows r JOIN thr ON thr.entity_type = r.entity_type AND thr.metric = r.metric AND metric_value >= threshold_value""",
    "valued": """
        SELECT order_id, product_id, warehouse_id, customer_id, priority_tier, sla_days, penalty_pct, order_value, placed_at, quantity,
          round(CASE priority_tier WHEN 'strategic' THEN 3.0 WHEN 'standard' THEN 2.0 ELSE 1.0 END + order_value / 500000.0::DOUBLE
            + 7.0::DOUBLE / sla_days + penalty_pct * 10, 6) customer_value FROM (
          SELECT i.order_id, i.product_id, c.warehouse_id, o.customer_id, c.priority_tier, c.sla_days, c.penalty_pct, o.order_value, o.placed_at,
            CAST(sum(i.quantity) AS BIGINT) quantity
          FROM items i JOIN ord o ON o.order_id = i.order_id AND o.status = 'open' JOIN customers c ON c.customer_id = o.customer_id
          WHERE o.placed_at > (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 365 GROUP BY ALL)""",
    "granted": """
        SELECT product_id, warehouse_id, order_id, quantity, customer_value, capacity,
          CAST(greatest(0, least(quantity, capacity - (run - quantity))) AS BIGINT) granted FROM (
          SELECT v.*, stock_level capacity, sum(quantity) OVER (PARTITION BY v.product_id, v.warehouse_id
            ORDER BY customer_value IS NULL, -customer_value, CASE WHEN customer_value IS NULL THEN placed_at END, order_id
            ROWS UNBOUNDED PRECEDING) run
          FROM valued v JOIN inventory i ON i.product_id = v.product_id AND i.warehouse_id = v.warehouse_id)""",
    "per_product": """
        SELECT p.product_id, stock, supplier_capacity, lead_time_days, warehouse_capacity, production_capacity FROM products p
        LEFT JOIN (SELECT product_id, CAST(sum(stock_level) AS BIGINT) stock FROM inventory GROUP BY 1) a ON a.product_id = p.product_id
        LEFT JOIN (SELECT product_id, CAST(sum(CAST(capacity_score AS DECIMAL(18,3))) AS DOUBLE) supplier_capacity, min(lead_time_days) lead_time_days
          FROM (SELECT DISTINCT product_id, supplier_id FROM items) JOIN suppliers USING (supplier_id) GROUP BY 1) b ON b.product_id = p.product_id
        LEFT JOIN (SELECT product_id, CAST(sum(capacity_units) AS BIGINT) warehouse_capacity FROM inventory JOIN warehouses USING (warehouse_id)
          GROUP BY 1) c ON c.product_id = p.product_id
        LEFT JOIN (SELECT product_id, CAST(sum(capacity_units_per_day) AS BIGINT) production_capacity FROM (SELECT DISTINCT product_id, factory_id FROM routed)
          JOIN factories USING (factory_id) GROUP BY 1) d ON d.product_id = p.product_id""",
    "limits": """
        SELECT i.product_id, i.warehouse_id, stock_level inventory, capacity_units warehouse_capacity, supplier_capacity,
          production_capacity * 30 production_capacity, lead_time_days
        FROM inventory i LEFT JOIN warehouses w ON w.warehouse_id = i.warehouse_id LEFT JOIN per_product p ON p.product_id = i.product_id""",
    "missing": """
        SELECT v.*, inventory, warehouse_capacity, supplier_capacity, production_capacity, lead_time_days,
          CASE WHEN inventory IS NULL THEN 'no inventory' WHEN warehouse_capacity IS NULL THEN 'no warehouse_capacity'
            WHEN supplier_capacity IS NULL THEN 'no supplier_capacity' WHEN production_capacity IS NULL THEN 'no production_capacity'
            WHEN lead_time_days IS NULL THEN 'no lead_time_days' END missing
        FROM valued v LEFT JOIN limits l ON l.product_id = v.product_id AND l.warehouse_id = v.warehouse_id""",
    "in_cell": """
        SELECT *, CAST(greatest(0, least(wanted, least(inventory, warehouse_capacity) - (run - wanted))) AS BIGINT) take FROM (
          SELECT *, sum(wanted) OVER (PARTITION BY product_id, warehouse_id ORDER BY customer_value IS NULL, -customer_value,
            CASE WHEN customer_value IS NULL THEN placed_at END, order_id ROWS UNBOUNDED PRECEDING) run FROM (
            SELECT *, CASE WHEN missing IS NULL AND NOT late THEN quantity ELSE 0 END wanted FROM (
              SELECT *, coalesce(lead_time_days > coalesce(sla_days, 60), false) late FROM missing)))""",
    "nested": """
        SELECT *, coalesce(missing, CASE WHEN late THEN 'lead time exceeds the agreed days' WHEN granted = quantity THEN NULL
            WHEN granted < coalesce(take, 0) THEN 'product capacity used up' ELSE 'cell capacity used up' END) reason FROM (
          SELECT *, CAST(coalesce(greatest(0, least(t, floor(least(supplier_capacity, production_capacity)) - (run2 - t))), 0) AS BIGINT) granted FROM (
            SELECT *, coalesce(take, 0) t, sum(coalesce(take, 0)) OVER (PARTITION BY product_id ORDER BY customer_value IS NULL, -customer_value,
              CASE WHEN customer_value IS NULL THEN placed_at END, order_id, warehouse_id ROWS UNBOUNDED PRECEDING) run2 FROM in_cell))""",
    "monthly": """
        SELECT product_id, warehouse_id, date_trunc('month', ship_date) mon, sum(quantity) quantity FROM routed GROUP BY 1, 2, 3""",
    "lead": """
        SELECT product_id, round(avg(lead_time_days) / 30.0, 6) lead_months FROM (SELECT DISTINCT product_id, supplier_id FROM items)
        JOIN suppliers USING (supplier_id) GROUP BY 1""",
    "need": "SELECT product_id, CAST(sum(demand) AS BIGINT) required_qty FROM cells_open GROUP BY 1",
    "offers": """
        SELECT x.product_id, x.supplier_id, lead_time_days, capacity FROM (
          SELECT product_id, supplier_id, CAST(sum(quantity) AS BIGINT) capacity FROM items
          WHERE CAST(ship_date AS DATE) > (SELECT d FROM snap) - 720 GROUP BY 1, 2) x JOIN suppliers s ON s.supplier_id = x.supplier_id""",
    "feasible": """
        SELECT n.product_id, required_qty, CAST(coalesce(t, 0) AS BIGINT) total_capacity, coalesce(t >= required_qty, false) optimal,
          CASE WHEN NOT coalesce(t >= required_qty, false) THEN 'capacity below required quantity' END reason
        FROM need n LEFT JOIN (SELECT product_id, sum(capacity) t FROM offers GROUP BY 1) o ON o.product_id = n.product_id""",
    "base_scores": """
        SELECT supplier_id, round((coalesce(0.3 * supplier_risk, 0) + coalesce(0.25 * delay_risk, 0) + coalesce(0.2 * inventory_risk, 0)
            + coalesce(0.15 * demand_risk, 0) + coalesce(0.1 * financial_risk, 0))
          / nullif(CASE WHEN supplier_risk IS NULL THEN 0 ELSE 0.3 END + CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.25 END
            + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.2 END + CASE WHEN demand_risk IS NULL THEN 0 ELSE 0.15 END
            + CASE WHEN financial_risk IS NULL THEN 0 ELSE 0.1 END, 0), 6) score FROM supplier_signals""",
    "scenario": """
        SELECT supplier_id, supplier_risk,
          CASE WHEN supplier_id % 3 = 0 AND s_acctbal < 8000 THEN least(1, round(delay_risk * 2, 6)) ELSE delay_risk END delay_risk,
          inventory_risk, CASE WHEN supplier_id % 3 = 0 AND s_acctbal < 8000 THEN 0.9::DOUBLE ELSE demand_risk END demand_risk, financial_risk
        FROM supplier_signals JOIN supplier ON s_suppkey = supplier_id""",
    "rescored": f"""
        SELECT b.supplier_id, b.score base_score, {CAT.format('b.score')} base_category, s.score simulated_score,
          {CAT.format('s.score')} simulated_category, round(s.score - b.score, 6) + 0.0 change
        FROM base_scores b JOIN sim_scores s ON s.supplier_id = b.supplier_id""",
}
EXTRA["sim_scores"] = EXTRA["base_scores"].replace("FROM supplier_signals", "FROM scenario")


def dsql(sql: str) -> str:
    return ora(sql, EXTRA)


def owners(spark):
    return F.broadcast(spark.createDataFrame([
        ("supplier", "email", "procurement"), ("supplier", "slack", "buyers"), ("product", "email", "planning"),
        ("order", "slack", "sales"), ("shipment", "slack", "logistics")], "entity_type string, channel string, recipient string"))


def breaches(m):
    return al.evaluate_thresholds(m.scores, al.thresholds(m.spark))


def valued(m):
    return dc.customer_value(dc.open_order_lines(m))


def caps(m):
    return m.inventory.select("product_id", "warehouse_id", F.col("stock_level").alias("capacity"))


def granted(m):
    return dc.allocate(dc.fifo_fallback(valued(m)), caps(m), ["product_id", "warehouse_id"]).select(
        "product_id", "warehouse_id", "order_id", "quantity", "customer_value", "capacity", "granted")


def nested(m):
    return dc.allocate_nested(dc.fifo_fallback(valued(m)), dc.nested_limits(m.staged))


def need(m):
    return dc.open_demand(m).groupBy("product_id").agg(F.sum("demand").alias("required_qty"))


def offers(m):
    recent = m.items.filter(F.col("ship_date").cast("date") > F.date_sub(m.as_of.cast("date"), 720))
    cap = recent.groupBy("product_id", "supplier_id").agg(F.sum("quantity").alias("capacity"))
    return cap.join(m.suppliers.select("supplier_id", "lead_time_days"), "supplier_id").select(
        "product_id", "supplier_id", "lead_time_days", "capacity")


def overrides(m):
    """Every third supplier: doubled delay risk and high demand; rich ones get an invalid value."""
    delay = m.supplier_signals.select("supplier_id", "delay_risk").join(
        m.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"), "s_acctbal"), "supplier_id")
    return delay.filter(F.col("supplier_id") % 3 == 0).select("supplier_id", F.map_filter(F.create_map(
        F.lit("delay_risk"), F.least(F.lit(1.0), fx.r6(F.col("delay_risk") * 2)),
        F.lit("demand_risk"), F.when(F.col("s_acctbal") < 8000, 0.9).otherwise(-0.5)), lambda k, v: v.isNotNull()).alias("overrides"))


def rescored(m):
    return dc.rescore(m.supplier_signals, dc.apply_overrides(m.supplier_signals, overrides(m)))


def moves_sql(table: str, key: str, moves, first: str) -> str:
    pairs = " OR ".join(f"(p = '{a}' AND status = '{b}')" for a, b in moves)
    return ora(f"""
        SELECT change_id, {key}, p previous_status, status, changed_at FROM (
          SELECT *, lag(status) OVER (PARTITION BY {key} ORDER BY changed_at, change_id) p FROM {table})
        WHERE NOT coalesce((p IS NULL AND status = '{first}') OR {pairs}, false)""")


def register(cat) -> None:
    # -- alerts ------------------------------------------------------------------------------
    cat.add("evaluate_thresholds", breaches, dsql("SELECT * FROM breaches"))
    cat.add("threshold_crossings", lambda m: al.threshold_crossings(m.scores, al.thresholds(m.spark)), dsql("""
        SELECT score_id, threshold_id, r.entity_type, entity_id, r.metric, metric_value FROM (
          SELECT *, lag(metric_value) OVER (PARTITION BY entity_type, entity_id, metric ORDER BY scored_at, score_id) pv FROM metric_rows) r
        JOIN thr ON thr.entity_type = r.entity_type AND thr.metric = r.metric
        WHERE metric_value >= threshold_value AND coalesce(pv, -1) < threshold_value"""))
    cat.add("severity", lambda m: al.severity(m.scores.select("score_id", "impact_score"), "impact_score"), ora(f"""
        SELECT score_id, impact_score, {CAT.format('impact_score')} severity FROM scores"""))
    cat.add("new_alerts", lambda m: al.new_alerts(
        breaches(m).unionByName(breaches(m)), breaches(m).filter(F.col("score_id") % 4 == 0)), dsql("""
        SELECT * FROM breaches WHERE score_id % 4 <> 0"""))
    cat.add("threshold_sweep", lambda m: al.threshold_sweep(
        m.scores.withColumn("late", F.col("shortage_risk") >= 0.5), "delay_probability", "late", [0.3, 0.5, 0.7, 0.9]), ora("""
        SELECT CAST(t AS DOUBLE) threshold_value, count(*) n_alerts, count(*) FILTER (shortage_risk >= 0.5) n_true,
          round(1 - count(*) FILTER (shortage_risk >= 0.5) / count(*)::DOUBLE, 6) false_positive_rate
        FROM scores, (VALUES (0.3), (0.5), (0.7), (0.9)) g(t) WHERE delay_probability >= t::DOUBLE GROUP BY 1"""))
    cat.add("notification_records", lambda m: al.delivery_summary(
        al.notification_records(breaches(m), owners(m.spark)).withColumn(
            "status", F.when(F.col("score_id") % 10 == 0, "failed").otherwise("delivered"))), dsql("""
        SELECT channel, CASE WHEN score_id % 10 = 0 THEN 'failed' ELSE 'delivered' END status, count(*) n FROM breaches JOIN (VALUES
          ('supplier', 'email'), ('supplier', 'slack'), ('product', 'email'), ('order', 'slack'), ('shipment', 'slack')) o(t, channel)
          ON o.t = entity_type GROUP BY 1, 2"""))
    cat.add("illegal_transitions", lambda m: al.illegal_moves(m.request_history, "request_id", al.REQUEST_MOVES, "pending"),
            moves_sql("request_history", "request_id", al.REQUEST_MOVES, "pending"))
    cat.add("registry_transitions", lambda m: al.illegal_moves(m.registry_history, "model_version", al.REGISTRY_MOVES, "training"),
            moves_sql("registry_history", "model_version", al.REGISTRY_MOVES, "training"))
    cat.add("executed_without_approval", lambda m: al.executed_without_approval(m.requests, m.action_log), ora("""
        SELECT * FROM action_log WHERE request_id NOT IN (SELECT request_id FROM requests WHERE status = 'approved')"""))
    cat.add("missing_decision_trace", lambda m: al.missing_decision_trace(m.requests), ora("""
        SELECT * FROM requests WHERE status <> 'pending' AND decision_trace IS NULL"""))
    cat.add("missing_reject_reason", lambda m: al.missing_reject_reason(m.requests), ora("""
        SELECT * FROM requests WHERE status = 'rejected' AND trim(coalesce(rejection_reason, '')) = ''"""))
    cat.add("execution_rates", lambda m: al.execution_rates(m.action_log), ora("""
        SELECT target_system, count(*) n, count(*) FILTER (status = 'success') n_success,
          round(count(*) FILTER (status = 'success') / count(*)::DOUBLE, 6) success_rate FROM action_log GROUP BY 1"""))
    cat.add("double_decisions", lambda m: al.double_decisions(m.request_history), ora("""
        SELECT change_id, request_id, status, changed_at, first_change_id FROM (
          SELECT *, row_number() OVER w rn, first_value(change_id) OVER w first_change_id FROM request_history
          WHERE status IN ('approved', 'rejected') WINDOW w AS (PARTITION BY request_id ORDER BY changed_at, change_id)) WHERE rn > 1"""))
    cat.add("lockouts", lambda m: al.lockouts(m.audit_log, 5), ora("""
        SELECT actor_id, audit_id, created_at FROM (
          SELECT *, row_number() OVER (PARTITION BY actor_id, island ORDER BY created_at, audit_id) pos FROM (
            SELECT *, sum(CAST(event_type = 'login_success' AS INT)) OVER (PARTITION BY actor_id ORDER BY created_at, audit_id) island
            FROM audit_log WHERE event_type IN ('login_failed', 'login_success')) WHERE event_type = 'login_failed') WHERE pos = 5"""))
    cat.add("rate_breaches", lambda m: al.rate_breaches(m.audit_log, "actor_id", "created_at", 1), ora("""
        SELECT actor_id, date_trunc('minute', created_at) window_start, count(*) n FROM audit_log GROUP BY 1, 2 HAVING count(*) > 1"""))
    cat.add("eligible_actions", lambda m: al.eligible_actions(m.requests), ora("""
        SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY created_at DESC, request_id DESC) rn
        FROM requests WHERE status = 'approved') WHERE rn = 1"""))
    cat.add("false_positive_rate", lambda m: al.false_positive_rate(
        breaches(m), m.audit_log.filter(F.col("event_type") == "login_failed").select(F.col("audit_id").alias("score_id")), ["score_id"]), dsql("""
        SELECT severity, count(*) n_alerts, round(avg(CASE WHEN event_type = 'error' THEN 0.0 ELSE 1.0 END), 6) false_positive_rate
        FROM breaches JOIN events ON event_id = score_id GROUP BY 1"""))

    # -- decisions ---------------------------------------------------------------------------
    kind = lambda: F.when(F.col("source") == "1-URGENT", "customer_allocation").when(F.col("source") == "2-HIGH", "po_split").when(
        F.col("source") == "3-MEDIUM", "safety_stock").otherwise("alternative_supplier")
    cat.add("route", lambda m: dc.route(m.requests.select("request_id", kind().alias("decision_type"))), ora("""
        SELECT *, CASE WHEN decision_type = 'alternative_supplier' THEN 'llm' ELSE 'optimizer' END routed_to FROM (
          SELECT request_id, CASE "source" WHEN '1-URGENT' THEN 'customer_allocation' WHEN '2-HIGH' THEN 'po_split'
            WHEN '3-MEDIUM' THEN 'safety_stock' ELSE 'alternative_supplier' END decision_type FROM requests)"""))
    cat.add("assemble_constraints", lambda m: dc.assemble_constraints(m.staged), dsql("SELECT * FROM per_product"))
    cat.add("validate_policy", lambda m: dc.validate_policy(m.suppliers, {
        "inactive": ~F.col("is_active"), "slow": F.col("lead_time_days") > 28, "small": F.col("capacity_score") < 12}).select(
        "supplier_id", "broken_rules", "is_eligible"), ora("""
        SELECT supplier_id, broken_rules, broken_rules = '' is_eligible FROM (SELECT supplier_id, concat_ws(',',
          CASE WHEN NOT is_active THEN 'inactive' END, CASE WHEN lead_time_days > 28 THEN 'slow' END,
          CASE WHEN capacity_score < 12 THEN 'small' END) broken_rules FROM suppliers)"""))

    def trace(m):
        base = rk.enrich(m.supplier_signals)
        ok = dc.validate_policy(m.suppliers, {"inactive": ~F.col("is_active")}).select("supplier_id", "is_eligible")
        df = base.join(ok, "supplier_id").withColumns({
            "decision_type": F.when(F.col("supplier_id") % 2 == 0, "po_split").otherwise("alternative_supplier"),
            "objective_value": F.col("impact_score"), "optimal": F.lit(True)})
        return dc.decision_trace(dc.route(df)).select("supplier_id", "decision_trace")
    cat.add("decision_trace", trace)
    part = lambda path: F.get_json_object("decision_trace", path)
    cat.add("decision_trace_parts", lambda m: trace(m).select(
        "supplier_id", part("$.risk_intelligence.risk_category").alias("risk_category"),
        part("$.decision_intelligence.routed_to").alias("routed_to"),
        part("$.decision_intelligence.policy_checks_passed").alias("policy_checks_passed"),
        part("$.optimization.optimal").alias("optimal"), part("$.llm.kind").alias("kind")), ora("""
        SELECT e.supplier_id, risk_category, CASE WHEN e.supplier_id % 2 = 0 THEN 'optimizer' ELSE 'llm' END routed_to,
          CASE WHEN s_acctbal >= 0 THEN 'true' ELSE 'false' END policy_checks_passed, CASE WHEN e.supplier_id % 2 = 0 THEN 'true' END optimal,
          CASE WHEN e.supplier_id % 2 = 1 THEN 'qualitative' END kind FROM enriched e JOIN supplier ON s_suppkey = e.supplier_id"""))
    cat.add("shortages", lambda m: dc.shortages(m.inventory, dc.open_demand(m)), ora("""
        SELECT i.product_id, i.warehouse_id, stock_level, open_orders, demand FROM inventory i JOIN cells_open c
          ON c.product_id = i.product_id AND c.warehouse_id = i.warehouse_id WHERE open_orders >= 2 AND demand > stock_level"""))
    cat.add("customer_value", lambda m: valued(m).select("order_id", "product_id", "warehouse_id", "quantity", "customer_value"), dsql(
        "SELECT order_id, product_id, warehouse_id, quantity, customer_value FROM valued"))
    cat.add("allocate", granted, dsql("SELECT * FROM granted"))
    cat.add("allocate_nested", lambda m: nested(m).select(
        "order_id", "product_id", "warehouse_id", "quantity", "granted", "reason"), dsql(
        "SELECT order_id, product_id, warehouse_id, quantity, granted, reason FROM nested"))
    cat.add("allocation_result", lambda m: dc.allocation_result(nested(m)).select("*", "constraints_applied.*").drop("constraints_applied"), dsql("""
        SELECT n.product_id, CAST(sum(quantity) AS BIGINT) requested, CASE WHEN max(missing) IS NULL THEN CAST(sum(granted) AS BIGINT) END granted,
          CASE WHEN max(missing) IS NULL THEN round(coalesce(sum(granted * customer_value), 0), 6) + 0.0 END objective_value,
          max(missing) IS NULL optimal, max(missing) reason, count(*) FILTER (reason = 'lead time exceeds the agreed days') too_late,
          any_value(si) inventory, any_value(sw) warehouse_capacity, max(supplier_capacity) supplier_capacity,
          CAST(max(production_capacity) AS BIGINT) production_capacity, max(lead_time_days) lead_time_days
        FROM nested n JOIN (SELECT product_id, CAST(sum(inventory) AS BIGINT) si, CAST(sum(warehouse_capacity) AS BIGINT) sw FROM (
          SELECT DISTINCT product_id, warehouse_id, inventory, warehouse_capacity FROM nested) GROUP BY 1) s ON s.product_id = n.product_id
        GROUP BY n.product_id"""))
    cat.add("fifo_fallback", lambda m: dc.allocate(
        dc.fifo_fallback(valued(m).filter(F.col("customer_value").isNull())), caps(m), ["product_id", "warehouse_id"]).select(
        "order_id", "product_id", "warehouse_id", "placed_at", "quantity", "granted"), dsql("""
        SELECT order_id, product_id, warehouse_id, placed_at, quantity, CAST(greatest(0, least(quantity, stock_level - (run - quantity))) AS BIGINT) granted
        FROM (SELECT v.*, stock_level, sum(quantity) OVER (PARTITION BY v.product_id, v.warehouse_id ORDER BY placed_at, order_id ROWS UNBOUNDED PRECEDING) run
          FROM valued v JOIN inventory i ON i.product_id = v.product_id AND i.warehouse_id = v.warehouse_id WHERE customer_value IS NULL)"""))
    cat.add("check_adjustment", lambda m: dc.check_adjustment(
        granted(m).withColumn("adjusted", F.col("granted") + F.when(F.col("order_id") % 3 == 0, 1).otherwise(0)), caps(m),
        ["product_id", "warehouse_id"]), dsql("""
        SELECT product_id, warehouse_id, CAST(sum(granted + CAST(order_id % 3 = 0 AS INT)) AS BIGINT) adjusted_total, capacity
        FROM granted GROUP BY product_id, warehouse_id, capacity HAVING sum(granted + CAST(order_id % 3 = 0 AS INT)) > capacity"""))

    def stock(m):
        demand = m.routed.groupBy("product_id", "warehouse_id", F.trunc("ship_date", "month").alias("mon")).agg(F.sum("quantity").alias("quantity"))
        lead = m.items.select("product_id", "supplier_id").distinct().join(
            m.suppliers.select("supplier_id", "lead_time_days"), "supplier_id").groupBy("product_id").agg(
            fx.r6(F.avg("lead_time_days") / 30).alias("lead_months"))
        limits = m.warehouses.select("warehouse_id", (F.col("capacity_units") / 700.0).alias("capacity"))
        return dc.safety_stock(demand, lead, limits)
    cat.add("safety_stock", stock, dsql("""
        SELECT product_id, warehouse_id, lv <= capacity optimal, CASE WHEN lv <= capacity THEN lv END recommended_reorder_threshold,
          CASE WHEN NOT lv <= capacity THEN 'exceeds warehouse capacity' END reason FROM (
          SELECT s.product_id, s.warehouse_id, capacity_units / 700.0::DOUBLE capacity,
            CAST(ceil(round(lead_months * mu + 1.6448536269514715::DOUBLE * sqrt(lead_months) * sd, 6)) AS BIGINT) lv
          FROM (SELECT product_id, warehouse_id, avg(quantity) mu, coalesce(stddev_samp(quantity), 0) sd FROM monthly GROUP BY 1, 2) s
          JOIN lead l ON l.product_id = s.product_id JOIN warehouses w ON w.warehouse_id = s.warehouse_id)"""))
    cat.add("po_split", lambda m: dc.po_split(need(m), offers(m)), dsql("""
        SELECT product_id, supplier_id, lead_time_days, capacity, CAST(least(capacity, required_qty - (run - capacity)) AS BIGINT) qty FROM (
          SELECT o.*, required_qty, sum(capacity) OVER (PARTITION BY o.product_id ORDER BY lead_time_days, supplier_id ROWS UNBOUNDED PRECEDING) run
          FROM offers o JOIN feasible f ON f.product_id = o.product_id AND f.optimal) WHERE required_qty > run - capacity"""))
    cat.add("feasibility", lambda m: dc.feasibility(need(m), offers(m)), dsql("SELECT * FROM feasible"))

    # -- scenarios ---------------------------------------------------------------------------
    cat.add("apply_overrides", lambda m: dc.apply_overrides(m.supplier_signals, overrides(m)).drop("name"), dsql("SELECT * FROM scenario"))
    cat.add("rejected_overrides", lambda m: dc.rejected_overrides(overrides(m)).select("supplier_id"),
            "SELECT s_suppkey supplier_id FROM supplier WHERE s_suppkey % 3 = 0 AND s_acctbal >= 8000")
    cat.add("rescore", rescored, dsql("SELECT * FROM rescored"))
    cat.add("shifted_entities", lambda m: dc.shifted_entities(rescored(m)), dsql("SELECT * FROM rescored WHERE base_category <> simulated_category"))
    cat.add("scenario_distribution", lambda m: dc.scenario_distribution(m.supplier_signals, 200, 11), dsql("""
        SELECT supplier_id, round(list_sum(r) / 200, 6) mean_score, r[10] p05, r[100] p50, r[190] p95 FROM (
          SELECT supplier_id, list_sort(list(round(greatest(0, least(1, b * (1 + 0.2::DOUBLE * (2 * u - 1)))), 6))) r FROM (
            SELECT supplier_id, b, CAST('0x' || substr(md5('11|' || supplier_id || '|' || i), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE u
            FROM (SELECT supplier_id, (coalesce(0.3 * supplier_risk, 0) + coalesce(0.25 * delay_risk, 0) + coalesce(0.2 * inventory_risk, 0)
              + coalesce(0.15 * demand_risk, 0) + coalesce(0.1 * financial_risk, 0))
              / nullif(CASE WHEN supplier_risk IS NULL THEN 0 ELSE 0.3 END + CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.25 END
              + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.2 END + CASE WHEN demand_risk IS NULL THEN 0 ELSE 0.15 END
              + CASE WHEN financial_risk IS NULL THEN 0 ELSE 0.1 END, 0) b FROM supplier_signals), range(1, 201) t(i)) GROUP BY 1)"""))
    cat.add("snapshot_checksum", lambda m: dc.snapshot_checksum(
        g.build_edges(m, ["SUPPLIES", "PLACED_BY"]).select("edge_type", "src", "dst")), ora("""
        SELECT count(*) n, CAST(sum(CAST('0x' || substr(md5(edge_type || '|' || src || '|' || dst), 1, 8) AS BIGINT)) AS BIGINT) checksum FROM (
          SELECT 'SUPPLIES' edge_type, CAST(supplier_id AS VARCHAR) src, CAST(component_id AS VARCHAR) dst FROM supplier_components
          UNION ALL SELECT 'PLACED_BY', CAST(o_orderkey AS VARCHAR), CAST(o_custkey AS VARCHAR) FROM orders)"""))
