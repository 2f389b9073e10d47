"""The canonical tables once more as DuckDB CTEs, for the SQL cross-check."""

from __future__ import annotations

import re

CTES: dict[str, str] = {
    "lines": """
        SELECT order_id, line_no, ship_date, component_id, supplier_id, quantity, return_flag, line_status FROM (
          SELECT l_orderkey order_id, l_linenumber line_no, l_shipdate ship_date, l_partkey component_id,
                 l_suppkey supplier_id, CAST(l_quantity AS INTEGER) quantity, l_returnflag return_flag,
                 l_linestatus line_status,
                 row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey,
                   l_suppkey, CAST(l_quantity AS INTEGER), l_returnflag, l_linestatus) rn
          FROM lineitem) WHERE rn = 1""",
    "snap": "SELECT max(l_shipdate) ts, CAST(max(l_shipdate) AS DATE) d FROM lineitem",
    "items": "SELECT l.*, p_brand product_id FROM lines l JOIN part ON p_partkey = component_id",
    "shipments": """
        SELECT shipment_id, order_id, supplier_id, component_id, quantity, return_flag, ship_date, created_at, eta,
               CASE WHEN line_status = 'F' THEN ship_date END delivered_at,
               CASE WHEN line_status = 'F' AND ship_date > eta THEN 'delayed'
                    WHEN line_status = 'F' THEN 'delivered' ELSE 'in_transit' END status
        FROM (SELECT order_id * 10 + line_no shipment_id, order_id, supplier_id, component_id, quantity, return_flag,
                     line_status, CAST(ship_date AS DATE) ship_date,
                     CAST(ship_date AS DATE) - quantity created_at, CAST(ship_date AS DATE) - quantity + 30 eta
              FROM lines)""",
    "routed": """
        SELECT s.*, p_brand product_id, s_nationkey factory_id, c_nationkey warehouse_id
        FROM shipments s JOIN part ON p_partkey = component_id JOIN supplier ON s_suppkey = supplier_id
        JOIN orders ON o_orderkey = order_id JOIN customer ON c_custkey = o_custkey""",
    "suppliers": """
        SELECT s_suppkey supplier_id, s_name AS name, n_name country, s_acctbal acct_balance, s_acctbal >= 0 is_active,
               lead_time_days, capacity_score
        FROM supplier JOIN nation ON n_nationkey = s_nationkey
        LEFT JOIN (SELECT supplier_id, CAST(round(avg(quantity)) AS INTEGER) lead_time_days FROM (
            SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY ship_date DESC, shipment_id DESC) rn
            FROM shipments) WHERE rn <= 10 GROUP BY 1) lead ON lead.supplier_id = s_suppkey
        LEFT JOIN (SELECT supplier_id, round(sum(quantity) / 1000.0, 3) capacity_score FROM lines GROUP BY 1) cap
          ON cap.supplier_id = s_suppkey""",
    "components": """SELECT p_partkey component_id, p_name AS name, p_type component_type, p_retailprice unit_cost
        FROM part""",
    "supplier_components": "SELECT DISTINCT supplier_id, component_id FROM lines",
    "products": """
        SELECT product_id, category FROM (
          SELECT p_brand product_id, p_type category,
                 row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) rn
          FROM part GROUP BY p_brand, p_type) WHERE rn = 1""",
    "product_components": "SELECT p_brand product_id, p_partkey component_id, p_size quantity_required FROM part",
    "factories": """
        SELECT s_nationkey factory_id, n_name AS location,
               CAST(ceil(coalesce(sum(q), 0) / 2500.0) AS INTEGER) capacity_units_per_day
        FROM supplier LEFT JOIN (SELECT supplier_id, sum(quantity) q FROM lines GROUP BY 1) x ON x.supplier_id = s_suppkey
        JOIN nation ON n_nationkey = s_nationkey GROUP BY 1, 2""",
    "warehouses": """
        SELECT n_nationkey warehouse_id, n_name AS location, coalesce(cap, 0) capacity_units
        FROM (SELECT DISTINCT c_nationkey FROM customer) JOIN nation ON n_nationkey = c_nationkey
        LEFT JOIN (SELECT warehouse_id, CAST(sum(quantity) AS BIGINT) cap FROM routed GROUP BY 1) x
          ON x.warehouse_id = n_nationkey""",
    "inventory": """
        SELECT product_id, warehouse_id,
               CAST(coalesce(sum(quantity) FILTER (return_flag = 'R' AND ship_date > (SELECT d FROM snap) - 90), 0) AS BIGINT)
                 stock_level,
               CAST(round(sum(quantity) / 82.0) AS BIGINT) reorder_threshold, max(ship_date) updated_at
        FROM routed GROUP BY 1, 2""",
    "customers": """
        SELECT c_custkey customer_id, c_name AS name, c_nationkey warehouse_id, c_acctbal acct_balance,
          CASE WHEN c_acctbal >= 6000 THEN 'strategic' WHEN c_acctbal >= 2500 THEN 'standard' ELSE 'low' END priority_tier,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 7 WHEN 'AUTOMOBILE' THEN 10 WHEN 'BUILDING' THEN 14
               WHEN 'HOUSEHOLD' THEN 21 END sla_days,
          CASE c_mktsegment WHEN 'MACHINERY' THEN 0.10::DOUBLE WHEN 'AUTOMOBILE' THEN 0.08::DOUBLE
               WHEN 'BUILDING' THEN 0.05::DOUBLE WHEN 'HOUSEHOLD' THEN 0.03::DOUBLE END penalty_pct
        FROM customer""",
    "ord": """
        SELECT o_orderkey order_id, o_custkey customer_id,
          CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'fulfilled' WHEN 'P' THEN 'at_risk' END status,
          CAST(o_orderdate AS DATE) placed_at,
          CAST(o_orderdate AS DATE) + CASE WHEN o_orderpriority[1] IN ('1','2') THEN 30 ELSE 60 END due_at,
          o_totalprice order_value, o_orderpriority priority
        FROM orders""",
    "scores": """
        SELECT event_id score_id,
          CASE user_id % 4 WHEN 0 THEN 'supplier' WHEN 1 THEN 'product' WHEN 2 THEN 'order' ELSE 'shipment' END entity_type,
          user_id entity_id, ts scored_at,
          round(k / 99.0::DOUBLE, 4) delay_probability, round((k * 7) % 100 / 99.0::DOUBLE, 4) shortage_risk,
          round(least(value / 500.0::DOUBLE, 1), 4) impact_score
        FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) k FROM events)""",
    "audit_log": """
        SELECT event_id audit_id, user_id actor_id,
          CASE event_type WHEN 'error' THEN 'login_failed' WHEN 'signup' THEN 'login_success'
               WHEN 'purchase' THEN 'action_executed' ELSE event_type END event_type,
          ts created_at, props detail FROM events""",
    "registry_history": """
        SELECT event_id change_id, user_id model_version,
          CASE event_type WHEN 'view' THEN 'training' WHEN 'click' THEN 'evaluating' WHEN 'signup' THEN 'candidate'
               WHEN 'purchase' THEN 'active' WHEN 'error' THEN 'archived' END status, ts changed_at FROM events""",
    "request_history": """
        SELECT event_id change_id, user_id request_id,
          CASE event_type WHEN 'view' THEN 'pending' WHEN 'click' THEN 'approved' WHEN 'signup' THEN 'rejected'
               WHEN 'purchase' THEN 'executed' WHEN 'error' THEN 'failed' END status, ts changed_at FROM events""",
    "model_runs": """
        SELECT event_id run_id, 'v' || user_id model_version,
          CASE user_id % 3 WHEN 0 THEN 'uniform' WHEN 1 THEN 'attention' ELSE 'typed' END architecture,
          CASE event_id % 4 WHEN 0 THEN 'auc' WHEN 1 THEN 'f1' WHEN 2 THEN 'precision' ELSE 'recall' END metric_name,
          CASE (event_id // 4) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END dataset_split,
          round(least(value / 500.0::DOUBLE, 1), 6) metric_value, ts evaluated_at FROM events""",
    "requests": """
        SELECT o_orderkey request_id, 'order' entity_type, o_custkey entity_id, o_orderpriority AS source,
          CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'approved' ELSE 'rejected' END status,
          CASE WHEN o_orderstatus <> 'O' AND o_orderkey % 7 <> 0
               THEN '{"routed_to":"' || lower(substr(o_orderpriority, 3, 20)) || '"}' END decision_trace,
          CASE WHEN o_orderstatus = 'P' THEN CASE WHEN o_orderkey % 5 = 0 THEN '  '
               WHEN o_orderkey % 5 <> 1 THEN 'capacity' END END rejection_reason,
          o_orderdate created_at,
          CASE WHEN o_orderstatus <> 'O' THEN o_orderdate + INTERVAL 2 DAY END decided_at
        FROM orders""",
    "action_log": """
        SELECT order_id * 10 + line_no log_id, order_id request_id,
          CASE return_flag WHEN 'A' THEN 'erp' WHEN 'N' THEN 'slack' ELSE 'email' END target_system,
          CASE WHEN line_status = 'F' THEN 'success' ELSE 'failure' END status, ship_date executed_at FROM lines""",
    # -- risk signals ----------------------------------------------------------------------
    "reliability_now": """
        SELECT supplier_id, round(avg(CASE WHEN delivered_at <= eta THEN 1.0 ELSE 0.0 END), 6) reliability FROM (
          SELECT *, row_number() OVER (PARTITION BY supplier_id ORDER BY delivered_at DESC, shipment_id DESC) rn
          FROM shipments WHERE delivered_at IS NOT NULL) WHERE rn <= 10 GROUP BY 1""",
    "cell_risk": """
        SELECT *, round(greatest(0, CASE WHEN reorder_threshold <> 0
                 THEN 1 - stock_level / CAST(reorder_threshold AS DOUBLE) END), 6) inventory_risk FROM inventory""",
    "supplier_signals": """
        SELECT s.supplier_id, s.name, round(1 - reliability, 6) supplier_risk, d.delay_risk, i.inventory_risk,
               q.demand_risk,
               CASE WHEN s.is_active THEN round(((SELECT max(s_acctbal) FROM supplier) - s.acct_balance)
                 / ((SELECT max(s_acctbal) FROM supplier) - (SELECT min(s_acctbal) FROM supplier)), 6) END financial_risk
        FROM (SELECT s_suppkey supplier_id, s_name AS name, s_acctbal acct_balance, s_acctbal >= 0 is_active FROM supplier) s
        LEFT JOIN reliability_now r ON r.supplier_id = s.supplier_id
        LEFT JOIN (SELECT supplier_id, round(avg(CASE WHEN delivered_at > eta THEN 1.0 ELSE 0.0 END), 6) delay_risk
                   FROM shipments WHERE delivered_at IS NOT NULL GROUP BY 1) d ON d.supplier_id = s.supplier_id
        LEFT JOIN (SELECT supplier_id, round(avg(brand_risk), 6) inventory_risk
                   FROM (SELECT DISTINCT supplier_id, component_id FROM lines) sc JOIN part ON p_partkey = component_id
                   JOIN (SELECT product_id, avg(inventory_risk) brand_risk FROM cell_risk GROUP BY 1) b
                     ON b.product_id = p_brand GROUP BY 1) i ON i.supplier_id = s.supplier_id
        LEFT JOIN (SELECT supplier_id, round(greatest(0, least(1,
                       coalesce(sum(quantity) FILTER (CAST(ship_date AS DATE) > (SELECT d FROM snap) - 90), 0)
                       / (sum(quantity) * 90 / 2500.0::DOUBLE) - 1)), 6) demand_risk
                   FROM lines GROUP BY 1) q ON q.supplier_id = s.supplier_id""",
    "enriched": """
        SELECT supplier_id, name, impact_score, round(least(1, abs(impact_score - 0.5) * 2), 6) confidence,
          CASE WHEN impact_score >= 0.75 THEN 'critical' WHEN impact_score >= 0.5 THEN 'high'
               WHEN impact_score >= 0.25 THEN 'medium' ELSE 'low' END risk_category,
          scoring_method, 'rules-1' model_version, 'weighted' architecture
        FROM (SELECT supplier_id, name,
            CASE WHEN supplier_risk IS NULL OR delay_risk IS NULL THEN 'native' ELSE 'weighted_formula' END scoring_method,
            CASE WHEN supplier_risk IS NULL OR delay_risk IS NULL
              THEN round((coalesce(0.6 * delay_risk, 0) + coalesce(0.4 * inventory_risk, 0)) / nullif(
                 (CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.6 END + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.4 END), 0), 6)
              ELSE round((coalesce(0.3 * supplier_risk, 0) + coalesce(0.25 * delay_risk, 0) + coalesce(0.2 * inventory_risk, 0)
                + coalesce(0.15 * demand_risk, 0) + coalesce(0.1 * financial_risk, 0))
                / nullif(CASE WHEN supplier_risk IS NULL THEN 0 ELSE 0.3 END + CASE WHEN delay_risk IS NULL THEN 0 ELSE 0.25 END
                + CASE WHEN inventory_risk IS NULL THEN 0 ELSE 0.2 END + CASE WHEN demand_risk IS NULL THEN 0 ELSE 0.15 END
                + CASE WHEN financial_risk IS NULL THEN 0 ELSE 0.1 END, 0), 6) END impact_score
          FROM supplier_signals)""",
    "latest": """
        SELECT score_id, entity_type, entity_id, scored_at, delay_probability, shortage_risk, impact_score FROM (
          SELECT *, row_number() OVER (PARTITION BY entity_type, entity_id ORDER BY scored_at DESC, score_id DESC) rn
          FROM scores) WHERE rn = 1""",
    "late_labels": """
        SELECT *, coalesce(status = 'delayed', false) OR coalesce(delivered_at > eta, false) is_delayed FROM shipments""",
    "order_products": "SELECT DISTINCT order_id, product_id FROM items",
    "cells_open": """
        SELECT i.product_id, c.warehouse_id, count(DISTINCT i.order_id) open_orders,
               CAST(sum(i.quantity) AS BIGINT) demand
        FROM items i JOIN ord o ON o.order_id = i.order_id AND o.status = 'open'
        JOIN customers c ON c.customer_id = o.customer_id
        WHERE o.placed_at > (SELECT CAST(max(o_orderdate) AS DATE) FROM orders) - 365 GROUP BY 1, 2""",
}

CAT = """CASE WHEN {0} >= 0.75 THEN 'critical' WHEN {0} >= 0.5 THEN 'high' WHEN {0} >= 0.25 THEN 'medium' ELSE 'low' END"""


def ora(sql: str, extra: dict[str, str] | None = None) -> str:
    """``sql`` with the CTEs it uses, in dependency order."""
    defs = {**CTES, **(extra or {})}
    word = re.compile(r"\b(" + "|".join(map(re.escape, defs)) + r")\b")
    placed: list[str] = []

    def visit(name: str, stack: tuple[str, ...]) -> None:
        if name in placed or name in stack:
            return
        for dep in dict.fromkeys(word.findall(defs[name])):
            if dep != name:
                visit(dep, (*stack, name))
        placed.append(name)

    for name in dict.fromkeys(word.findall(sql)):
        visit(name, ())
    if not placed:
        return sql
    head = ",\n".join(f"{n} AS ({defs[n]})" for n in placed)
    recursive = "RECURSIVE " if any("UNION" in defs[n] and re.search(rf"\b(FROM|JOIN)\s+{n}\b", defs[n]) for n in placed) else ""
    return f"WITH {recursive}{head}\n{sql}"
