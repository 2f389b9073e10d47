"""Decision routing, constraints, allocation, splits and safety stock.

Each stated problem is a single knapsack with unit weights, for which filling in
order of value is optimal; it becomes a running sum per group. The sum runs over
value bands, so that a product holding a third of all orders is not one task.
"""

from __future__ import annotations

from collections.abc import Sequence
from statistics import NormalDist

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fx
from ..plans.windows import running_sum

# Decision types with a closed form; everything else is qualitative.
CLOSED_TYPES = ["safety_stock", "po_split", "customer_allocation"]
TIER_WEIGHT = {"strategic": 3.0, "standard": 2.0, "low": 1.0}


def route(decisions: DataFrame, col: str = "decision_type") -> DataFrame:
    return decisions.withColumn("routed_to", F.when(F.col(col).isin(*CLOSED_TYPES), "optimizer").otherwise("llm"))


def open_demand(m, days: int = 365) -> DataFrame:
    """Open demand per product and warehouse over the newest ``days`` of orders."""
    newest = m.raw("orders").agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    return _open_lines(m, F.date_sub(newest, days)).groupBy("product_id", "warehouse_id").agg(
        F.count_distinct("order_id").alias("open_orders"), F.sum("quantity").alias("demand"))


def _open_lines(m, since: Column) -> DataFrame:
    orders = m.orders.filter((F.col("status") == "open") & (F.col("placed_at") > since))
    site = m.customers.select("customer_id", "warehouse_id", "priority_tier", "sla_days", "penalty_pct")
    return m.items.select("order_id", "product_id", "quantity").join(orders, "order_id").join(site, "customer_id")


def open_order_lines(m, days: int = 365) -> DataFrame:
    """Open demand per order, product and warehouse with the customer's terms."""
    newest = m.raw("orders").agg(F.max("o_orderdate").cast("date").alias("d")).scalar()
    return _open_lines(m, F.date_sub(newest, days)).groupBy(
        "order_id", "product_id", "warehouse_id", "customer_id", "priority_tier", "sla_days", "penalty_pct",
        "order_value", "placed_at").agg(F.sum("quantity").alias("quantity"))


def assemble_constraints(m) -> DataFrame:
    """Stock, supplier, warehouse and factory capacity and lead time per product."""
    stock = m.inventory.groupBy("product_id").agg(F.sum("stock_level").alias("stock"))
    feeds = m.items.select("product_id", "supplier_id").distinct()
    sup = feeds.join(m.suppliers.select("supplier_id", "capacity_score", "lead_time_days"), "supplier_id").groupBy(
        "product_id").agg(F.sum(F.col("capacity_score").cast("decimal(18,3)")).cast("double").alias("supplier_capacity"),
                          F.min("lead_time_days").alias("lead_time_days"))
    wh = m.inventory.select("product_id", "warehouse_id").join(
        m.warehouses.select("warehouse_id", "capacity_units"), "warehouse_id").groupBy("product_id").agg(
        F.sum("capacity_units").alias("warehouse_capacity"))
    fac = m.routed.select("product_id", "factory_id").distinct().join(
        m.factories.select("factory_id", "capacity_units_per_day"), "factory_id").groupBy("product_id").agg(
        F.sum("capacity_units_per_day").alias("production_capacity"))
    out = m.products.select("product_id")
    for part in (stock, sup, wh, fac):
        out = out.join(part, "product_id", "left")
    return out


def validate_policy(candidates: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """Every candidate against every rule; ``rules`` maps a name to its violation."""
    broken = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return candidates.withColumn("broken_rules", broken).withColumn("is_eligible", F.col("broken_rules") == "")


def decision_trace(df: DataFrame) -> DataFrame:
    """Four-part JSON trace; a stage that took no part is null."""
    optimizer = F.col("routed_to") == "optimizer"
    trace = F.struct(
        F.struct("risk_category", "confidence", "scoring_method").alias("risk_intelligence"),
        F.struct("routed_to", F.col("is_eligible").alias("policy_checks_passed")).alias("decision_intelligence"),
        F.when(optimizer, F.struct("objective_value", "optimal")).alias("optimization"),
        F.when(~optimizer, F.struct(F.lit("qualitative").alias("kind"))).alias("llm"))
    return df.withColumn("decision_trace", F.to_json(trace, {"ignoreNullFields": "false"}))


def shortages(inventory: DataFrame, open_cells: DataFrame) -> DataFrame:
    """Cells where at least two open orders together exceed the stock."""
    busy = open_cells.filter(F.col("open_orders") >= 2)
    return inventory.select("product_id", "warehouse_id", "stock_level").join(busy, ["product_id", "warehouse_id"]).filter(
        F.col("demand") > F.col("stock_level"))


def customer_value(lines: DataFrame) -> DataFrame:
    """Value weight of serving an order: tier, revenue, SLA urgency and penalty.

    Missing contract terms leave ``customer_value`` NULL; such orders are served
    first in, first out after the valued ones.
    """
    tier = F.lit(None).cast("double")
    for name, w in TIER_WEIGHT.items():
        tier = F.when(F.col("priority_tier") == name, w).otherwise(tier)
    value = tier + F.col("order_value") / 500000.0 + F.lit(7.0) / F.col("sla_days") + F.col("penalty_pct") * 10
    return lines.withColumn("customer_value", F.round(value, 6))


def fifo_fallback(lines: DataFrame) -> DataFrame:
    """Composite service order: valued orders by value, the rest by order date.

    ``serve_band`` never decreases along the order and is the running-sum segment.
    """
    valued = F.col("customer_value").isNotNull()
    return lines.withColumns({
        "serve_group": F.when(valued, 0).otherwise(1),
        "serve_key": F.when(valued, -F.col("customer_value")).otherwise(
            F.datediff("placed_at", F.lit("1990-01-01").cast("date")).cast("double")),
    }).withColumn("serve_band", F.when(valued, F.floor(F.col("serve_key") * 50)).otherwise(
        1000000 + F.floor(F.col("serve_key") / 7)))


def allocate(lines: DataFrame, caps: DataFrame, keys: Sequence[str], tie: str = "order_id") -> DataFrame:
    """Grant quantities in service order until the group's capacity is used up.

    max sum(q * v) with sum(q) <= capacity and 0 <= q <= demand.
    """
    run = running_sum(lines, keys, "serve_band", ["serve_group", "serve_key", tie], {"_run": F.col("quantity")})
    prior = F.col("_run") - F.col("quantity")
    grant = F.greatest(F.lit(0), F.least(F.col("quantity"), F.col("capacity") - prior))
    return run.join(caps, list(keys)).withColumn("granted", grant.cast("bigint")).drop("_run")


def nested_limits(m, horizon_days: int = 30) -> DataFrame:
    """Per product and warehouse what binds there and in the whole product.

    A cell grants no more than its stock and its warehouse's capacity; all cells of a product no more than
    its suppliers' capacity and what its factories make in ``horizon_days``.
    """
    per_product = assemble_constraints(m).select(
        "product_id", "supplier_capacity", "lead_time_days", (F.col("production_capacity") * horizon_days).alias("production_capacity"))
    site = m.warehouses.select("warehouse_id", F.col("capacity_units").alias("warehouse_capacity"))
    cells = m.inventory.select("product_id", "warehouse_id", F.col("stock_level").alias("inventory")).join(site, "warehouse_id", "left")
    return cells.join(per_product, "product_id", "left").select("product_id", "warehouse_id", "inventory", "warehouse_capacity", "supplier_capacity",
                                                                "production_capacity", "lead_time_days")


LIMITS = ["inventory", "warehouse_capacity", "supplier_capacity", "production_capacity", "lead_time_days"]


def missing_limit() -> Column:
    """The first constraint that is not known; null if all are."""
    return F.coalesce(*[F.when(F.col(c).isNull(), F.lit(f"no {c}")) for c in LIMITS])


def allocate_nested(lines: DataFrame, limits: DataFrame, tie: str = "order_id") -> DataFrame:
    """Grants under nested capacities: a line in its cell, the cell in its product.

    max sum(q * v) with 0 <= q <= demand, sums per cell and per product within their limits, and no
    grant to an order that wants delivery sooner than the lead time. The limits are nested, so serving by
    value is optimal: first within each cell, then what cells would grant within the product.
    A line whose cell lacks a limit gets nothing and the reason. ``lines`` come from ``fifo_fallback``.
    """
    known = lines.join(limits, ["product_id", "warehouse_id"], "left").withColumn("reason", F.coalesce(
        missing_limit(), F.when(F.col("lead_time_days") > F.coalesce("sla_days", F.lit(60)), "lead time exceeds the agreed days")))
    cell = F.least("inventory", "warehouse_capacity")
    whole = F.floor(F.least("supplier_capacity", F.col("production_capacity").cast("double")))
    wanted = F.when(F.col("reason").isNull(), F.col("quantity")).otherwise(F.lit(0))
    order = ["serve_group", "serve_key", tie]
    left = lambda run, take, cap: F.greatest(F.lit(0), F.least(take, cap - (F.col(run) - take)))
    first = running_sum(known.withColumn("_wanted", wanted), ["product_id", "warehouse_id"], "serve_band", order, {"_run": F.col("_wanted")})
    first = first.withColumn("_take", F.coalesce(left("_run", F.col("_wanted"), cell), F.lit(0)).cast("bigint")).drop("_run")
    second = running_sum(first, ["product_id"], "serve_band", [*order, "warehouse_id"], {"_run": F.col("_take")})
    granted = F.coalesce(left("_run", F.col("_take"), whole), F.lit(0)).cast("bigint")
    reason = F.coalesce("reason", F.when(F.col("_granted") == F.col("quantity"), F.lit(None)).when(
        F.col("_granted") < F.col("_take"), "product capacity used up").otherwise("cell capacity used up"))
    return second.withColumn("_granted", granted).select(*lines.columns, *LIMITS, F.col("_granted").alias("granted"), reason.alias("reason"))


def allocation_result(allocated: DataFrame) -> DataFrame:
    """Per product: what was asked and granted, the objective, whether it is optimal, why not, and the limits that applied."""
    missing = F.max(F.when(F.col("reason").startswith("no "), F.col("reason")))
    site = allocated.select("product_id", "warehouse_id", "inventory", "warehouse_capacity").distinct().groupBy("product_id").agg(
        F.sum("inventory").alias("inventory"), F.sum("warehouse_capacity").alias("warehouse_capacity"))
    out = allocated.groupBy("product_id").agg(
        F.sum("quantity").alias("requested"), F.sum("granted").alias("granted"),
        fx.r6(F.coalesce(F.sum(F.col("granted") * F.col("customer_value")), F.lit(0.0))).alias("objective_value"),
        F.count_if(F.col("reason") == "lead time exceeds the agreed days").alias("too_late"), missing.alias("reason"),
        *[F.max(c).alias(c) for c in LIMITS[2:]])
    return out.join(site, "product_id").withColumn("optimal", F.col("reason").isNull()).select(
        "product_id", "requested", F.when(F.col("optimal"), F.col("granted")).alias("granted"),
        F.when(F.col("optimal"), F.col("objective_value")).alias("objective_value"), "optimal", "reason", "too_late",
        F.struct(*LIMITS).alias("constraints_applied"))


def check_adjustment(edited: DataFrame, caps: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Groups whose edited quantities exceed the capacity; the proposal itself is untouched."""
    total = edited.groupBy(*keys).agg(F.sum("adjusted").alias("adjusted_total"))
    return total.join(caps, list(keys)).filter(F.col("adjusted_total") > F.col("capacity"))


def safety_stock(demand: DataFrame, lead: DataFrame, limits: DataFrame, service_level: float = 0.95) -> DataFrame:
    """Reorder level ``L * mean + z * sqrt(L) * sd`` per cell under normal demand.

    ``demand`` holds monthly quantities (product, warehouse, quantity), ``lead``
    lead time in months per product, ``limits`` the capacity per warehouse. A level
    above the capacity is infeasible and comes back with a reason and no number.
    """
    z = NormalDist().inv_cdf(service_level)
    stats = demand.groupBy("product_id", "warehouse_id").agg(
        F.avg("quantity").alias("mu"), F.coalesce(F.stddev_samp("quantity"), F.lit(0.0)).alias("sd"))
    level = F.ceil(F.round(F.col("lead_months") * F.col("mu") + F.lit(z) * F.sqrt("lead_months") * F.col("sd"), 6))
    out = stats.join(lead, "product_id").join(limits, "warehouse_id").withColumn("level", level)
    ok = F.col("level") <= F.col("capacity")
    return out.select("product_id", "warehouse_id", ok.alias("optimal"),
                      F.when(ok, F.col("level")).alias("recommended_reorder_threshold"),
                      F.when(~ok, "exceeds warehouse capacity").alias("reason"))


def feasibility(need: DataFrame, offers: DataFrame) -> DataFrame:
    """Whether total capacity covers the need; otherwise the reason."""
    total = offers.groupBy("product_id").agg(F.sum("capacity").alias("total_capacity"))
    joined = need.join(total, "product_id", "left")
    ok = F.coalesce(F.col("total_capacity") >= F.col("required_qty"), F.lit(False))
    return joined.select("product_id", "required_qty", F.coalesce("total_capacity", F.lit(0)).alias("total_capacity"),
                         ok.alias("optimal"), F.when(~ok, "capacity below required quantity").alias("reason"))


def po_split(need: DataFrame, offers: DataFrame) -> DataFrame:
    """Split the needed quantity over suppliers by lead time, within capacity.

    Infeasible products yield no split at all, never a partial one.
    """
    feasible = feasibility(need, offers).filter("optimal").select("product_id", "required_qty")
    run = running_sum(offers, ["product_id"], "lead_time_days", ["lead_time_days", "supplier_id"], {"_run": F.col("capacity")})
    prior = F.col("_run") - F.col("capacity")
    qty = F.greatest(F.lit(0), F.least(F.col("capacity"), F.col("required_qty") - prior))
    return run.join(feasible, "product_id").withColumn("qty", qty.cast("bigint")).filter(F.col("qty") > 0).select(
        "product_id", "supplier_id", "lead_time_days", "capacity", "qty")


# -- what-if scenarios ----------------------------------------------------------------------------

def rejected_overrides(overrides: DataFrame) -> DataFrame:
    """Overrides outside [0, 1] or of an unknown signal; they never reach scoring."""
    known = F.array(*[F.lit(s) for s in fx.RISK_WEIGHTS])
    return overrides.filter(F.exists(F.map_entries("overrides"), lambda e: ~e["value"].between(0, 1)
                                     | ~F.array_contains(known, e["key"])))


def apply_overrides(signals: DataFrame, overrides: DataFrame) -> DataFrame:
    """Signals of the scenario; the base frame is left as it is."""
    bad = rejected_overrides(overrides).select("supplier_id").distinct()
    good = overrides.join(bad, "supplier_id", "left_anti")
    joined = signals.join(good, "supplier_id", "left")
    return joined.withColumns({s: F.coalesce(F.try_element_at("overrides", F.lit(s)), F.col(s)) for s in fx.RISK_WEIGHTS}
                              ).drop("overrides")


def rescore(base: DataFrame, scenario: DataFrame) -> DataFrame:
    """Baseline and simulated score and category per entity."""
    def scored(df: DataFrame, tag: str) -> DataFrame:
        s = df.withColumn("_s", fx.r6(fx.weighted_present(fx.RISK_WEIGHTS)))
        return s.select("supplier_id", F.col("_s").alias(f"{tag}_score"), fx.category(F.col("_s")).alias(f"{tag}_category"))
    return scored(base, "base").join(scored(scenario, "simulated"), "supplier_id").withColumn(
        "change", fx.r6(F.col("simulated_score") - F.col("base_score")))


def shifted_entities(rescored: DataFrame) -> DataFrame:
    return rescored.filter(~F.col("base_category").eqNullSafe(F.col("simulated_category")))


def scenario_distribution(signals: DataFrame, n: int, seed: int, spread: float = 0.2) -> DataFrame:
    """Mean and p05/p50/p95 of the score over ``n`` seeded perturbations per entity.

    The draws live in an array of the entity's own row: no cross join, no shuffle.
    """
    base = signals.withColumn("_b", fx.weighted_present(fx.RISK_WEIGHTS))
    draw = lambda i: F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("supplier_id").cast("string"),
                                                           i.cast("string"))), 1, 8), 16, 10).cast("double") / 4294967296.0
    runs = F.transform(F.sequence(F.lit(1), F.lit(n)),
                       lambda i: F.round(fx.clip01(F.col("_b") * (1 + F.lit(spread) * (2 * draw(i) - 1))), 6))
    at = lambda p: F.element_at("_r", max(1, -(-n * p // 100)))
    return base.withColumn("_r", F.array_sort(runs)).select(
        "supplier_id", fx.r6(F.aggregate("_r", F.lit(0.0), lambda a, x: a + x) / n).alias("mean_score"),
        at(5).alias("p05"), at(50).alias("p50"), at(95).alias("p95"))


def snapshot_checksum(df: DataFrame) -> DataFrame:
    """Order-independent checksum of a frame; equal before and after a scenario."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in df.columns])
    part = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
    return df.agg(F.count("*").alias("n"), F.coalesce(F.sum(part), F.lit(0)).alias("checksum"))
