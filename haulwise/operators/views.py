"""Dashboard and list reads over persisted tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as fx
from ..plans.windows import nested_in_parts
from .risk import latest_score

CATEGORIES = ("low", "medium", "high", "critical")


def severity_tiles(scores: DataFrame) -> DataFrame:
    """Counts per entity type and category, with subtotals and the grand total."""
    return scores.rollup("entity_type", "risk_category").agg(F.count("*").alias("n")).select(
        F.coalesce("entity_type", F.lit("all")).alias("entity_type"),
        F.coalesce("risk_category", F.lit("all")).alias("risk_category"), "n")


def top_at_risk(scores: DataFrame, score: str, tie: str, n: int) -> DataFrame:
    return scores.orderBy(F.col(score).desc(), F.col(tie)).limit(n)


@dataclass(frozen=True)
class RiskFilter:
    """Filters of the at-risk table; an empty field does not filter."""

    categories: Sequence[str] = ()
    min_score: float | None = None
    methods: Sequence[str] = ()

    def condition(self) -> Column:
        unknown = set(self.categories) - set(CATEGORIES)
        if unknown:
            raise ValueError(f"unknown risk categories: {sorted(unknown)}")
        cond = F.lit(True)
        if self.categories:
            cond = cond & F.col("risk_category").isin(*self.categories)
        if self.min_score is not None:
            cond = cond & (F.col("impact_score") >= self.min_score)
        if self.methods:
            cond = cond & F.col("scoring_method").isin(*self.methods)
        return cond


def at_risk_table(scores: DataFrame, lines: DataFrame, flt: RiskFilter) -> DataFrame:
    """Filtered scores with the number of affected orders."""
    orders = lines.select("supplier_id", "order_id").distinct().groupBy("supplier_id").agg(
        F.count("*").alias("affected_orders"))
    return scores.filter(flt.condition()).join(orders, "supplier_id", "left").withColumn(
        "affected_orders", F.coalesce("affected_orders", F.lit(0)))


def list_entities(df: DataFrame, search_cols: Sequence[str], risk_level: Sequence[str] = (), search: str | None = None) -> DataFrame:
    """Multi-value risk filter and case-insensitive text search; an unknown level is rejected."""
    unknown = set(risk_level) - set(CATEGORIES)
    if unknown:
        raise ValueError(f"unknown risk_level: {sorted(unknown)}")
    if risk_level:
        df = df.filter(F.col("risk_category").isin(*risk_level))
    if search:
        needle = F.lit(search.lower())
        hit = F.lit(False)
        for c in search_cols:
            hit = hit | F.contains(F.lower(F.col(c)), needle)
        df = df.filter(hit)
    return df


def entity_detail(entities: DataFrame, key: str, children: Mapping[str, tuple[DataFrame, str]], scores: DataFrame) -> DataFrame:
    """Entity with its linked rows and current score, one record per bounded part.

    ``children`` maps a relation name to (frame, sort column). Small entities
    have one part per relation; a large one gets more, never a cut list.
    """
    head = entities.join(scores, key, "left")
    out = None
    for name, (df, sort) in children.items():
        cols = [c for c in df.columns if c != key]
        item = F.to_json(F.struct(*[F.col(c) for c in cols]))
        part = nested_in_parts(df, [key], item, F.col(sort), "rows").withColumn("relation", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return head.join(out, key, "left")


def score_trend(scores: DataFrame, entity_type: str, entity_id: int, start: str, end: str) -> DataFrame:
    """Scores of one entity in [start, end); the filters reach the scan."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return scores.filter((F.col("entity_type") == entity_type) & (F.col("entity_id") == entity_id)
                         & (F.col("scored_at") >= ts(start)) & (F.col("scored_at") < ts(end)))


def compare_trends(scores: DataFrame, ids: Sequence[int], metric: str) -> DataFrame:
    """Daily mean of several entities on one time axis, one column per entity."""
    return (scores.filter(F.col("entity_id").isin(*ids))
            .groupBy(F.to_date("scored_at").alias("day"))
            .agg(*[fx.r6(F.avg(F.when(F.col("entity_id") == i, F.col(metric)))).alias(f"entity_{i}") for i in ids]))


def worsening(scores: DataFrame, metric: str, k: int) -> DataFrame:
    """Weekly slope per entity and whether the last ``k`` steps all rose.

    Weekly means are taken first: the window sees one row per week and entity.
    """
    key = ["entity_type", "entity_id"]
    weekly = scores.groupBy(*key, F.to_date(F.date_trunc("week", "scored_at")).alias("week")).agg(
        F.round(F.avg(metric), 9).alias("v"))
    w = W.partitionBy(*key).orderBy("week")
    steps = weekly.withColumn("_rise", (F.col("v") > F.lag("v").over(w)).cast("int"))
    last_k = w.rowsBetween(-(k - 1), 0)
    steps = steps.withColumn("_streak", (F.sum("_rise").over(last_k) == k) & (F.count("_rise").over(last_k) == k))
    x = F.datediff("week", F.lit("2024-01-01").cast("date")) / 7
    return steps.groupBy(*key).agg(
        fx.r6(F.regr_slope("v", x)).alias("slope"), F.count("*").alias("n_weeks"),
        F.max_by("_streak", "week").alias("still_rising")).withColumn(
        "still_rising", F.coalesce("still_rising", F.lit(False)))


def activity_feed(logs: Mapping[str, tuple[DataFrame, str, str]], n: int) -> DataFrame:
    """Newest ``n`` entries over several logs: name -> (frame, id column, time column)."""
    out = None
    for name, (df, key, ts) in logs.items():
        part = df.select(F.lit(name).alias("source"), F.col(key).cast("bigint").alias("row_id"), F.col(ts).alias("happened_at"))
        out = part if out is None else out.unionByName(part)
    return out.orderBy(F.col("happened_at").desc(), "source", F.col("row_id").desc()).limit(n)


def inventory_view(inventory: DataFrame, lo: float, hi: float) -> DataFrame:
    """Stock, threshold and shortage risk within a risk range (bounds included)."""
    return inventory.filter(F.col("inventory_risk").between(lo, hi)).select(
        "product_id", "warehouse_id", "stock_level", "reorder_threshold", "inventory_risk")


def shipment_list(routed: DataFrame, factories: DataFrame, warehouses: DataFrame, statuses: Sequence[str],
                  origin: str | None = None) -> DataFrame:
    """Shipments by status and route with origin and destination names."""
    origin_names = factories.select("factory_id", F.col("location").alias("origin"))
    dest = warehouses.select("warehouse_id", F.col("location").alias("destination"))
    out = routed.filter(F.col("status").isin(*statuses)).join(origin_names, "factory_id").join(dest, "warehouse_id")
    if origin:
        out = out.filter(F.col("origin") == origin)
    return out.select("shipment_id", "order_id", "supplier_id", "status", "eta", "origin", "destination")


def warehouse_view(warehouses: DataFrame, inventory: DataFrame, open_cells: DataFrame) -> DataFrame:
    """Capacity use, linked stock and open orders per warehouse."""
    stock = inventory.groupBy("warehouse_id").agg(F.sum("stock_level").alias("stock"), F.count("*").alias("n_products"))
    orders = open_cells.groupBy("warehouse_id").agg(F.sum("demand").alias("open_units"))
    return warehouses.join(stock, "warehouse_id", "left").join(orders, "warehouse_id", "left").withColumn(
        "capacity_use", fx.r6(F.try_divide("stock", F.nullif("capacity_units", F.lit(0)))))


def product_view(products: DataFrame, product_components: DataFrame, inventory: DataFrame, items: DataFrame) -> DataFrame:
    """Bill of components, stock, short cells and orders per product."""
    bom = product_components.groupBy("product_id").agg(F.count("*").alias("n_components"),
                                                       F.sum("quantity_required").alias("units_required"))
    stock = inventory.groupBy("product_id").agg(
        F.sum("stock_level").alias("stock"), F.count_if(F.col("stock_level") < F.col("reorder_threshold")).alias("short_cells"))
    orders = items.select("product_id", "order_id").distinct().groupBy("product_id").agg(F.count("*").alias("n_orders"))
    out = products
    for part in (bom, stock, orders):
        out = out.join(part, "product_id", "left")
    return out


def audit_view(log: DataFrame, start: str, end: str, kinds: Sequence[str]) -> DataFrame:
    """Audit rows in [start, end) of the given kinds."""
    ts = lambda s: F.lit(s).cast("timestamp_ntz")
    return log.filter((F.col("created_at") >= ts(start)) & (F.col("created_at") < ts(end)) & F.col("event_type").isin(*kinds))


def audit_counts(log: DataFrame) -> DataFrame:
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.max("created_at").alias("last_at"))


def customers_by_tier(customers: DataFrame, orders: DataFrame) -> DataFrame:
    """Order totals per tier; order values are summed per customer before the join."""
    per = orders.groupBy("customer_id").agg(
        F.count("*").alias("n"), F.sum(F.col("order_value").cast("decimal(18,2)")).alias("value"),
        F.count_if(F.col("status") == "open").alias("open"))
    return customers.join(per, "customer_id", "left").groupBy("priority_tier").agg(
        F.count("*").alias("n_customers"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_orders"),
        F.coalesce(F.sum("open"), F.lit(0)).alias("n_open"), F.sum("value").cast("double").alias("total_value"))


def current_scores(scores: DataFrame, p: str = "delay_probability") -> DataFrame:
    """Latest row per entity with its category."""
    return latest_score(scores).withColumn("risk_category", fx.category(F.col(p)))
