"""Risk scoring: signals, weighted formula, confidence, category, explanations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fx
from ..plans.windows import latest_per_key, nested_in_parts
from .features import financial_risk, inventory_risk, reliability_now


def supplier_signals(m) -> DataFrame:
    """The five signals per supplier; a signal that cannot be derived is NULL."""
    done = m.shipments.filter(F.col("delivered_at").isNotNull())
    delay = done.groupBy("supplier_id").agg(
        fx.r6(F.avg(F.when(F.col("delivered_at") > F.col("eta"), 1.0).otherwise(0.0))).alias("delay_risk"))
    per_product = inventory_risk(m.inventory).groupBy("product_id").agg(F.avg("inventory_risk").alias("_r"))
    parts = m.raw("part").select(F.col("p_partkey").alias("component_id"), F.col("p_brand").alias("product_id"))
    inv = m.supplier_components.join(parts.join(per_product, "product_id"), "component_id").groupBy("supplier_id").agg(
        fx.r6(F.avg("_r")).alias("inventory_risk"))
    recent = F.coalesce(F.sum(F.when(F.col("ship_date").cast("date") > F.date_sub(m.as_of.cast("date"), 90),
                                     F.col("quantity"))), F.lit(0))
    usual = F.sum("quantity") * 90 / F.lit(2500.0)
    demand = m.lines.groupBy("supplier_id").agg(fx.r6(fx.clip01(recent / usual - 1)).alias("demand_risk"))
    base = m.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"),
                                    F.col("s_acctbal").alias("acct_balance"))
    base = financial_risk(base, "acct_balance", F.col("acct_balance") >= 0).drop("acct_balance")
    rel = reliability_now(m.shipments).select("supplier_id", fx.r6(1 - F.col("reliability")).alias("supplier_risk"))
    out = base
    for part in (rel, delay, inv, demand):
        out = out.join(part, "supplier_id", "left")
    return out.select("supplier_id", "name", *fx.RISK_WEIGHTS)


def weighted_formula(signals: DataFrame, weights: Mapping[str, float] = fx.RISK_WEIGHTS) -> DataFrame:
    """Plain weighted sum of the signals; NULL if one is missing."""
    return signals.withColumn("impact_score", fx.r6(fx.weighted_sum(weights)))


def redistribute_weights(signals: DataFrame, weights: Mapping[str, float] = fx.RISK_WEIGHTS) -> DataFrame:
    """Weighted sum in which a missing signal's weight is shared over the present ones."""
    return signals.withColumn("impact_score", fx.r6(fx.weighted_present(weights)))


NATIVE_WEIGHTS = {"p_delay": 0.6, "p_shortage": 0.4}


def native_impact(df: DataFrame, p_delay: str, p_shortage: str, out: str = "native_score") -> DataFrame:
    """Combine delay and shortage probability; a missing one gives its weight away."""
    tmp = df.withColumns({"p_delay": F.col(p_delay), "p_shortage": F.col(p_shortage)})
    return tmp.withColumn(out, fx.r6(fx.weighted_present(NATIVE_WEIGHTS))).drop("p_delay", "p_shortage")


def confidence(df: DataFrame, p: str) -> DataFrame:
    return df.withColumn("confidence", fx.r6(fx.confidence(F.col(p))))


def categorize(df: DataFrame, score: str, bounds: Mapping[str, float] = fx.CATEGORY_BOUNDS) -> DataFrame:
    return df.withColumn("risk_category", fx.category(F.col(score), bounds))


def enrich(signals: DataFrame, model_version: str = "rules-1", architecture: str = "weighted") -> DataFrame:
    """Full risk record: score, confidence, category, method, version, architecture.

    Without the two core signals the record falls back to the native score. A new
    entity with no signal at all gets the neutral score 0.5 and confidence 0.
    """
    core_missing = F.col("supplier_risk").isNull() | F.col("delay_risk").isNull()
    df = native_impact(redistribute_weights(signals), "delay_risk", "inventory_risk", "_native")
    df = df.withColumn("scoring_method", F.when(core_missing, "native").otherwise("weighted_formula"))
    df = df.withColumn("impact_score", F.coalesce(
        F.when(core_missing, F.col("_native")).otherwise(F.col("impact_score")), F.lit(0.5)))
    df = categorize(confidence(df, "impact_score"), "impact_score")
    return df.select("supplier_id", "name", "impact_score", "confidence", "risk_category", "scoring_method",
                     F.lit(model_version).alias("model_version"), F.lit(architecture).alias("architecture"))


def latest_score(scores: DataFrame) -> DataFrame:
    """Newest persisted row per entity; never recomputed."""
    return latest_per_key(scores, ["entity_type", "entity_id"], [F.col("scored_at").desc(), F.col("score_id").desc()])


def formula_breakdown(signals: DataFrame, key: str, weights: Mapping[str, float] = fx.RISK_WEIGHTS) -> DataFrame:
    """One row per entity and signal with its weight and contribution."""
    rows = F.array(*[F.struct(F.lit(n).alias("signal"), F.lit(float(w)).alias("weight"),
                              F.col(n).alias("value"), fx.r6(F.col(n) * F.lit(float(w))).alias("contribution"))
                     for n, w in weights.items()])
    return signals.select(key, F.explode(rows).alias("x")).select(key, "x.*")


def confidence_coverage(scores: DataFrame, col: str = "confidence") -> DataFrame:
    return scores.agg(F.count("*").alias("n"), fx.r6(F.avg(F.when(F.col(col).isNotNull(), 1.0).otherwise(0.0))).alias("coverage"))


def attribution(values: DataFrame, edges: DataFrame, col: str) -> DataFrame:
    """Contribution of each neighbour to its target's mean, weights summing to 1.

    Leave-one-out has a closed form: mean - mean_without_x = (x - mean) / (n - 1).
    Group totals come from partial aggregates joined back, so a target with a
    third of all edges is never held in one window.
    """
    e = edges.select("src", "dst").distinct().join(
        values.select(F.col("node_id").alias("src"), F.col(col).alias("_x")), "src")
    mean = e.groupBy("dst").agg(F.avg("_x").alias("_mu"), F.count("*").alias("_n"))
    d = e.join(mean, "dst").withColumn(
        "delta", F.round(F.when(F.col("_n") > 1, (F.col("_x") - F.col("_mu")) / (F.col("_n") - 1)).otherwise(F.col("_x")), 9))
    total = d.groupBy("dst").agg(F.sum(F.abs("delta")).alias("_s"))
    weight = F.when(F.col("_s") > 1e-12, F.abs("delta") / F.col("_s")).otherwise(F.lit(1.0) / F.col("_n"))
    return d.join(total, "dst").select("dst", "src", fx.r6(F.col("delta")).alias("delta"), fx.r6(weight).alias("weight"))


def explanation_record(attr: DataFrame, src_type: str, dst_type: str, edge_type: str) -> DataFrame:
    """``nodes[]`` and ``edges[]`` per explained entity, in bounded parts."""
    item = F.struct(F.lit(src_type).alias("entity_type"), F.col("src").alias("entity_id"),
                    F.col("weight").alias("contribution_weight"))
    nodes = nested_in_parts(attr, ["dst"], item, F.col("src"), "nodes")
    edge = lambda n, dst: F.struct(n["entity_id"].alias("source"), dst.alias("target"), F.lit(edge_type).alias("edge_type"),
                                   n["contribution_weight"].alias("contribution_weight"))
    return nodes.select(F.lit(dst_type).alias("entity_type"), F.col("dst").alias("entity_id"), "part", "nodes",
                        F.transform("nodes", lambda n: edge(n, F.col("dst"))).alias("edges"))


def explanation_coverage(scores: DataFrame, explanations: DataFrame) -> DataFrame:
    """High and critical scores without an explanation."""
    risky = scores.filter(F.col("risk_category").isin("high", "critical"))
    return risky.join(explanations.select("score_id").distinct(), "score_id", "left_anti")


def explanations_containing(records: DataFrame, entity_id: str) -> DataFrame:
    """Explained entities whose node list mentions ``entity_id``."""
    return records.filter(F.exists("nodes", lambda n: n["entity_id"] == entity_id)).select("entity_type", "entity_id").distinct()


def method_divergence(signals: DataFrame) -> DataFrame:
    """Native and weighted score of the same entity side by side."""
    both = native_impact(redistribute_weights(signals), "delay_risk", "inventory_risk")
    return both.select("supplier_id", "native_score", F.col("impact_score").alias("formula_score"),
                       fx.r6(F.col("impact_score") - F.col("native_score")).alias("divergence"))


def at_risk_suppliers(m, n: int = 20) -> DataFrame:
    """Top suppliers by risk with the number of orders they touch."""
    touched = m.lines.select("supplier_id", "order_id").distinct().groupBy("supplier_id").agg(F.count("*").alias("affected_orders"))
    top = enrich(m.supplier_signals).orderBy(F.col("impact_score").desc(), F.col("supplier_id")).limit(n)
    return top.join(touched, "supplier_id", "left").withColumn("affected_orders", F.coalesce("affected_orders", F.lit(0)))


def scored(df: DataFrame, p: str = "delay_probability") -> DataFrame:
    """Confidence and category for persisted probabilities."""
    return categorize(confidence(df, p), p)


def level(c: Column) -> Column:
    """Numeric order of the categories, 0 for low."""
    return F.when(c == "critical", 3).when(c == "high", 2).when(c == "medium", 1).otherwise(0)
