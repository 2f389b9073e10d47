"""What-if scenarios on the flow graph: overridden features, changed scores downstream.

Scores spread linearly, so the change of a scenario can be spread alone: only nodes whose
score changes are joined in a hop, and the stored graph is never touched.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import columns as fx
from ..session import written
from .traversal import NODE, over_types

# Features that a scenario may override, and what is allowed.
FEATURE_RANGES = {"reliability": (0.0, 1.0), "lead_time_days": (0.0, 365.0), "own_risk": (0.0, 1.0)}
# Own risk that a day of lead time more or less adds or takes.
RISK_PER_DAY = 1 / 90


def reject_reason() -> Column:
    """Why an override (feature, value) cannot be used; null if it can."""
    out = F.lit("unknown feature")
    for name, (low, high) in FEATURE_RANGES.items():
        usable = F.col("value").isNotNull() & ~F.isnan("value") & F.col("value").between(low, high)
        out = F.when(F.col("feature") == name, F.when(~F.coalesce(usable, F.lit(False)), "out of range")).otherwise(out)
    return out


def check_features(overrides: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(usable, rejected) of overrides (node_type, node_id, feature, value).

    A value out of its range, an unknown feature or an unknown node rejects all overrides of that
    node, before anything is scored; ``rejected`` says why.
    """
    # only the nodes asked for, before they are made distinct
    known = nodes.select(*NODE).join(overrides.select(*NODE).distinct(), NODE, "left_semi").distinct().withColumn("_known", F.lit(True))
    checked = overrides.join(known, NODE, "left").withColumn(
        "reason", F.coalesce(F.when(F.col("_known").isNull(), "unknown node"), reject_reason())).drop("_known")
    bad = checked.filter(F.col("reason").isNotNull())
    usable = checked.drop("reason").join(bad.select(*NODE).distinct(), NODE, "left_anti")
    return usable, bad


def changed_risk(features: DataFrame, usable: DataFrame) -> DataFrame:
    """(node_type, node_id, risk, simulated) of the overridden nodes.

    ``features`` holds (node_type, node_id, risk, reliability, lead_time_days). An own risk that is
    given outright stands; else the reliability replaces the known one and the lead time moves the risk by its difference.
    """
    pick = lambda f: F.max(F.when(F.col("feature") == f, F.col("value")))
    wide = usable.groupBy(*NODE).agg(*[pick(f).alias(f"_{f}") for f in FEATURE_RANGES])
    moved = (1 - F.coalesce("_reliability", "reliability", 1 - F.col("risk"))) + F.coalesce(
        (F.col("_lead_time_days") - F.col("lead_time_days")) * F.lit(RISK_PER_DAY), F.lit(0.0))
    return features.join(wide, NODE).select(*NODE, "risk", fx.r6(F.coalesce("_own_risk", fx.clip01(moved))).alias("simulated"))


def spread_change(changed: DataFrame, edges: DataFrame, hops: int, damping: float) -> DataFrame:
    """(node_type, node_id, delta): what ``propagate_risk`` with the changed risks gives more.

    ``changed`` holds (node_type, node_id, delta) of own risks. Only edges into types that a change
    can reach are read; one sum over them gives what comes in and how many edges there are.
    """
    own = written(changed.filter("delta <> 0").groupBy(*NODE).agg(F.sum("delta").alias("delta")), "changed")
    kinds = [r.node_type for r in own.select("node_type").distinct().dropna().collect()]

    def step(kind: str, e: DataFrame, src: DataFrame) -> DataFrame:
        src = src.filter(F.abs("delta") > 1e-12).select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src"), "delta")
        got = e.filter(F.col("dst").isNotNull()).join(src, ["src_type", "src"], "left").groupBy(
            F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id")).agg(F.sum("delta").alias("_got"), F.count("*").alias("_n"))
        kept = F.when(F.col("_n").isNull(), F.col("delta")).otherwise(F.col("delta") * F.lit(1 - damping))
        come = F.col("_got") / F.col("_n") * F.lit(damping)
        return got.join(own.filter(F.col("node_type") == kind), NODE, "full_outer").filter(
            F.col("_got").isNotNull() | F.col("delta").isNotNull()).select(
            *NODE, (F.coalesce(come, F.lit(0.0)) + F.coalesce(kept, F.lit(0.0))).alias("delta"))
    return over_types(own, edges.select("src_type", "src", "dst_type", "dst"), hops, step, kinds)


def rescored_nodes(baseline: DataFrame, delta: DataFrame) -> DataFrame:
    """Baseline and simulated score and category of every node whose score changes.

    ``baseline`` holds (node_type, node_id, score) of the graph as it is.
    """
    # sums that differ in the last bit must not round a tie to different sides
    rounded = lambda x: fx.r6(x + 1e-9)
    both = baseline.join(delta, NODE).select(*NODE, rounded(F.col("score")).alias("base_score"), rounded(F.col("score") + F.col("delta")).alias("simulated_score"))
    return both.select(*NODE, "base_score", fx.category(F.col("base_score")).alias("base_category"), "simulated_score",
                       fx.category(F.col("simulated_score")).alias("simulated_category"),
                       fx.r6(F.col("simulated_score") - F.col("base_score")).alias("change")).filter("change <> 0")


def shifted_nodes(rescored: DataFrame, types: Sequence[str] = ("order", "product")) -> DataFrame:
    """Nodes of the given types whose category is another one in the scenario."""
    return rescored.filter(F.col("node_type").isin(*types) & (F.col("base_category") != F.col("simulated_category")))
