"""Typed graph as two long tables, its maintenance and its checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import columns as fx
from ..plans.windows import latest_per_key
from .features import degenerate_features, feature_vector

NODE_TYPES = ["supplier", "component", "product", "factory", "warehouse", "shipment", "order", "customer"]
EDGE_TYPES = ["SUPPLIES", "USED_IN", "STOCKED_AT", "MANUFACTURED_AT", "SHIPS_FROM", "SHIPS_TO",
              "FULFILLS", "ORDERED", "PLACED_BY"]


def build_nodes(m, types: Sequence[str] = NODE_TYPES) -> DataFrame:
    """(node_type, node_id, features) over the requested types."""
    out = None
    for t in types:
        part = feature_vector(m, t).select(F.lit(t).alias("node_type"), "node_id", "features")
        out = part if out is None else out.unionByName(part)
    return out


def _edge(df: DataFrame, kind: str, src_type: str, src: str, dst_type: str, dst: str, quantity: str | None = None,
          threshold: str | None = None, due: str | None = None, status: str | None = None) -> DataFrame:
    opt = lambda c, t: (F.col(c).cast(t) if c else F.lit(None).cast(t))
    return df.select(
        F.lit(kind).alias("edge_type"), F.lit(src_type).alias("src_type"), F.col(src).cast("string").alias("src"),
        F.lit(dst_type).alias("dst_type"), F.col(dst).cast("string").alias("dst"),
        opt(quantity, "double").alias("quantity"), opt(threshold, "double").alias("threshold"),
        opt(due, "date").alias("due"), opt(status, "string").alias("status"))


def infer_manufactured_at(routed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges, warnings): product -> factory from orders that ship from one factory.

    min = max replaces a distinct count, so the test is one partial aggregate.
    """
    per = routed.groupBy("order_id").agg(F.min("factory_id").alias("lo"), F.max("factory_id").alias("hi"))
    sure = per.filter(F.col("lo") == F.col("hi")).select("order_id", F.col("lo").alias("factory_id"))
    pairs = routed.select("order_id", "product_id").join(sure, "order_id").select("product_id", "factory_id").distinct()
    warnings = per.filter(F.col("lo") < F.col("hi")).select(
        F.lit("orders").alias("table_name"), F.col("order_id").alias("row_id"), F.lit("factory_id").alias("field"),
        F.lit("ambiguous factory").alias("reason"))
    return pairs, warnings


def build_edges(m, types: Sequence[str] = EDGE_TYPES) -> DataFrame:
    """All requested edge types in one table; MANUFACTURED_AT is inferred."""
    makers = {
        "SUPPLIES": lambda: _edge(m.supplier_components, "SUPPLIES", "supplier", "supplier_id", "component", "component_id"),
        "USED_IN": lambda: _edge(m.product_components, "USED_IN", "component", "component_id", "product", "product_id",
                                 quantity="quantity_required"),
        "STOCKED_AT": lambda: _edge(m.inventory, "STOCKED_AT", "product", "product_id", "warehouse", "warehouse_id",
                                    quantity="stock_level", threshold="reorder_threshold"),
        "MANUFACTURED_AT": lambda: _edge(infer_manufactured_at(m.routed)[0], "MANUFACTURED_AT", "product", "product_id",
                                         "factory", "factory_id"),
        "SHIPS_FROM": lambda: _edge(m.shipments, "SHIPS_FROM", "shipment", "shipment_id", "supplier", "supplier_id"),
        "SHIPS_TO": lambda: _edge(m.routed, "SHIPS_TO", "shipment", "shipment_id", "warehouse", "warehouse_id",
                                  due="eta", status="status"),
        "FULFILLS": lambda: _edge(m.shipments, "FULFILLS", "shipment", "shipment_id", "order", "order_id"),
        "ORDERED": lambda: _edge(m.items.groupBy("order_id", "product_id").agg(F.sum("quantity").alias("q")),
                                 "ORDERED", "order", "order_id", "product", "product_id", quantity="q"),
        "PLACED_BY": lambda: _edge(m.orders, "PLACED_BY", "order", "order_id", "customer", "customer_id"),
    }
    out = None
    for t in types:
        part = makers[t]()
        out = part if out is None else out.unionByName(part)
    return out


def node_id_map(nodes: DataFrame) -> DataFrame:
    """Dense 0-based index per node type.

    Ids are numbered inside 4,096 hash buckets and shifted by the bucket sizes,
    so no task has to number a whole type.
    """
    b = nodes.select("node_type", "node_id", fx.bucket12(F.col("node_id")).alias("_b"))
    local = b.withColumn("_rn", F.row_number().over(W.partitionBy("node_type", "_b").orderBy("node_id")))
    before = W.partitionBy("node_type").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = b.groupBy("node_type", "_b").agg(F.count("*").alias("_n")).select(
        "node_type", "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    return local.join(offsets, ["node_type", "_b"]).select(
        "node_type", "node_id", (F.col("_o") + F.col("_rn") - 1).alias("node_index"))


def apply_changes(current: DataFrame, changed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Replace the rows whose keys appear in ``changed``; everything else is kept."""
    return current.join(changed.select(*keys).distinct(), list(keys), "left_anti").unionByName(changed)


def merge_idempotent(target: DataFrame, batch: DataFrame, keys: Sequence[str], version: str) -> DataFrame:
    """Upsert where the higher version wins; replaying a batch changes nothing."""
    rest = [F.col(c) for c in target.columns if c not in keys and c != version]
    return latest_per_key(target.unionByName(batch), keys, [F.col(version).desc(), *rest])


def needs_full_rebuild(prev: DataFrame, now: DataFrame, kind: str, drift: float = 0.2) -> DataFrame:
    """One row per reason to rebuild: changed columns, or a type's count moved by more than ``drift``."""
    spark = prev.sparkSession
    a = prev.groupBy(kind).agg(F.count("*").alias("n_before"))
    b = now.groupBy(kind).agg(F.count("*").alias("n_after"))
    joined = a.join(b, kind, "full_outer").select(
        F.col(kind).alias("part"), F.coalesce("n_before", F.lit(0)).alias("n_before"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"))
    share = F.abs(F.col("n_after") - F.col("n_before")) / F.greatest("n_before", F.lit(1))
    out = joined.filter(share > drift).select("part", "n_before", "n_after", F.lit("drift").alias("reason"))
    odd = sorted(set(prev.dtypes) ^ set(now.dtypes))
    if odd:
        rows = spark.createDataFrame([(c, 0, 0, "schema") for c, _ in odd],
                                     "part string, n_before bigint, n_after bigint, reason string").distinct()
        out = out.unionByName(rows)
    return out


def _ends(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src_type").alias("node_type"), F.col("src").alias("node_id")).unionByName(
        edges.select(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id")))


def validate_graph(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Report of orphan nodes, dangling edge ends and degenerate vectors; never raises."""
    ends = _ends(edges).distinct()
    ids = nodes.select("node_type", "node_id")
    key = ["node_type", "node_id"]
    return (
        ids.join(ends, key, "left_anti").withColumn("problem", F.lit("orphan_node"))
        .unionByName(ends.join(ids, key, "left_anti").withColumn("problem", F.lit("dangling_edge")))
        .unionByName(degenerate_features(nodes))
    )


def validate_placed_by(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Orders without exactly one customer (error) and customers without orders (notice)."""
    placed = edges.filter(F.col("edge_type") == "PLACED_BY")
    per_order = placed.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n"))
    orders = nodes.filter(F.col("node_type") == "order").select("node_id")
    bad = orders.join(per_order, "node_id", "left").filter(F.coalesce("n", F.lit(0)) != 1).select(
        F.lit("order").alias("node_type"), "node_id", F.lit("error").alias("level"))
    idle = nodes.filter(F.col("node_type") == "customer").select("node_id").join(
        placed.select(F.col("dst").alias("node_id")), "node_id", "left_anti").select(
        F.lit("customer").alias("node_type"), "node_id", F.lit("notice").alias("level"))
    return bad.unionByName(idle)


def graph_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows present on one side only, multiplicity included; empty means equal."""
    return a.exceptAll(b).withColumn("side", F.lit("left_only")).unionByName(
        b.exceptAll(a).withColumn("side", F.lit("right_only")))


def graph_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Counts per node type and edge type."""
    return nodes.groupBy(F.lit("node").alias("kind"), F.col("node_type").alias("part")).agg(
        F.count("*").alias("n")).unionByName(
        edges.groupBy(F.lit("edge").alias("kind"), F.col("edge_type").alias("part")).agg(F.count("*").alias("n")))


def degree(edges: DataFrame) -> DataFrame:
    """In and out degree per node, from one pass over the edge list."""
    ends = edges.select(F.explode(F.array(
        F.struct(F.col("src_type").alias("node_type"), F.col("src").alias("node_id"), F.lit(1).alias("o"), F.lit(0).alias("i")),
        F.struct(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id"), F.lit(0).alias("o"), F.lit(1).alias("i")),
    )).alias("e")).select("e.*")
    return ends.groupBy("node_type", "node_id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))
