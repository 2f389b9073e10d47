"""Feature engineering and labels. Statistics come as scalar subqueries, never as joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions import columns as fx
from ..plans.windows import drop_context, running_last, top_per_key, with_lookback


def minmax_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - min) / (max - min); 0 when the column is constant."""
    s = df.agg(F.struct(F.min(col).alias("lo"), F.max(col).alias("hi")).alias("s")).scalar()
    scaled = F.coalesce(F.try_divide(F.col(col) - s["lo"], F.nullif(s["hi"] - s["lo"], F.lit(0))), F.lit(0.0))
    return df.withColumn(out or f"{col}_scaled", F.when(F.col(col).isNotNull(), scaled))


def zscore_scale(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """(x - mean) / sample standard deviation; 0 when the column is constant."""
    s = df.agg(F.struct(F.avg(col).alias("mu"), F.stddev_samp(col).alias("sd")).alias("s")).scalar()
    z = F.coalesce(F.try_divide(F.col(col) - s["mu"], F.nullif(s["sd"], F.lit(0.0))), F.lit(0.0))
    return df.withColumn(out or f"{col}_z", F.when(F.col(col).isNotNull(), z))


def _on_time() -> Column:
    return F.when(F.col("delivered_at") <= F.col("eta"), 1.0).otherwise(0.0)


def reliability_history(shipments: DataFrame, n: int = 10, segment: str = "week") -> DataFrame:
    """On-time rate over the last ``n`` deliveries of the supplier, at every delivery.

    ``segment`` is the time unit by which a supplier's history is split over tasks.
    """
    done = shipments.filter(F.col("delivered_at").isNotNull()).select(
        "supplier_id", "shipment_id", "delivered_at", _on_time().alias("on_time"),
        F.trunc("delivered_at", segment).alias("_seg"))
    keys, order = ["supplier_id"], ["delivered_at", "shipment_id"]
    w = W.partitionBy("supplier_id", "_seg").orderBy(*order).rowsBetween(-(n - 1), 0)
    ctx = with_lookback(done, keys, "_seg", order, n - 1)
    return drop_context(ctx.withColumn("reliability", fx.r6(F.avg("on_time").over(w)))).select(
        "supplier_id", "shipment_id", "delivered_at", "reliability")


def reliability_now(shipments: DataFrame, n: int = 10) -> DataFrame:
    """Current on-time rate per supplier: only its last ``n`` deliveries are shuffled."""
    done = shipments.filter(F.col("delivered_at").isNotNull())
    last = top_per_key(done.select("supplier_id", "delivered_at", "shipment_id", _on_time().alias("on_time")),
                       ["supplier_id"], [F.col("delivered_at").desc(), F.col("shipment_id").desc()], n)
    return last.groupBy("supplier_id").agg(fx.r6(F.avg("on_time")).alias("reliability"))


def days_to(df: DataFrame, date_col: str, as_of: Column, out: str) -> DataFrame:
    """Signed days from the snapshot date to ``date_col``."""
    return df.withColumn(out, F.datediff(F.col(date_col), as_of))


def one_hot(df: DataFrame, col: str, levels: Sequence[str]) -> DataFrame:
    """One 0/1 column per fixed level, named ``<col>_<level>``."""
    return df.withColumns({f"{col}_{lv}": c for lv, c in zip(levels, fx.one_of(F.col(col), levels))})


def bucket_top_k(df: DataFrame, col: str, k: int) -> DataFrame:
    """``<col>_bucket`` (the k most frequent values, else ``other``) and its slot 1..k+1."""
    top = df.groupBy(col).agg(F.count("*").alias("_n")).orderBy(F.col("_n").desc(), F.col(col)).limit(k)
    # k rows at most: one task orders them and every task may hold them
    ranked = top.withColumn("_slot", F.row_number().over(W.orderBy(F.col("_n").desc(), F.col(col)))).drop("_n")
    return (df.join(F.broadcast(ranked), col, "left")
            .withColumn(f"{col}_bucket", F.when(F.col("_slot").isNotNull(), F.col(col)).otherwise("other"))
            .withColumn(f"{col}_slot", F.coalesce("_slot", F.lit(k + 1))).drop("_slot"))


def slot_vector(slot: Column, size: int) -> Column:
    """One-hot array of a slot number 1..size."""
    return F.transform(F.sequence(F.lit(1), F.lit(size)), lambda i: F.when(i == slot, 1.0).otherwise(0.0))


def label_delayed(shipments: DataFrame) -> DataFrame:
    """Marked delayed, or delivered after the promised date."""
    late = F.coalesce(F.col("status") == "delayed", F.lit(False)) | F.coalesce(
        F.col("delivered_at") > F.col("eta"), F.lit(False))
    return shipments.withColumn("is_delayed", late)


def label_shortage(inventory: DataFrame, items: DataFrame, orders: DataFrame) -> DataFrame:
    """Stock below threshold while some open order needs the product."""
    open_orders = orders.filter(F.col("status") == "open").select("order_id")
    wanted = items.join(open_orders, "order_id", "left_semi").select("product_id").distinct().withColumn(
        "_open", F.lit(True))
    return inventory.join(wanted, "product_id", "left").withColumn(
        "is_shortage", (F.col("stock_level") < F.col("reorder_threshold")) & F.coalesce("_open", F.lit(False))
    ).drop("_open")


def demand_spike(items: DataFrame, k: int = 6) -> DataFrame:
    """Monthly quantity per product against its previous ``k`` months.

    Summed per month before the window, which then sees one row per month.
    """
    monthly = items.groupBy("product_id", F.trunc("ship_date", "month").alias("month")).agg(
        F.sum("quantity").alias("quantity"))
    w = W.partitionBy("product_id").orderBy("month").rowsBetween(-k, -1)
    return (monthly.withColumn("mean_before", F.avg("quantity").over(w))
            .withColumn("sd_before", F.stddev_samp("quantity").over(w))
            .withColumn("spike", fx.r6(F.try_divide(F.col("quantity") - F.col("mean_before"),
                                                    F.nullif("sd_before", F.lit(0.0)))))
            .withColumns({c: fx.r6(F.col(c)) for c in ("mean_before", "sd_before")}))


def inventory_risk(inventory: DataFrame) -> DataFrame:
    """How far stock is below its threshold, 0..1; NULL without a threshold is 0."""
    gap = 1 - F.try_divide(F.col("stock_level"), F.nullif("reorder_threshold", F.lit(0)))
    return inventory.withColumn("inventory_risk", fx.r6(F.greatest(F.lit(0.0), gap)))


def financial_risk(df: DataFrame, balance: str, available: Column) -> DataFrame:
    """Inverted scaled balance where the field is available, else NULL."""
    s = df.agg(F.struct(F.min(balance).alias("lo"), F.max(balance).alias("hi")).alias("s")).scalar()
    risk = F.try_divide(s["hi"] - F.col(balance), s["hi"] - s["lo"])
    return df.withColumn("financial_risk", F.when(available, fx.r6(risk)))


def as_of_features(facts: DataFrame, history: DataFrame, key: str, fact_ts: str, fact_id: str,
                   hist_ts: str, value: str, segment: str = "week") -> DataFrame:
    """Each fact with the newest history value strictly before it (leak guard).

    Facts and history are one stream ordered by time; at equal times the fact
    comes first. The running value is carried over (key, ``segment``) pieces.
    """
    f = facts.select(F.col(key), F.col(fact_ts).alias("_ts"), F.lit(0).alias("_kind"),
                     F.col(fact_id).alias("_id"), F.lit(None).cast("double").alias("_v"))
    h = history.select(F.col(key), F.col(hist_ts).alias("_ts"), F.lit(1).alias("_kind"),
                       F.lit(None).cast("bigint").alias("_id"), F.col(value).cast("double").alias("_v"))
    stream = f.unionByName(h).withColumn("_seg", F.trunc("_ts", segment))
    out = running_last(stream, [key], "_seg", ["_ts", "_kind", "_id", "_v"], {"_last": F.col("_v")})
    return out.filter(F.col("_kind") == 0).select(
        key, F.col("_id").alias(fact_id), F.col("_ts").alias(fact_ts), F.col("_last").alias(value))


def time_split(df: DataFrame, ts: str, cut1, cut2) -> DataFrame:
    """train before ``cut1``, validation before ``cut2``, test after."""
    return df.withColumn("split", F.when(F.col(ts) < cut1, "train").when(F.col(ts) < cut2, "validation")
                         .otherwise("test"))


def degenerate_features(nodes: DataFrame) -> DataFrame:
    """Nodes whose vector is all zero, or holds only NULL/NaN."""
    zero = F.forall("features", lambda x: x == 0)
    nan = F.forall("features", lambda x: x.isNull() | F.isnan(x))
    return nodes.filter(F.coalesce(zero, F.lit(False)) | F.coalesce(nan, F.lit(False))).select(
        "node_type", "node_id", F.when(nan, "all_missing").otherwise("all_zero").alias("problem"))


def order_line_features(orders: DataFrame, items: DataFrame) -> DataFrame:
    """Line and unit counts per order."""
    per = items.groupBy("order_id").agg(F.count("*").alias("n_lines"), F.sum("quantity").alias("n_units"))
    return orders.join(per, "order_id", "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in ("n_lines", "n_units")})


# -- node and edge vectors --------------------------------------------------------------------

SHIPMENT_STATUS = ["scheduled", "in_transit", "delivered", "delayed"]
ORDER_STATUS = ["open", "fulfilled", "cancelled", "at_risk"]
TIERS = ["strategic", "standard", "low"]


def _vec(*cols: Column) -> Column:
    return F.array(*[F.coalesce(c.cast("double"), F.lit(0.0)) for c in cols])


def feature_vector(m, node_type: str) -> DataFrame:
    """(node_id, features) of one node type: fixed order, fixed length, no NULL."""
    if node_type == "supplier":
        df = m.suppliers.select("supplier_id", "country", "lead_time_days", "capacity_score")
        df = minmax_scale(minmax_scale(bucket_top_k(df, "country", 14), "lead_time_days"), "capacity_score")
        df = df.join(reliability_now(m.shipments), "supplier_id", "left")
        head = _vec(F.col("lead_time_days_scaled"), F.coalesce("reliability", F.lit(0.5)),
                    F.col("capacity_score_scaled"))
        return df.select(F.col("supplier_id").cast("string").alias("node_id"),
                         F.concat(head, slot_vector(F.col("country_slot"), 15)).alias("features"))
    if node_type == "component":
        df = minmax_scale(bucket_top_k(m.components, "component_type", 10), "unit_cost")
        return df.select(F.col("component_id").cast("string").alias("node_id"),
                         F.concat(_vec(F.col("unit_cost_scaled")), slot_vector(F.col("component_type_slot"), 11)).alias("features"))
    if node_type == "product":
        df = bucket_top_k(m.products, "category", 8)
        return df.select(F.col("product_id").alias("node_id"), slot_vector(F.col("category_slot"), 9).alias("features"))
    if node_type in ("factory", "warehouse"):
        df, key, cap = ((m.factories, "factory_id", "capacity_units_per_day") if node_type == "factory"
                        else (m.warehouses, "warehouse_id", "capacity_units"))
        df = minmax_scale(bucket_top_k(df, "location", 10), cap)
        return df.select(F.col(key).cast("string").alias("node_id"),
                         F.concat(_vec(F.col(f"{cap}_scaled")), slot_vector(F.col("location_slot"), 11)).alias("features"))
    if node_type == "shipment":
        return m.shipments.select(
            F.col("shipment_id").cast("string").alias("node_id"),
            _vec(F.datediff("eta", m.as_of), *fx.one_of(F.col("status"), SHIPMENT_STATUS)).alias("features"))
    if node_type == "order":
        return minmax_scale(m.orders, "order_value").select(
            F.col("order_id").cast("string").alias("node_id"),
            _vec(F.datediff("due_at", m.as_of), *fx.one_of(F.col("status"), ORDER_STATUS),
                 F.col("order_value_scaled")).alias("features"))
    if node_type == "customer":
        return m.customers.select(F.col("customer_id").cast("string").alias("node_id"),
                                  _vec(*fx.one_of(F.col("priority_tier"), TIERS)).alias("features"))
    raise ValueError(f"unknown node type {node_type!r}")


def edge_features(edges: DataFrame, as_of: Column) -> DataFrame:
    """One number per edge: scaled quantity, stock over threshold, or days to ETA."""
    lo_hi = edges.groupBy("edge_type").agg(F.min("quantity").alias("lo"), F.max("quantity").alias("hi"))
    scaled = F.try_divide(F.col("quantity") - F.col("lo"), F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)))
    value = (F.when(F.col("edge_type") == "STOCKED_AT",
                    F.try_divide(F.col("quantity"), F.nullif("threshold", F.lit(0.0))))
             .when(F.col("edge_type") == "SHIPS_TO", F.datediff("due", as_of).cast("double"))
             .otherwise(scaled))
    # one row per edge type of the model; edges stay where they are
    return edges.join(F.broadcast(lo_hi), "edge_type").select(
        "edge_type", "src", "dst", fx.r6(F.coalesce(value, F.lit(0.0))).alias("edge_feature"))
