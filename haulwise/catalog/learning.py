"""Training and evaluation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import features as ft, learning as ln, traversal as tv
from .ctes import ora
from .graphs import component_values

EXTRA = {
    # probability = share of late ones among the supplier's last deliveries before the shipment was created, label = delayed
    "scored_ships": """
        SELECT s.shipment_id, s.supplier_id, s.created_at, CAST(s.status = 'delayed' AS INTEGER) label, round(1 - coalesce(h.reliability, 0.5), 4) p,
          CASE WHEN s.created_at < DATE '1999-06-30' THEN 'train' WHEN s.created_at < DATE '2000-06-30' THEN 'validation' ELSE 'test' END split
        FROM (SELECT * FROM shipments WHERE delivered_at IS NOT NULL) s ASOF LEFT JOIN (
          SELECT supplier_id, delivered_at, reliability FROM (
            SELECT supplier_id, delivered_at, round(avg(CASE WHEN delivered_at <= eta THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY supplier_id
                ORDER BY delivered_at, shipment_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) reliability,
              row_number() OVER (PARTITION BY supplier_id, delivered_at ORDER BY shipment_id DESC) rn
            FROM shipments WHERE delivered_at IS NOT NULL) WHERE rn = 1) h
        ON s.supplier_id = h.supplier_id AND s.created_at > h.delivered_at""",
}
CUTS = ("1999-06-30", "2000-06-30")


def lsql(sql: str) -> str:
    return ora(sql, EXTRA)


def past_reliability(m, done):
    """Per shipment of ``done`` its supplier's on-time rate when the shipment was created; 0.5 before the first delivery."""
    hist = ft.reliability_history(m.shipments, 10)
    # the last value of a day stands for the day
    daily = hist.groupBy("supplier_id", "delivered_at").agg(F.max_by("reliability", "shipment_id").alias("reliability"))
    past = ft.as_of_features(done, daily, "supplier_id", "created_at", "shipment_id", "delivered_at", "reliability")
    return past.select("shipment_id", F.coalesce("reliability", F.lit(0.5)).alias("past_reliability"))


def scored(m):
    done = m.shipments.filter(F.col("delivered_at").isNotNull())
    df = done.join(past_reliability(m, done), "shipment_id").select(
        "shipment_id", "supplier_id", "created_at", (F.col("status") == "delayed").cast("int").alias("label"),
        F.round(1 - F.col("past_reliability"), 4).alias("p"))
    return ft.time_split(df, "created_at", *[F.lit(c).cast("date") for c in CUTS])


def training_frame(m):
    """Delivered shipments with features known when they were created; the scaling is fitted on the training period."""
    done = ft.label_delayed(m.shipments.filter(F.col("delivered_at").isNotNull()))
    df = done.select("shipment_id", "supplier_id", "order_id", F.col("is_delayed").cast("int").alias("label"), "created_at").join(
        past_reliability(m, done), "shipment_id").join(m.orders.select("order_id", "order_value", "priority"), "order_id")
    df = df.withColumns({"urgency": F.substring("priority", 1, 1).cast("double"), "month": F.month("created_at").cast("double")})
    df = ft.time_split(df, "created_at", *[F.lit(c).cast("date") for c in CUTS])
    train = done.filter(F.col("created_at") < F.lit(CUTS[0]).cast("date")).join(m.orders.select("order_id", "order_value"), "order_id")
    b = train.agg(F.struct(F.min("order_value").alias("lo"), F.max("order_value").alias("hi")).alias("b")).scalar()
    scaled = F.try_divide(F.col("order_value") - b["lo"], F.nullif(b["hi"] - b["lo"], F.lit(0)))
    return df.withColumn("order_value_scaled", F.coalesce(scaled, F.lit(0)).cast("double"))


FEATURES = ["past_reliability", "order_value_scaled", "urgency", "month"]


def stages(m):
    """Supplier features from the three aggregation stages, joined to the training rows.

    What a supplier is known for is taken from deliveries of the training period only.
    """
    m = m.staged
    base = m.written(training_frame(m).select("shipment_id", "supplier_id", "label", "split", "past_reliability"), "training")
    edges = m.supplier_components.select(F.col("component_id").cast("string").alias("src"), F.col("supplier_id").cast("string").alias("dst"))
    early = ft.reliability_now(m.shipments.filter(F.col("delivered_at") < F.lit(CUTS[0]).cast("date")))
    comp, sup = component_values(m), m.suppliers.select("supplier_id").join(early, "supplier_id", "left").select(
        F.col("supplier_id").cast("string").alias("node_id"), F.coalesce("reliability", F.lit(0.5)).alias("reliability"))
    uniform = tv.mean_aggregate(comp, edges, ["reliability"]).select("node_id", F.col("mean_reliability").alias("g1"))
    attention = tv.attention_aggregate(comp, sup, edges, ["reliability"]).select("node_id", F.col("att_reliability").alias("g1"))
    parts = m.components.select(F.col("component_id").cast("string").alias("node_id"), "component_type")
    values = comp.join(parts, "node_id").select(F.lit("component").alias("node_type"), "node_id", F.col("reliability").alias("x"), "component_type")
    typed_edges = edges.join(parts.withColumnRenamed("node_id", "src"), "src").select(
        F.col("component_type").alias("edge_type"), F.lit("component").alias("src_type"), "src", F.lit("supplier").alias("dst_type"), "dst")
    typed = tv.typed_aggregate(values.drop("component_type"), typed_edges, "x", ["ECONOMY", "SMALL"]).select(
        "node_id", F.coalesce("mean_economy", F.lit(0.0)).alias("g1"), F.coalesce("mean_small", F.lit(0.0)).alias("g2"))
    join = lambda f: base.join(f.withColumn("supplier_id", F.col("node_id").cast("bigint")).drop("node_id"), "supplier_id")
    return ({"uniform": join(uniform), "attention": join(attention), "typed": join(typed)},
            {"uniform": ["past_reliability", "g1"], "attention": ["past_reliability", "g1"], "typed": ["past_reliability", "g1", "g2"]})


def register(cat) -> None:
    def trained(m):
        df = ln.cut(training_frame(m.staged))
        fitted = ln.train_classifier(df.filter(F.col("split") == "train"), FEATURES, "label")
        return fitted, df
    cat.add("train_classifier", lambda m: (lambda fd: ln.roc_auc(ln.batch_score(*fd), "p", "label", ["split"]))(trained(m)))
    cat.add("batch_score", lambda m: (lambda fd: ln.batch_score(fd[0], fd[1].filter(F.col("split") == "test")).select(
        "shipment_id", "p", "label"))(trained(m)))
    cat.add("ablate", lambda m: ln.ablate(*stages(m), "label", "split"))
    cat.add("grid_search", lambda m: ln.grid_search(training_frame(m.staged), FEATURES, "label", "split", [(0.001, 0.0), (0.01, 0.0), (0.1, 0.5)]))
    cat.add("class_weights", lambda m: ln.class_weights(scored(m), "label"), lsql("""
        SELECT label, count(*) n, round((SELECT count(*) FROM scored_ships) / (2.0 * count(*)), 6) weight FROM scored_ships GROUP BY 1"""))
    cat.add("roc_auc", lambda m: ln.roc_auc(scored(m), "p", "label", ["split"]), lsql("""
        SELECT split, CAST(np AS BIGINT) n_positive, CAST(nn AS BIGINT) n_negative, round((rs - np * (np + 1) / 2.0) / (np * nn), 6) auc FROM (
          SELECT split, sum(label) np, sum(1 - label) nn, sum(CASE WHEN label = 1 THEN ar END) rs FROM (
            SELECT *, rank() OVER (PARTITION BY split ORDER BY p) + (count(*) OVER (PARTITION BY split, p) - 1) / 2.0 ar FROM scored_ships) GROUP BY 1)"""))
    cat.add("precision_recall_f1", lambda m: ln.precision_recall_f1(scored(m), "p", "label", 0.4), lsql("""
        SELECT *, round(tp / (tp + fp)::DOUBLE, 6) "precision", round(tp / (tp + fn)::DOUBLE, 6) recall, round(2 * tp / (2 * tp + fp + fn)::DOUBLE, 6) f1 FROM (
          SELECT count(*) FILTER (p >= 0.4 AND label = 1) tp, count(*) FILTER (p >= 0.4 AND label = 0) fp,
            count(*) FILTER (p < 0.4 AND label = 1) fn, count(*) FILTER (p < 0.4 AND label = 0) tn FROM scored_ships)"""))
    cat.add("regression_metrics", lambda m: ln.regression_metrics(
        m.suppliers.join(m.shipments.select("supplier_id", "quantity"), "supplier_id"), "lead_time_days", "quantity"), ora("""
        SELECT count(*) n, round(avg(abs(e)), 6) mae, round(sqrt(avg(e * e)), 6) rmse, round(avg(abs(e / quantity::DOUBLE)), 6) mape
        FROM (SELECT quantity, CAST(lead_time_days - quantity AS DOUBLE) e FROM shipments JOIN suppliers USING (supplier_id))"""))
    cat.add("calibration_bins", lambda m: ln.calibration_bins(scored(m), "p", "label", 10), lsql("""
        SELECT CAST(least(floor(p * 10), 9) AS INTEGER) bin, count(*) n, round(avg(p), 6) mean_predicted, round(avg(label), 6) observed_rate
        FROM scored_ships GROUP BY 1"""))
    cat.add("long_metrics", lambda m: ln.long_metrics(
        m.scores.groupBy("entity_type").agg(F.count("*").alias("n"), fx.r6(F.avg("delay_probability")).alias("mean_delay"),
                                            fx.r6(F.max("impact_score")).alias("max_impact")),
        ["entity_type"], ["n", "mean_delay", "max_impact"]), ora("""
        SELECT entity_type, 'n' metric_name, count(*)::DOUBLE metric_value FROM scores GROUP BY 1
        UNION ALL SELECT entity_type, 'mean_delay', round(avg(delay_probability), 6) FROM scores GROUP BY 1
        UNION ALL SELECT entity_type, 'max_impact', round(max(impact_score), 6) FROM scores GROUP BY 1"""))
    cat.add("compare_architectures", lambda m: ln.compare_architectures(m.model_runs, ["auc", "f1", "precision", "recall"]), ora("""
        SELECT architecture, max(metric_value) FILTER (metric_name = 'auc') auc, max(metric_value) FILTER (metric_name = 'f1') f1,
          max(metric_value) FILTER (metric_name = 'precision') "precision", max(metric_value) FILTER (metric_name = 'recall') recall FROM (
          SELECT *, row_number() OVER (PARTITION BY architecture, metric_name ORDER BY evaluated_at DESC, run_id DESC) rn
          FROM model_runs WHERE dataset_split = 'test') WHERE rn = 1 GROUP BY 1"""))
    current = lambda m: ln.latest_per_key(m.registry_history, ["model_version"], [F.col("changed_at").desc(), F.col("change_id").desc()])
    cat.add("active_model", lambda m: ln.active_model(current(m)), ora("""
        SELECT n_active, CASE WHEN n_active = 1 THEN v END model_version, CASE n_active WHEN 1 THEN 'ok' WHEN 0 THEN 'none active' ELSE 'several active' END state
        FROM (SELECT count(*) n_active, min(model_version) v FROM (
          SELECT *, row_number() OVER (PARTITION BY model_version ORDER BY changed_at DESC, change_id DESC) rn FROM registry_history)
          WHERE rn = 1 AND status = 'active')"""))
    cat.add("label_support", lambda m: ln.label_support(scored(m), "split", "label"), lsql("""
        SELECT split, count(*) n, CAST(sum(label) AS BIGINT) n_positive, CASE WHEN sum(label) = 0 THEN 'no positives' WHEN sum(label) < 10 THEN 'few positives' END warning
        FROM scored_ships GROUP BY 1"""))
