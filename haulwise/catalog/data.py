"""Sources, quality and feature queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as fx
from ..operators import features as ft, quality as q
from ..session import scratch_path
from ..sources import sinks, tables
from .ctes import ora

ADAPTED = {
    "suppliers": "suppliers", "components": "components", "products": "products",
    "product_components": "product_components", "factories": "factories", "warehouses": "warehouses",
    "inventory": "inventory", "customers": "customers", "orders": "ord", "items": "items", "shipments": "shipments",
}

LINE_RULES = lambda: [
    q.Rule("l_quantity", "above 45", F.col("l_quantity") > 45),
    q.Rule("l_discount", "above 0.08", F.col("l_discount") > 0.08),
    q.Rule("l_shipdate", "before 1995-02-01", F.col("l_shipdate") < F.lit("1995-02-01").cast("timestamp_ntz")),
]
ORDER_RULES = lambda: [
    q.Rule("o_totalprice", "above 490000", F.col("o_totalprice") > 490000),
    q.Rule("o_orderstatus", "unknown status", ~F.col("o_orderstatus").isin("O", "F")),
    q.Rule("o_custkey", "missing", F.col("o_custkey").isNull()),
]
ORDER_VIOLATIONS = """
    SELECT o_orderkey row_id, unnest([
      CASE WHEN o_totalprice > 490000 THEN {'field': 'o_totalprice', 'reason': 'above 490000'} END,
      CASE WHEN o_orderstatus NOT IN ('O', 'F') THEN {'field': 'o_orderstatus', 'reason': 'unknown status'} END,
      CASE WHEN o_custkey IS NULL THEN {'field': 'o_custkey', 'reason': 'missing'} END]) v FROM orders"""


def _legacy(m):
    orders = m.raw("orders").join(
        m.raw("customer").select(F.col("c_custkey").alias("o_custkey"), "c_name"), "o_custkey")
    return orders.select("o_orderkey", F.when(F.col("o_custkey") % 10 == 0, F.concat(F.lit("Legacy "), "c_name"))
                         .otherwise(F.col("c_name")).alias("customer_name"))


def _sink_round_trip(m):
    """Two appends of disjoint halves, then read back."""
    path = scratch_path(m.spark, "scores")
    half = F.pmod(F.col("score_id"), F.lit(2))
    sinks.append_scores(m.scores.filter(half == 0), path)
    sinks.append_scores(m.scores.filter(half == 1), path)
    return m.spark.read.parquet(path).groupBy("scored_date").agg(
        F.count("*").alias("n"), fx.r6(F.sum("impact_score")).alias("total_impact"))


def _warnings_round_trip(m):
    path = scratch_path(m.spark, "warnings")
    sinks.write_warnings(q.quality_warnings(m.raw("orders"), ORDER_RULES(), "orders", "o_orderkey",
                                            F.lit("2024-01-01")), path)
    back = m.spark.read.schema("warned_at string, table_name string, row_id bigint, field string, reason string").json(path)
    return back.groupBy("table_name", "field", "reason").agg(F.count("*").alias("n"))


def _fixture_round_trip(m):
    """Suppliers written as CSV text and read back under the fixture schema, bad lines kept."""
    path = scratch_path(m.spark, "fixture")
    line = F.concat_ws(",", F.col("s_suppkey").cast("string"), "s_name",
                       F.when(F.col("s_suppkey") % 10 == 3, "n/a").otherwise(F.col("s_nationkey").cast("string")))
    m.raw("supplier").select(line.alias("value")).write.text(path)
    from pyspark.sql.types import IntegerType, LongType, StringType, StructField, StructType
    schema = StructType([StructField("supplier_id", LongType()), StructField("name", StringType()),
                         StructField("nation_id", IntegerType())])
    back = tables.read_fixture(m.spark, path, schema, header=False)
    return back.select("supplier_id", "name", "nation_id", F.col("_corrupt").isNotNull().alias("is_bad"))


def _metrics_round_trip(m):
    path = scratch_path(m.spark, "metrics")
    first = m.model_runs.filter(F.col("dataset_split") != "test")
    sinks.write_eval_metrics(first, path)
    sinks.write_eval_metrics(m.model_runs, path, m.spark.read.parquet(path))
    return m.spark.read.parquet(path).select("model_version", "metric_name", "dataset_split", "metric_value")


def register(cat) -> None:
    # -- sources -----------------------------------------------------------------------------
    cat.add("load", lambda m: m.raw("lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("double").alias("total")),
        """SELECT l_returnflag, l_linestatus, count(*) n,
           CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) total FROM lineitem GROUP BY 1, 2""")
    for name, cte in ADAPTED.items():
        cat.add(f"adapt_{name}", lambda m, n=name: getattr(m, n), ora(f"SELECT * FROM {cte}"))
    cat.add("read_fixture", _fixture_round_trip, """
        SELECT s_suppkey supplier_id, s_name AS name, CASE WHEN s_suppkey % 10 <> 3 THEN s_nationkey END nation_id,
          s_suppkey % 10 = 3 is_bad FROM supplier""")
    cat.add("append_scores", _sink_round_trip, ora("""
        SELECT CAST(scored_at AS DATE) scored_date, count(*) n, round(sum(impact_score), 6) total_impact
        FROM scores GROUP BY 1"""))
    cat.add("write_warnings", _warnings_round_trip, f"""
        SELECT 'orders' table_name, v.field AS field, v.reason reason, count(*) n FROM ({ORDER_VIOLATIONS}) WHERE v IS NOT NULL
        GROUP BY 1, 2, 3""")
    cat.add("write_eval_metrics", _metrics_round_trip, ora("""
        SELECT model_version, metric_name, dataset_split, max(metric_value) metric_value FROM model_runs GROUP BY 1, 2, 3"""))
    cat.add("changed_since", lambda m: tables.changed_since({
        "shipments": (m.shipments, "shipment_id", "created_at", "ship_date"),
        "orders": (m.orders, "order_id", "placed_at", "placed_at"),
    }, F.lit("2001-06-30").cast("date")), ora("""
        SELECT 'shipments' table_name, shipment_id row_id,
          CASE WHEN created_at > DATE '2001-06-30' THEN 'insert' ELSE 'update' END operation FROM shipments
        WHERE ship_date > DATE '2001-06-30' OR created_at > DATE '2001-06-30'
        UNION ALL SELECT 'orders', order_id, 'insert' FROM ord WHERE placed_at > DATE '2001-06-30'"""))
    def two_states(m):
        """Before: a seventh of the rows is not there and a fifth has other values; after: an eleventh is gone."""
        frames = {"orders": (m.orders, "order_id", "order_value"), "customers": (m.customers, "customer_id", "acct_balance"),
                  "suppliers": (m.raw("supplier"), "s_suppkey", "s_acctbal"), "components": (m.raw("part"), "p_partkey", "p_retailprice"),
                  "documents": (m.raw("documents"), "doc_id", "source")}
        state = lambda df, k, v: (df.filter(F.col(k) % 7 != 0).withColumn(v, F.when(F.col(k) % 5 != 0, F.col(v))), df.filter(F.col(k) % 11 != 0), k)
        return {name: state(*f) for name, f in frames.items()}
    cat.add("snapshot_changes", lambda m: tables.snapshot_changes(two_states(m)), " UNION ALL ".join(f"""
        SELECT '{name}' table_name, CAST({k} AS VARCHAR) row_id, CASE WHEN {k} % 7 = 0 THEN 'insert' WHEN {k} % 11 = 0 THEN 'delete' ELSE 'update' END operation
        FROM {t} WHERE ({k} % 7 = 0) <> ({k} % 11 = 0) OR ({k} % 5 = 0 AND {k} % 7 <> 0 AND {k} % 11 <> 0 AND {v} IS NOT NULL)""" for name, t, k, v in (
        ("orders", "orders", "o_orderkey", "o_totalprice"), ("customers", "customer", "c_custkey", "c_acctbal"), ("suppliers", "supplier", "s_suppkey", "s_acctbal"),
        ("components", "part", "p_partkey", "p_retailprice"), ("documents", "documents", "doc_id", "source"))))
    cat.add("page", lambda m: tables.page(m.orders, [F.col("order_value").desc(), F.col("order_id")], 2, 20), ora("""
        SELECT *, 2 page, 20 page_size, (SELECT count(*) FROM ord) total FROM ord
        ORDER BY order_value DESC, order_id LIMIT 20 OFFSET 20"""))

    # -- quality -----------------------------------------------------------------------------
    cat.add("dedup_by_key", lambda m: m.lines, ora("SELECT * FROM lines"))
    cat.add("coerce_types", lambda m: q.coerce_types(
        m.raw("documents").select("doc_id", F.regexp_replace("source", "^src1", "").alias("source_no"),
                                  F.col("n_chars").cast("string").alias("n_chars")),
        {"source_no": "int", "n_chars": "bigint"}), """
        SELECT doc_id, TRY_CAST(s AS INTEGER) source_no, n_chars,
          CASE WHEN s IS NOT NULL AND TRY_CAST(s AS INTEGER) IS NULL THEN 'source_no' ELSE '' END bad_fields
        FROM (SELECT doc_id, regexp_replace("source", '^src1', '') s, n_chars FROM documents)""")
    cat.add("default_fill", lambda m: q.default_fill(
        m.raw("documents").join(m.raw("labels"), "doc_id", "left").select(
            "doc_id", "quality", "toxic", F.when(F.col("quality") == 1, F.lit(float("nan")))
            .otherwise(F.col("toxic").cast("double")).alias("weight")),
        {"quality": -1, "toxic": 0, "weight": 0.5}), """
        SELECT d.doc_id, coalesce(quality, -1) quality, coalesce(toxic, 0) toxic,
          CASE WHEN quality = 1 OR toxic IS NULL THEN 0.5::DOUBLE ELSE toxic::DOUBLE END weight
        FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""")

    def quarantine(m):
        good, bad = q.quarantine(m.raw("lineitem"), LINE_RULES())
        tally = lambda df, side, n: df.groupBy("l_returnflag").agg(
            F.count("*").alias("n_rows"), F.sum(n).cast("bigint").alias("n_violations")).withColumn("side", F.lit(side))
        return tally(good, "good", F.lit(0)).unionByName(tally(bad, "bad", F.size("violations")))
    cat.add("quarantine", quarantine, """
        SELECT l_returnflag, CASE WHEN k > 0 THEN 'bad' ELSE 'good' END side, count(*) n_rows, CAST(sum(k) AS BIGINT) n_violations
        FROM (SELECT l_returnflag, CAST(l_quantity > 45 AS INT) + CAST(l_discount > 0.08 AS INT)
              + CAST(l_shipdate < TIMESTAMP '1995-02-01' AS INT) k FROM lineitem) GROUP BY 1, 2""")
    cat.add("quality_warnings", lambda m: q.quality_warnings(
        m.raw("orders"), ORDER_RULES(), "orders", "o_orderkey", F.lit("2024-01-01").cast("date")), f"""
        SELECT DATE '2024-01-01' warned_at, 'orders' table_name, row_id, v.field AS field, v.reason reason
        FROM ({ORDER_VIOLATIONS}) WHERE v IS NOT NULL""")
    cat.add("check_constraints", lambda m: q.check_constraints(
        m.raw("lineitem"), LINE_RULES(), {"order and line": ["l_orderkey", "l_linenumber"]}), """
        SELECT 'l_quantity: above 45' constraint_name, count(*) FILTER (l_quantity > 45) violations FROM lineitem
        UNION ALL SELECT 'l_discount: above 0.08', count(*) FILTER (l_discount > 0.08) FROM lineitem
        UNION ALL SELECT 'l_shipdate: before 1995-02-01', count(*) FILTER (l_shipdate < TIMESTAMP '1995-02-01') FROM lineitem
        UNION ALL SELECT 'order and line: unique', count(*) FROM
          (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)""")
    cat.add("foreign_key_orphans", lambda m: q.foreign_key_orphans(
        m.raw("documents").select("doc_id", "lang"), m.raw("labels"), "doc_id", "doc_id"),
        "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
    cat.add("polymorphic_orphans", lambda m: q.polymorphic_orphans(
        m.scores.select("score_id", "entity_type", "entity_id"),
        {"supplier": (m.raw("supplier"), "s_suppkey"), "product": (m.raw("nation"), "n_nationkey"),
         "order": (m.raw("orders"), "o_orderkey"), "shipment": (m.shipments, "shipment_id")}), ora("""
        SELECT score_id, entity_type, entity_id FROM scores s WHERE
          (entity_type = 'supplier' AND entity_id NOT IN (SELECT s_suppkey FROM supplier)) OR
          (entity_type = 'product' AND entity_id NOT IN (SELECT n_nationkey FROM nation)) OR
          (entity_type = 'order' AND entity_id NOT IN (SELECT o_orderkey FROM orders)) OR
          (entity_type = 'shipment' AND entity_id NOT IN (SELECT shipment_id FROM shipments))"""))
    cat.add("backfill_customers", lambda m: q.backfill_customers(
        _legacy(m), m.raw("customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"))), """
        WITH legacy AS (SELECT DISTINCT CASE WHEN o_custkey % 10 = 0 THEN 'Legacy ' || c_name ELSE c_name END AS name
                        FROM orders JOIN customer ON c_custkey = o_custkey)
        SELECT coalesce(k, CAST('0x' || substr(md5(l.name), 1, 15) AS BIGINT)) customer_id, l.name AS name, k IS NULL is_new
        FROM legacy l LEFT JOIN (SELECT c_name, min(c_custkey) k FROM customer GROUP BY 1) c ON c.c_name = l.name""")

    def mutation(m):
        after = m.scores.filter(F.col("score_id") % 101 != 0).withColumn(
            "impact_score", F.when(F.col("score_id") % 97 == 0, F.col("impact_score") + 0.1).otherwise(F.col("impact_score")))
        return q.mutation_audit(m.scores, after, "score_id")
    cat.add("mutation_audit", mutation, """
        SELECT event_id score_id, CASE WHEN event_id % 101 = 0 THEN 'deleted' ELSE 'altered' END change
        FROM events WHERE event_id % 101 = 0 OR event_id % 97 = 0""")
    cat.add("detail_completeness", lambda m: q.detail_completeness(
        m.customers, "customer_id", {
            "orders": m.orders.select("customer_id"),
            "open orders": m.orders.filter(F.col("status") == "open").select("customer_id")}), ora("""
        SELECT customer_id, 'orders' missing FROM customers WHERE customer_id NOT IN (SELECT customer_id FROM ord)
        UNION ALL SELECT customer_id, 'open orders' FROM customers
        WHERE customer_id NOT IN (SELECT customer_id FROM ord WHERE status = 'open')"""))
    cat.add("trend_gaps", lambda m: q.trend_gaps(m.scores, 1), ora("""
        SELECT *, CAST(day - previous_day AS INTEGER) gap_days FROM (
          SELECT entity_type, entity_id, day, lag(day) OVER (PARTITION BY entity_type, entity_id ORDER BY day) previous_day
          FROM (SELECT DISTINCT entity_type, entity_id, CAST(scored_at AS DATE) AS day FROM scores))
        WHERE day - previous_day > 1"""))
    cat.add("redact", lambda m: q.redact(m.raw("documents").select("doc_id", "text"), ["text"]).select(
        "doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")), r"""
        SELECT doc_id, md5(t) text_md5, CAST(length(t) AS INTEGER) n_chars FROM (SELECT doc_id,
          regexp_replace(regexp_replace(text, '(?i)(password|passwd|token|secret|api_key|apikey)\s*[=:]\s*[^\s]+', '\1=[redacted]', 'g'),
                         '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}', '[redacted]', 'g') t FROM documents)""")

    # -- features ----------------------------------------------------------------------------
    cat.add("minmax_scale", lambda m: ft.minmax_scale(m.raw("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
            .withColumn("o_totalprice_scaled", fx.r6(F.col("o_totalprice_scaled"))), """
        SELECT o_orderkey, o_totalprice, round((o_totalprice - lo) / (hi - lo), 6) o_totalprice_scaled
        FROM orders, (SELECT min(o_totalprice) lo, max(o_totalprice) hi FROM orders)""")
    cat.add("zscore_scale", lambda m: ft.zscore_scale(m.raw("orders").select("o_orderkey", "o_totalprice"), "o_totalprice")
            .withColumn("o_totalprice_z", fx.r6(F.col("o_totalprice_z"))), """
        SELECT o_orderkey, o_totalprice, round((o_totalprice - mu) / sd, 6) + 0.0 o_totalprice_z
        FROM orders, (SELECT avg(o_totalprice) mu, stddev_samp(o_totalprice) sd FROM orders)""")
    cat.add("reliability_history", lambda m: ft.reliability_history(m.shipments, 10), ora("""
        SELECT supplier_id, shipment_id, delivered_at,
          round(avg(CASE WHEN delivered_at <= eta THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY supplier_id
            ORDER BY delivered_at, shipment_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) reliability
        FROM shipments WHERE delivered_at IS NOT NULL"""))
    cat.add("reliability_now", lambda m: ft.reliability_now(m.shipments, 10), ora("SELECT * FROM reliability_now"))
    cat.add("days_to", lambda m: ft.days_to(ft.days_to(
        m.shipments.select("shipment_id", "eta", "status"), "eta", m.as_of, "days_to_eta"),
        "eta", F.lit("2000-01-01").cast("date"), "days_to_cutoff"), ora("""
        SELECT shipment_id, eta, status, CAST(eta - (SELECT d FROM snap) AS INTEGER) days_to_eta,
          CAST(eta - DATE '2000-01-01' AS INTEGER) days_to_cutoff FROM shipments"""))
    cat.add("one_hot", lambda m: ft.one_hot(m.customers.select("customer_id", "priority_tier"), "priority_tier", ft.TIERS), ora("""
        SELECT customer_id, priority_tier, CAST(priority_tier = 'strategic' AS INT) priority_tier_strategic,
          CAST(priority_tier = 'standard' AS INT) priority_tier_standard, CAST(priority_tier = 'low' AS INT) priority_tier_low
        FROM customers"""))
    cat.add("bucket_top_k", lambda m: ft.bucket_top_k(
        m.raw("supplier").join(m.raw("nation"), F.col("n_nationkey") == F.col("s_nationkey")).select(
            "s_suppkey", F.col("n_name").alias("country")), "country", 8), """
        WITH s AS (SELECT s_suppkey, n_name country FROM supplier JOIN nation ON n_nationkey = s_nationkey),
        t AS (SELECT country, row_number() OVER (ORDER BY count(*) DESC, country) rn FROM s GROUP BY 1 QUALIFY rn <= 8)
        SELECT s_suppkey, s.country country, CASE WHEN rn IS NULL THEN 'other' ELSE s.country END country_bucket,
          CAST(coalesce(rn, 9) AS INTEGER) country_slot FROM s LEFT JOIN t ON t.country = s.country""")
    cat.add("label_delayed", lambda m: ft.label_delayed(m.shipments).groupBy("supplier_id", "status", "is_delayed").agg(
        F.count("*").alias("n")), ora("SELECT supplier_id, status, is_delayed, count(*) n FROM late_labels GROUP BY 1, 2, 3"))
    cat.add("label_shortage", lambda m: ft.label_shortage(m.inventory, m.items, m.orders), ora("""
        SELECT i.*, stock_level < reorder_threshold AND product_id IN (
          SELECT product_id FROM items JOIN ord USING (order_id) WHERE ord.status = 'open') is_shortage FROM inventory i"""))
    cat.add("demand_spike", lambda m: ft.demand_spike(m.items, 6), ora("""
        SELECT product_id, month, quantity, round(mb, 6) mean_before, round(sb, 6) sd_before,
          round((quantity - mb) / nullif(sb, 0), 6) + 0.0 spike FROM (
          SELECT *, avg(quantity) OVER w mb, stddev_samp(quantity) OVER w sb FROM (
            SELECT product_id, CAST(date_trunc('month', ship_date) AS DATE) AS month, CAST(sum(quantity) AS BIGINT) quantity
            FROM items GROUP BY 1, 2)
          WINDOW w AS (PARTITION BY product_id ORDER BY month ROWS BETWEEN 6 PRECEDING AND 1 PRECEDING))"""))
    cat.add("inventory_risk", lambda m: ft.inventory_risk(m.inventory), ora("SELECT * FROM cell_risk"))
    cat.add("financial_risk", lambda m: ft.financial_risk(
        m.raw("supplier").select("s_suppkey", "s_acctbal"), "s_acctbal", F.col("s_acctbal") >= 0), """
        SELECT s_suppkey, s_acctbal, CASE WHEN s_acctbal >= 0 THEN round((hi - s_acctbal) / (hi - lo), 6) END financial_risk
        FROM supplier, (SELECT min(s_acctbal) lo, max(s_acctbal) hi FROM supplier)""")

    def as_of(m):
        hist = ft.reliability_history(m.shipments, 10)
        # the last value of a day stands for the day
        daily = hist.groupBy("supplier_id", "delivered_at").agg(F.max_by("reliability", "shipment_id").alias("reliability"))
        return ft.as_of_features(m.shipments, daily, "supplier_id", "created_at", "shipment_id", "delivered_at", "reliability")
    cat.add("as_of_features", as_of, ora("""
        SELECT f.supplier_id, f.shipment_id, f.created_at, h.reliability FROM shipments f ASOF LEFT JOIN (
          SELECT supplier_id, delivered_at, reliability FROM (
            SELECT *, round(avg(CASE WHEN delivered_at <= eta THEN 1.0 ELSE 0.0 END) OVER (PARTITION BY supplier_id
                ORDER BY delivered_at, shipment_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), 6) reliability,
              row_number() OVER (PARTITION BY supplier_id, delivered_at ORDER BY shipment_id DESC) rn
            FROM shipments WHERE delivered_at IS NOT NULL) WHERE rn = 1) h
        ON f.supplier_id = h.supplier_id AND f.created_at > h.delivered_at"""))
    vector_sql = {
        "order": """SELECT CAST(order_id AS VARCHAR) node_id, 6 n_features, CAST(due_at - (SELECT d FROM snap) AS DOUBLE) f1,
            CAST(status = 'open' AS DOUBLE) f2, CAST(status = 'fulfilled' AS DOUBLE) f3,
            round((order_value - (SELECT min(o_totalprice) FROM orders)) /
              ((SELECT max(o_totalprice) FROM orders) - (SELECT min(o_totalprice) FROM orders)), 6) f_last FROM ord""",
        "shipment": """SELECT CAST(shipment_id AS VARCHAR) node_id, 5 n_features, CAST(eta - (SELECT d FROM snap) AS DOUBLE) f1,
            0.0::DOUBLE f2, CAST(status = 'in_transit' AS DOUBLE) f3, CAST(status = 'delayed' AS DOUBLE) f_last FROM shipments""",
        "supplier": """SELECT CAST(s.supplier_id AS VARCHAR) node_id, 18 n_features,
            round((lead_time_days - (SELECT min(lead_time_days) FROM suppliers)) /
              ((SELECT max(lead_time_days) FROM suppliers) - (SELECT min(lead_time_days) FROM suppliers)), 6) f1,
            coalesce(reliability, 0.5::DOUBLE) f2,
            round((capacity_score - (SELECT min(capacity_score) FROM suppliers)) /
              ((SELECT max(capacity_score) FROM suppliers) - (SELECT min(capacity_score) FROM suppliers)), 6) f3,
            CASE WHEN country IN (SELECT country FROM suppliers GROUP BY 1 ORDER BY count(*) DESC, country LIMIT 14)
              THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END f_last
            FROM suppliers s LEFT JOIN reliability_now r ON r.supplier_id = s.supplier_id""",
    }
    for t, sql in vector_sql.items():
        cat.add(f"feature_vector_{t}", lambda m, t=t: ft.feature_vector(m, t).select(
            "node_id", F.size("features").alias("n_features"),
            *[fx.r6(F.element_at("features", i)).alias(f"f{i}") for i in (1, 2, 3)],
            fx.r6(F.element_at("features", -1)).alias("f_last")), ora(sql))
    cat.add("time_split", lambda m: ft.time_split(
        m.shipments.select("shipment_id", "created_at"), "created_at", F.lit("1999-06-30").cast("date"),
        F.lit("2000-06-30").cast("date")), ora("""
        SELECT shipment_id, created_at, CASE WHEN created_at < DATE '1999-06-30' THEN 'train'
          WHEN created_at < DATE '2000-06-30' THEN 'validation' ELSE 'test' END split FROM shipments"""))
    cat.add("order_line_features", lambda m: ft.order_line_features(
        m.orders.select("order_id", "status"), m.lines), ora("""
        SELECT o.order_id, o.status, count(l.order_id) n_lines, CAST(coalesce(sum(quantity), 0) AS BIGINT) n_units
        FROM ord o LEFT JOIN lines l ON l.order_id = o.order_id GROUP BY 1, 2"""))
