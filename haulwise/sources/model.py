"""The canonical supply-chain tables, derived from the source tables.

Every table is a lazy DataFrame, built on first use. Only the columns a query
touches are read: Catalyst prunes through the whole derivation.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import columns as fx
from ..plans.windows import latest_per_key, top_per_key
from ..session import spread, written
from .tables import load

# Contract terms by market segment; FURNITURE has no contract.
CONTRACTS = {
    "MACHINERY": (7, 0.10),
    "AUTOMOBILE": (10, 0.08),
    "BUILDING": (14, 0.05),
    "HOUSEHOLD": (21, 0.03),
}

HISTORY_DAYS = 2500
HISTORY_MONTHS = 82
CHUNK_SIZE, CHUNK_OVERLAP = 400, 50


class Model:
    """Canonical tables over one source folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._raw: dict[str, DataFrame] = {}

    def raw(self, name: str) -> DataFrame:
        """A source table; its files are listed once per model."""
        if name not in self._raw:
            self._raw[name] = load(self.spark, self.folder, name)
        return self._raw[name]

    def written(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a table in the shared folder."""
        return written(df, name)

    @cached_property
    def staged(self) -> "Model":
        """The same tables over order lines that were deduplicated once and written.

        Plans that read the lines several times would repeat the shuffle of the
        largest table for each use, because each use prunes other columns.
        """
        out = Model(self.spark, self.folder)
        out.__dict__["lines"] = self.written(self.lines, "lines")
        out.__dict__["staged"] = out
        return out

    @cached_property
    def index(self) -> DataFrame:
        """The evidence chunks with their number of index terms as a written table: retrieval
        reads it several times, and column by column."""
        return written(self.chunks.withColumn("n_terms", F.size(fx.terms(F.col("chunk_text")))), "chunks", "zstd")

    @cached_property
    def postings(self):
        """Inverted index of the evidence chunks, written in blocks."""
        from ..operators.evidence import keyword_index
        return keyword_index(self.index, lambda df: written(df, "postings", "zstd"))

    @cached_property
    def cells(self):
        """Vector index of the evidence chunks, written by cell."""
        from ..operators.evidence import vector_index
        return vector_index(self.index)

    @property
    def as_of(self) -> Column:
        """Snapshot date: the newest ship date, as a scalar subquery."""
        return self.raw("lineitem").agg(F.max("l_shipdate").alias("d")).scalar()

    @cached_property
    def lines(self) -> DataFrame:
        """Order lines with one row per (order, line number); newest row wins."""
        li = self.raw("lineitem").select(
            F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line_no"),
            F.col("l_shipdate").alias("ship_date"), F.col("l_partkey").alias("component_id"),
            F.col("l_suppkey").alias("supplier_id"), F.col("l_quantity").cast("int").alias("quantity"),
            F.col("l_returnflag").alias("return_flag"), F.col("l_linestatus").alias("line_status"))
        return latest_per_key(li, ["order_id", "line_no"], [
            F.col("ship_date").desc(), F.col("component_id"), F.col("supplier_id"),
            F.col("quantity"), F.col("return_flag"), F.col("line_status")])

    @cached_property
    def items(self) -> DataFrame:
        """Order items: lines with the product (brand) of their component."""
        parts = self.raw("part").select(F.col("p_partkey").alias("component_id"),
                                        F.col("p_brand").alias("product_id"))
        return self.lines.join(parts, "component_id")

    @cached_property
    def shipments(self) -> DataFrame:
        """One shipment per order line."""
        delivered = F.col("line_status") == "F"
        created = F.date_sub(F.col("ship_date").cast("date"), F.col("quantity"))
        eta = F.date_add(created, 30)
        return self.lines.select(
            (F.col("order_id") * 10 + F.col("line_no")).alias("shipment_id"),
            "order_id", "supplier_id", "component_id", "quantity", "return_flag",
            F.col("ship_date").cast("date").alias("ship_date"),
            created.alias("created_at"), eta.alias("eta"),
            F.when(delivered, F.col("ship_date").cast("date")).alias("delivered_at"),
            F.when(delivered & (F.col("ship_date").cast("date") > eta), "delayed")
            .when(delivered, "delivered").otherwise("in_transit").alias("status"))

    @cached_property
    def routed(self) -> DataFrame:
        """Shipments with product, origin factory and destination warehouse."""
        sup = self.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                          F.col("s_nationkey").alias("factory_id"))
        cust = self.raw("customer").select(F.col("c_custkey").alias("customer_id"),
                                           F.col("c_nationkey").alias("warehouse_id"))
        orders = self.raw("orders").select(F.col("o_orderkey").alias("order_id"),
                                           F.col("o_custkey").alias("customer_id"))
        parts = self.raw("part").select(F.col("p_partkey").alias("component_id"),
                                        F.col("p_brand").alias("product_id"))
        dest = orders.join(cust, "customer_id")
        return self.shipments.join(parts, "component_id").join(sup, "supplier_id").join(dest, "order_id")

    @cached_property
    def suppliers(self) -> DataFrame:
        """Suppliers with country, lead time over the last 10 shipments and capacity."""
        last10 = top_per_key(self.shipments.select("supplier_id", "ship_date", "shipment_id", "quantity"),
                             ["supplier_id"], [F.col("ship_date").desc(), F.col("shipment_id").desc()], 10)
        lead = last10.groupBy("supplier_id").agg(F.round(F.avg("quantity")).cast("int").alias("lead_time_days"))
        cap = self.lines.groupBy("supplier_id").agg(
            F.round(F.sum("quantity") / F.lit(1000.0), 3).alias("capacity_score"))
        nation = self.raw("nation").select(F.col("n_nationkey").alias("nation_id"), F.col("n_name").alias("country"))
        base = self.raw("supplier").select(
            F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("name"),
            F.col("s_nationkey").alias("nation_id"), F.col("s_acctbal").alias("acct_balance"),
            (F.col("s_acctbal") >= 0).alias("is_active"))
        return (base.join(nation, "nation_id").join(lead, "supplier_id", "left").join(cap, "supplier_id", "left")
                .drop("nation_id"))

    @cached_property
    def components(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_partkey").alias("component_id"), F.col("p_name").alias("name"),
            F.col("p_type").alias("component_type"), F.col("p_retailprice").alias("unit_cost"))

    @cached_property
    def supplier_components(self) -> DataFrame:
        return self.lines.select("supplier_id", "component_id").distinct()

    @cached_property
    def products(self) -> DataFrame:
        """One product per brand; category is its most frequent component type."""
        counts = self.raw("part").groupBy(F.col("p_brand").alias("product_id"),
                                          F.col("p_type").alias("category")).count()
        return latest_per_key(counts, ["product_id"], [F.col("count").desc(), F.col("category")]).drop("count")

    @cached_property
    def product_components(self) -> DataFrame:
        return self.raw("part").select(
            F.col("p_brand").alias("product_id"), F.col("p_partkey").alias("component_id"),
            F.col("p_size").alias("quantity_required"))

    @cached_property
    def factories(self) -> DataFrame:
        """One factory per supplier nation."""
        sup = self.raw("supplier").select(F.col("s_suppkey").alias("supplier_id"),
                                          F.col("s_nationkey").alias("factory_id"))
        qty = self.lines.groupBy("supplier_id").agg(F.sum("quantity").alias("q"))
        cap = sup.join(qty, "supplier_id", "left").groupBy("factory_id").agg(
            F.ceil(F.coalesce(F.sum("q"), F.lit(0)) / F.lit(float(HISTORY_DAYS))).cast("int")
            .alias("capacity_units_per_day"))
        nation = self.raw("nation").select(F.col("n_nationkey").alias("factory_id"), F.col("n_name").alias("location"))
        return cap.join(nation, "factory_id")

    @cached_property
    def warehouses(self) -> DataFrame:
        """One warehouse per customer nation."""
        cap = self.routed.groupBy("warehouse_id").agg(F.sum("quantity").alias("capacity_units"))
        sites = self.raw("customer").select(F.col("c_nationkey").alias("warehouse_id")).distinct()
        nation = self.raw("nation").select(F.col("n_nationkey").alias("warehouse_id"), F.col("n_name").alias("location"))
        return (sites.join(cap, "warehouse_id", "left").join(nation, "warehouse_id")
                .withColumn("capacity_units", F.coalesce("capacity_units", F.lit(0))))

    @cached_property
    def inventory(self) -> DataFrame:
        recent_return = (F.col("return_flag") == "R") & (
            F.col("ship_date") > F.date_sub(self.as_of.cast("date"), 90))
        return self.routed.groupBy("product_id", "warehouse_id").agg(
            F.coalesce(F.sum(F.when(recent_return, F.col("quantity"))), F.lit(0)).alias("stock_level"),
            F.round(F.sum("quantity") / F.lit(float(HISTORY_MONTHS))).cast("bigint").alias("reorder_threshold"),
            F.max("ship_date").alias("updated_at"))

    @cached_property
    def customers(self) -> DataFrame:
        seg, sla, pen = F.col("c_mktsegment"), None, None
        for name, (days, pct) in CONTRACTS.items():
            sla = (F if sla is None else sla).when(seg == name, days)
            pen = (F if pen is None else pen).when(seg == name, pct)
        bal = F.col("c_acctbal")
        return self.raw("customer").select(
            F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("name"),
            F.col("c_nationkey").alias("warehouse_id"), bal.alias("acct_balance"),
            F.when(bal >= 6000, "strategic").when(bal >= 2500, "standard").otherwise("low").alias("priority_tier"),
            sla.alias("sla_days"), pen.alias("penalty_pct"))

    @cached_property
    def orders(self) -> DataFrame:
        st, placed = F.col("o_orderstatus"), F.col("o_orderdate").cast("date")
        urgent = F.substring("o_orderpriority", 1, 1).isin("1", "2")
        return self.raw("orders").select(
            F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"),
            F.when(st == "O", "open").when(st == "F", "fulfilled").when(st == "P", "at_risk").alias("status"),
            placed.alias("placed_at"), F.date_add(placed, F.when(urgent, 30).otherwise(60)).alias("due_at"),
            F.col("o_totalprice").alias("order_value"), F.col("o_orderpriority").alias("priority"))

    @cached_property
    def scores(self) -> DataFrame:
        """Append-only score history, one row per scoring event."""
        k = F.get_json_object("props", "$.k").cast("int")
        types = F.array(*[F.lit(t) for t in ("supplier", "product", "order", "shipment")])
        return self.raw("events").select(
            F.col("event_id").alias("score_id"),
            F.element_at(types, (F.col("user_id") % 4 + 1).cast("int")).alias("entity_type"),
            F.col("user_id").alias("entity_id"), F.col("ts").alias("scored_at"),
            F.round(k / F.lit(99.0), 4).alias("delay_probability"),
            F.round((k * 7) % 100 / F.lit(99.0), 4).alias("shortage_risk"),
            F.round(F.least(F.col("value") / F.lit(500.0), F.lit(1.0)), 4).alias("impact_score"))

    @cached_property
    def audit_log(self) -> DataFrame:
        et = F.col("event_type")
        return self.raw("events").select(
            F.col("event_id").alias("audit_id"), F.col("user_id").alias("actor_id"),
            F.when(et == "error", "login_failed").when(et == "signup", "login_success")
            .when(et == "purchase", "action_executed").otherwise(et).alias("event_type"),
            F.col("ts").alias("created_at"), F.col("props").alias("detail"))

    @cached_property
    def registry_history(self) -> DataFrame:
        """Status changes of model versions: one version per event user."""
        return self._statuses({"view": "training", "click": "evaluating", "signup": "candidate",
                               "purchase": "active", "error": "archived"}, "model_version")

    @cached_property
    def request_history(self) -> DataFrame:
        """Status changes of action requests: one request per event user."""
        return self._statuses({"view": "pending", "click": "approved", "signup": "rejected",
                               "purchase": "executed", "error": "failed"}, "request_id")

    def _statuses(self, names: dict[str, str], key: str) -> DataFrame:
        status = None
        for event, name in names.items():
            status = (F if status is None else status).when(F.col("event_type") == event, name)
        return self.raw("events").select(
            F.col("event_id").alias("change_id"), F.col("user_id").alias(key),
            status.alias("status"), F.col("ts").alias("changed_at"))

    @cached_property
    def model_runs(self) -> DataFrame:
        """Evaluation metric rows; version, architecture, metric and split from events."""
        arch = F.array(*[F.lit(a) for a in ("uniform", "attention", "typed")])
        metric = F.array(*[F.lit(a) for a in ("auc", "f1", "precision", "recall")])
        split = F.array(*[F.lit(a) for a in ("train", "validation", "test")])
        u, e = F.col("user_id"), F.col("event_id")
        return self.raw("events").select(
            e.alias("run_id"), F.concat(F.lit("v"), u.cast("string")).alias("model_version"),
            F.element_at(arch, (u % 3 + 1).cast("int")).alias("architecture"),
            F.element_at(metric, (e % 4 + 1).cast("int")).alias("metric_name"),
            F.element_at(split, (F.floor(e / 4) % 3 + 1).cast("int")).alias("dataset_split"),
            F.round(F.least(F.col("value") / F.lit(500.0), F.lit(1.0)), 6).alias("metric_value"),
            F.col("ts").alias("evaluated_at"))

    @cached_property
    def requests(self) -> DataFrame:
        """Action requests, one per order."""
        st, k = F.col("o_orderstatus"), F.col("o_orderkey")
        decided = st != "O"
        return self.raw("orders").select(
            k.alias("request_id"), F.lit("order").alias("entity_type"),
            F.col("o_custkey").alias("entity_id"), F.col("o_orderpriority").alias("source"),
            F.when(st == "O", "pending").when(st == "F", "approved").otherwise("rejected").alias("status"),
            F.when(decided & (k % 7 != 0), F.concat(F.lit('{"routed_to":"'), F.lower(F.substring("o_orderpriority", 3, 20)),
                                                     F.lit('"}'))).alias("decision_trace"),
            F.when(st == "P", F.when(k % 5 == 0, "  ").when(k % 5 != 1, "capacity")).alias("rejection_reason"),
            F.col("o_orderdate").alias("created_at"),
            F.when(decided, F.col("o_orderdate") + F.expr("INTERVAL 2 DAYS")).alias("decided_at"))

    @cached_property
    def action_log(self) -> DataFrame:
        """Execution attempts, one per delivered order line."""
        rf = F.col("return_flag")
        return self.lines.select(
            (F.col("order_id") * 10 + F.col("line_no")).alias("log_id"), F.col("order_id").alias("request_id"),
            F.when(rf == "A", "erp").when(rf == "N", "slack").otherwise("email").alias("target_system"),
            F.when(F.col("line_status") == "F", "success").otherwise("failure").alias("status"),
            F.col("ship_date").alias("executed_at"))

    @cached_property
    def chunks(self) -> DataFrame:
        """Evidence chunks of whole documents, with metadata and vector."""
        from ..operators.evidence import chunk
        n_sup = self.raw("supplier").agg(F.count("*").alias("n")).scalar()
        collection = F.array(*[F.lit(c) for c in ("incidents", "contracts", "supplier_history")])
        docs = spread(self.raw("documents").select("doc_id", "text"))
        vec = self.raw("embeddings").select(F.col("vec_id").alias("doc_id"),
                                            fx.doubles(F.col("embedding")).alias("embedding"))
        out = chunk(docs, "doc_id", "text", CHUNK_SIZE, CHUNK_OVERLAP)
        return out.select(
            (F.col("doc_id") * 100000 + F.col("chunk_index")).alias("chunk_id"), "doc_id", "chunk_index",
            F.element_at(collection, (F.col("doc_id") % 3 + 1).cast("int")).alias("collection"),
            (F.col("doc_id") % n_sup).alias("supplier_id"),
            F.date_add(F.lit("2024-01-01").cast("date"), (F.col("doc_id") % 365).cast("int")).alias("published_at"),
            "chunk_text", "n_tokens").join(vec, "doc_id", "left")

    @cached_property
    def questions(self) -> DataFrame:
        """Retrieval queries: benchmark texts with the vector of the same number."""
        vec = self.raw("embeddings").select(F.col("vec_id").alias("query_id"),
                                            fx.doubles(F.col("embedding")).alias("embedding"))
        q = self.raw("benchmark").select(F.col("item_id").alias("query_id"), "text")
        return q.join(vec, "query_id")

    @cached_property
    def supplier_signals(self) -> DataFrame:
        from ..operators.risk import supplier_signals
        return supplier_signals(self.staged)


def adapt(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """All canonical tables by name."""
    m = Model(spark, folder)
    names = ["lines", "items", "shipments", "routed", "suppliers", "components", "supplier_components",
             "products", "product_components", "factories", "warehouses", "inventory", "customers",
             "orders", "scores", "audit_log", "registry_history", "request_history", "model_runs",
             "requests", "action_log", "chunks", "questions", "supplier_signals"]
    return {n: getattr(m, n) for n in names}
