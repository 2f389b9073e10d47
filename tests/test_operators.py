"""Scenario fixtures and brute-force checks."""

import datetime as dt
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from haulwise.functions import columns as fx
from haulwise.operators import (
    alerts as al, decisions as dc, evidence as ev, features as ft, graph as g, learning as ln, quality as q,
    risk as rk, similarity as sm, traversal as tv, views as vw)

D = dt.date


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


# -- features and labels -----------------------------------------------------------------------

def ship(i, late, sup=1, day=None):
    eta = D(2024, 1, 1) + dt.timedelta(days=i)
    done = eta + dt.timedelta(days=2 if late else -2)
    return (sup, i, eta, done, "delayed" if late else "delivered")


SHIP = "supplier_id int, shipment_id int, eta date, delivered_at date, status string"


def test_reliability_of_ten_with_three_late(spark):
    df = spark.createDataFrame([ship(i, i in (2, 5, 8)) for i in range(10)], SHIP)
    assert ft.reliability_now(df, 10).first()["reliability"] == 0.7
    assert ft.reliability_history(df, 10).orderBy(F.desc("delivered_at")).first()["reliability"] == 0.7


def test_repeat_offender_is_below_half(spark):
    df = spark.createDataFrame([ship(i, i % 4 != 0) for i in range(20)], SHIP)
    assert ft.reliability_now(df).first()["reliability"] < 0.5


def test_label_delayed(spark):
    df = ft.label_delayed(spark.createDataFrame([ship(1, True), ship(2, False), (1, 3, D(2024, 1, 1), None, "in_transit")], SHIP))
    assert {r.shipment_id: r.is_delayed for r in df.collect()} == {1: True, 2: False, 3: False}


def test_label_shortage_needs_an_open_order(spark):
    inv = spark.createDataFrame([("a", 1, 10), ("b", 1, 10), ("c", 20, 10)], "product_id string, stock_level int, reorder_threshold int")
    items = spark.createDataFrame([(1, "a"), (2, "b"), (1, "c")], "order_id int, product_id string")
    orders = spark.createDataFrame([(1, "open"), (2, "fulfilled")], "order_id int, status string")
    got = {r.product_id: r.is_shortage for r in ft.label_shortage(inv, items, orders).collect()}
    assert got == {"a": True, "b": False, "c": False}


def test_scaling_of_a_constant_column(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "x double")
    assert {r.x_scaled for r in ft.minmax_scale(df, "x").collect()} == {0.0}
    assert {r.x_z for r in ft.zscore_scale(df, "x").collect()} == {0.0}


def test_bucket_top_k(spark):
    df = spark.createDataFrame([("a",)] * 3 + [("b",)] * 2 + [("c",)], "c string")
    assert {(r.c, r.c_bucket, r.c_slot) for r in ft.bucket_top_k(df, "c", 2).collect()} == {
        ("a", "a", 1), ("b", "b", 2), ("c", "other", 3)}


def test_as_of_sees_only_the_past(spark):
    facts = spark.createDataFrame([(1, D(2024, 1, 5), 10), (1, D(2024, 3, 1), 11)], "k int, at date, id bigint")
    hist = spark.createDataFrame([(1, D(2024, 1, 5), 0.9), (1, D(2024, 1, 20), 0.4)], "k int, done date, v double")
    got = {r.id: r.v for r in ft.as_of_features(facts, hist, "k", "at", "id", "done", "v").collect()}
    assert got == {10: None, 11: 0.4}


# -- quality -------------------------------------------------------------------------------------

def test_malformed_row_is_quarantined_with_one_warning(spark):
    df = q.coerce_types(spark.createDataFrame([(1, "5"), (2, "x")], "id int, qty string"), {"qty": "int"})
    rules = [q.Rule("qty", "bad type", F.col("bad_fields") != "")]
    good, bad = q.quarantine(df, rules)
    assert [r.id for r in good.collect()] == [1] and [r.id for r in bad.collect()] == [2]
    assert q.quality_warnings(df, rules, "t", "id", F.lit(None).cast("date")).count() == 1


def test_backfill_gives_each_name_one_customer(spark):
    orders = spark.createDataFrame([("Ann",), ("Ann",), ("Bob",)], "customer_name string")
    known = spark.createDataFrame([(7, "Ann")], "customer_id bigint, name string")
    got = {r.name: (r.customer_id, r.is_new) for r in q.backfill_customers(orders, known).collect()}
    assert got["Ann"] == (7, False) and got["Bob"][1] and len(got) == 2


def test_two_weeks_of_daily_scores_have_no_gap(spark):
    rows_ = [("supplier", 1, dt.datetime(2024, 1, d)) for d in range(1, 15)]
    df = spark.createDataFrame(rows_, "entity_type string, entity_id int, scored_at timestamp")
    assert q.trend_gaps(df).count() == 0
    assert q.trend_gaps(df.filter("scored_at <> timestamp '2024-01-07'")).first()["gap_days"] == 2


def test_redact(spark):
    df = spark.createDataFrame([("mail a.b@c.io password=hunter2 ok",)], "t string")
    assert q.redact(df, ["t"]).first().t == "mail [redacted] password=[redacted] ok"


# -- graph ---------------------------------------------------------------------------------------

def test_graph_has_eight_and_nine_types_without_nan(spark, folder):
    from haulwise.sources.model import Model
    m = Model(spark, folder)
    nodes, edges = g.build_nodes(m), g.build_edges(m)
    assert {r.node_type for r in nodes.select("node_type").distinct().collect()} == set(g.NODE_TYPES)
    assert {r.edge_type for r in edges.select("edge_type").distinct().collect()} == set(g.EDGE_TYPES)
    assert nodes.filter(F.exists("features", lambda x: x.isNull() | F.isnan(x))).count() == 0
    assert nodes.groupBy("node_type").agg(F.count_distinct(F.size("features")).alias("n")).filter("n > 1").count() == 0
    ids = g.node_id_map(nodes).groupBy("node_type").agg(F.max("node_index").alias("m"), F.count_distinct("node_index").alias("n"))
    assert ids.filter("m + 1 <> n").count() == 0


def test_ambiguous_factory_is_a_warning_and_no_edge(spark):
    df = spark.createDataFrame([(1, "p", 5), (2, "r", 5), (2, "r", 6)], "order_id int, product_id string, factory_id int")
    edges, warnings = g.infer_manufactured_at(df)
    assert rows(edges) == [("p", 5)] and [r.row_id for r in warnings.collect()] == [2]


EDGE = "edge_type string, src_type string, src string, dst_type string, dst string"


def test_validation_lists_orphan_dangling_and_zero(spark):
    nodes = spark.createDataFrame([("a", "1", [1.0]), ("a", "2", [0.0]), ("a", "3", [1.0])], "node_type string, node_id string, features array<double>")
    edges = spark.createDataFrame([("E", "a", "1", "a", "9"), ("E", "a", "1", "a", "2")], EDGE)
    assert rows(g.validate_graph(nodes, edges)) == [
        ("a", "2", "all_zero"), ("a", "3", "orphan_node"), ("a", "9", "dangling_edge")]


def test_merge_is_idempotent_on_random_batches(spark):
    rnd = random.Random(1)
    schema = "k int, v int, version int"
    target = spark.createDataFrame([(k, rnd.randrange(9), 0) for k in range(30)], schema)
    batch = spark.createDataFrame([(rnd.randrange(40), rnd.randrange(9), rnd.randrange(1, 4)) for _ in range(60)], schema)
    once = g.merge_idempotent(target, batch, ["k"], "version")
    twice = g.merge_idempotent(once, batch, ["k"], "version")
    assert g.graph_equal(once, twice).count() == 0
    changed = once.intersect(target).count()
    assert changed == 30 - batch.filter("k < 30").select("k").distinct().count()


def test_blast_radius_stops_at_the_hop_limit_and_handles_cycles(spark):
    edges = spark.createDataFrame([("E", "n", str(i), "n", str((i + 1) % 6)) for i in range(6)], EDGE)
    seeds = spark.createDataFrame([("n", "0")], "node_type string, node_id string")
    assert {(r.node_id, r.hop) for r in tv.blast_radius(edges, seeds, 3).collect()} == {("0", 0), ("1", 1), ("2", 2), ("3", 3)}
    assert tv.blast_radius(edges, seeds, 50).count() == 6


# -- scoring ---------------------------------------------------------------------------------------

def test_boundaries_go_up_and_confidence_grows_from_the_middle(spark):
    df = spark.createDataFrame([(0.25,), (0.5,), (0.75,), (0.2499,), (1.0,), (0.0,)], "s double")
    got = {r.s: (r.risk_category, r.confidence) for r in rk.scored(df, "s").collect()}
    assert [got[s][0] for s in (0.2499, 0.25, 0.5, 0.75)] == ["low", "medium", "high", "critical"]
    assert got[0.5][1] == 0 and got[1.0][1] == 1 and got[0.0][1] == 1


SIG = "supplier_id int, name string, supplier_risk double, delay_risk double, inventory_risk double, demand_risk double, financial_risk double"


def test_formula_and_redistribution(spark):
    df = spark.createDataFrame([(1, "a", 1.0, 0.5, 0.0, 1.0, 0.2), (2, "b", 0.5, 0.5, 0.5, 0.5, None), (3, "c", None, None, None, None, None)], SIG)
    plain = {r.supplier_id: r.impact_score for r in rk.weighted_formula(df).collect()}
    shared = {r.supplier_id: r.impact_score for r in rk.redistribute_weights(df).collect()}
    assert plain[1] == shared[1] == 0.595 and plain[2] is None and shared[2] == 0.5
    new = {r.supplier_id: r for r in rk.enrich(df).collect()}[3]
    assert new.confidence == 0 and new.risk_category != "critical" and new.scoring_method == "native"


def test_attribution_weights_sum_to_one(spark):
    values = spark.createDataFrame([(str(i), float(i)) for i in range(6)], "node_id string, x double")
    edges = spark.createDataFrame([(str(i), "t") for i in range(5)] + [("5", "u")], "src string, dst string")
    got = rk.attribution(values, edges, "x").groupBy("dst").agg(F.sum("weight").alias("w")).collect()
    assert all(abs(r.w - 1) < 1e-5 for r in got) and len(got) == 2


def test_unknown_filters_are_rejected(spark):
    with pytest.raises(ValueError):
        vw.RiskFilter(("severe",)).condition()
    with pytest.raises(ValueError):
        vw.list_entities(spark.range(1), [], ["severe"])


# -- alerts ------------------------------------------------------------------------------------------

def test_one_alert_per_breach_and_none_below(spark):
    scores = spark.createDataFrame([(1, "supplier", 1, dt.datetime(2024, 1, 1), 0.9, 0.0, 0.0), (2, "supplier", 2, dt.datetime(2024, 1, 1), 0.79, 0.0, 0.0)],
                                   "score_id int, entity_type string, entity_id int, scored_at timestamp, delay_probability double, shortage_risk double, impact_score double")
    b = al.evaluate_thresholds(scores, al.thresholds(spark))
    fresh = al.new_alerts(b.unionByName(b), b.limit(0))
    assert fresh.count() == 1 and al.new_alerts(b, fresh).count() == 0


def test_fifth_failure_locks(spark):
    def ev_(user, kinds):
        return [(user, user * 100 + i, dt.datetime(2024, 1, 1 + i), "login_failed" if k == "f" else "login_success") for i, k in enumerate(kinds)]
    df = spark.createDataFrame(ev_(1, "fffff") + ev_(2, "fffsff") + ev_(3, "sffffff"), "actor_id int, audit_id int, created_at timestamp, event_type string")
    assert {(r.actor_id, r.audit_id) for r in al.lockouts(df).collect()} == {(1, 104), (3, 305)}
    carried = spark.createDataFrame([(2, 2)], "actor_id int, carried int")
    assert {(r.actor_id, r.audit_id) for r in al.locked(al.failure_runs(df, carried), 5).collect()} == {(1, 104), (2, 202), (3, 305)}


def test_illegal_moves(spark):
    h = [(1, 1, "pending"), (2, 1, "approved"), (3, 1, "executed"), (4, 2, "approved"), (5, 3, "pending"), (6, 3, "executed")]
    df = spark.createDataFrame([(c, r, s, dt.datetime(2024, 1, 1, c)) for c, r, s in h], "change_id int, request_id int, status string, changed_at timestamp")
    assert {r.change_id for r in al.illegal_moves(df, "request_id", al.REQUEST_MOVES, "pending").collect()} == {4, 6}


# -- decisions ---------------------------------------------------------------------------------------

def test_allocation_is_optimal_and_within_stock(spark):
    rnd = random.Random(3)
    lines, caps = [], []
    for cell in range(12):
        caps.append((cell, 0, rnd.randrange(0, 40)))
        for o in range(8):
            lines.append((cell * 100 + o, cell, 0, rnd.randrange(1, 12), None if rnd.random() < 0.3 else round(rnd.uniform(1, 5), 3),
                          D(2024, 1, 1) + dt.timedelta(days=rnd.randrange(60))))
    ldf = spark.createDataFrame(lines, "order_id int, product_id int, warehouse_id int, quantity int, customer_value double, placed_at date")
    cdf = spark.createDataFrame(caps, "product_id int, warehouse_id int, capacity int")
    got = {r.order_id: r.granted for r in dc.allocate(dc.fifo_fallback(ldf), cdf, ["product_id", "warehouse_id"]).collect()}
    for cell, _, cap in caps:
        mine = [x for x in lines if x[1] == cell]
        order = sorted(mine, key=lambda x: (x[4] is None, -(x[4] or 0), x[5] if x[4] is None else D.min, x[0]))
        left = cap
        for o in order:
            take = min(o[3], left)
            left -= take
            assert got[o[0]] == take
        # best value over the valued orders, by dynamic programming over whole units
        valued = [x for x in mine if x[4] is not None]
        best = [0.0] * (cap + 1)
        for o in valued:
            for c in range(cap, 0, -1):
                best[c] = max(best[c - n] + n * o[4] for n in range(0, min(o[3], c) + 1))
        assert abs(best[cap] - sum(got[o[0]] * o[4] for o in valued)) < 1e-6


def test_infeasible_split_has_a_reason_and_no_rows(spark):
    need = spark.createDataFrame([("p", 100), ("r", 5)], "product_id string, required_qty int")
    offers = spark.createDataFrame([("p", 1, 5, 30), ("r", 1, 5, 3), ("r", 2, 4, 4)], "product_id string, supplier_id int, lead_time_days int, capacity int")
    f = {r.product_id: (r.optimal, r.reason) for r in dc.feasibility(need, offers).collect()}
    assert f["p"] == (False, "capacity below required quantity") and f["r"] == (True, None)
    assert {(r.supplier_id, r.qty) for r in dc.po_split(need, offers).collect()} == {(2, 4), (1, 1)}


def test_scenario_changes_scores_but_not_the_source(spark):
    df = spark.createDataFrame([(1, "a", 0.4, 0.4, 0.4, 0.4, 0.4), (2, "b", 0.4, 0.4, 0.4, 0.4, 0.4)], SIG)
    over = spark.createDataFrame([(1, {"delay_risk": 0.8}), (2, {"delay_risk": -0.1})], "supplier_id int, overrides map<string,double>")
    before = dc.snapshot_checksum(df).first()
    got = {r.supplier_id: r.change for r in dc.rescore(df, dc.apply_overrides(df, over)).collect()}
    assert got == {1: 0.1, 2: 0.0} and dc.snapshot_checksum(df).first() == before
    assert [r.supplier_id for r in dc.rejected_overrides(over).collect()] == [2]


# -- evidence and evaluation ----------------------------------------------------------------------------

def brute_chunks(text, size, overlap):
    step, pieces = size - overlap, []
    for p in text.split("\n"):
        n = len(p.split())
        while n > 0:
            pieces.append(min(n, step))
            n -= step
    toks, starts, fill, pos = text.split(), [0], 0, 0
    for n in pieces:
        if fill + n > step:
            starts.append(pos)
            fill = 0
        fill, pos = fill + n, pos + n
    ends = starts[1:] + [len(toks)]
    return [(i, " ".join(toks[max(0, b - overlap):e])) for i, (b, e) in enumerate(zip(starts, ends))] if toks else []


def test_chunks_equal_brute_force(spark):
    rnd = random.Random(4)
    docs = [(i, "\n".join(" ".join(f"w{rnd.randrange(50)}" for _ in range(rnd.choice([0, 1, 5, 30, 90]))) for _ in range(rnd.randrange(0, 9))))
            for i in range(40)] + [(99, "  ")]
    got = {}
    for r in ev.chunk(spark.createDataFrame(docs, "id int, text string"), "id", "text", 40, 5).collect():
        assert r.n_tokens <= 40
        got.setdefault(r.id, []).append((r.chunk_index, r.chunk_text))
    for i, text in docs:
        assert sorted(got.get(i, [])) == brute_chunks(text, 40, 5)


def test_keyword_search_equals_brute_force(spark):
    rnd = random.Random(6)
    text = lambda n: " ".join(f"w{int(rnd.expovariate(0.2))}" for _ in range(n))
    chunks = [(i, text(rnd.randrange(1, 40))) for i in range(80)]
    queries = [(i, text(5)) for i in range(7)]
    got = ev.keyword_search(spark.createDataFrame(queries, "query_id bigint, text string"),
                            spark.createDataFrame(chunks, "chunk_id bigint, chunk_text string"), 6).collect()
    words = {i: t.split() for i, t in chunks}
    mean = sum(map(len, words.values())) / len(words)
    want = set()
    for i, t in queries:
        best = []
        for j, w in words.items():
            score = 0.0
            for term in set(t.split()) & set(w):
                df, tf = sum(term in x for x in words.values()), w.count(term)
                score += math.log(1 + (len(words) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
            if score:
                best.append((-round(score, 6), j))
        want |= {(i, j, -s, r) for r, (s, j) in enumerate(sorted(best)[:6], 1)}
    assert {(r.query_id, r.chunk_id, r.bm25, r.keyword_rank) for r in got} == want


def test_rrf_uses_both_lists_and_filters_apply(spark):
    v = spark.createDataFrame([(1, 10, 0.9, 1), (1, 11, 0.8, 2)], "query_id int, chunk_id int, similarity double, vector_rank int")
    k = spark.createDataFrame([(1, 11, 3.0, 1), (1, 12, 2.0, 2)], "query_id int, chunk_id int, bm25 double, keyword_rank int")
    got = {r.chunk_id: r.rrf for r in ev.rrf(v, k).collect()}
    assert got[11] == max(got.values()) and len(got) == 3
    c = spark.createDataFrame([(1, "incidents", 5, D(2024, 1, 1)), (2, "contracts", 6, D(2024, 1, 1))],
                              "chunk_id int, collection string, supplier_id int, published_at date")
    assert [r.chunk_id for r in ev.filter_metadata(c, supplier_id=5).collect()] == [1]
    assert ev.filter_metadata(c, supplier_id=9).count() == 0


def test_intents(spark):
    df = spark.createDataFrame([("Why is it flagged?",), ("what is the risk score",), ("please approve it",), ("hello",)], "t string")
    assert [r.intent for r in ev.classify_intent(df, "t").collect()] == ["explanation", "score_lookup", "action_request", "general"]


def test_same_type_candidates_only(spark):
    v = spark.createDataFrame([(1, 0, [1.0, 0.0], True), (2, 0, [0.9, 0.1], True), (3, 0, [0.0, 1.0], True), (4, 1, [1.0, 0.0], True), (5, 0, [1.0, 0.0], False)],
                              "supplier_id bigint, component_type int, vec array<double>, is_active boolean")
    flagged = v.filter("supplier_id = 1")
    got = sm.top_k_similar(flagged, sm.candidates(flagged, v), 5).orderBy("rank").collect()
    assert [r.candidate_id for r in got] == [2, 3]


def test_auc_matches_the_evaluator(spark):
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    rnd = random.Random(8)
    data = [(round(rnd.random(), 2), float(rnd.random() < 0.4)) for _ in range(500)]
    df = spark.createDataFrame(data, "p double, label double")
    want = BinaryClassificationEvaluator(rawPredictionCol="p", labelCol="label", numBins=0).evaluate(df)
    assert abs(ln.roc_auc(df, "p", "label").first()["auc"] - want) < 1e-6
    bins = ln.calibration_bins(df, "p", "label", 10)
    assert bins.agg(F.sum("n")).first()[0] == 500


# -- files --------------------------------------------------------------------------------------------

def test_fixture_files_keep_bad_lines(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType
    from haulwise.sources.tables import read_fixture
    schema = StructType([StructField("id", IntegerType()), StructField("name", StringType())])
    (tmp_path / "a.csv").write_text("id,name\n1,x\nbad,y\n")
    (tmp_path / "b.json").write_text('{"id": 1, "name": "x"}\n{broken\n')
    for fmt, name in (("csv", "a.csv"), ("json", "b.json")):
        got = read_fixture(spark, str(tmp_path / name), schema, fmt).collect()
        assert len(got) == 2 and sum(r["_corrupt"] is not None for r in got) == 1


def test_snapshot_written_twice_is_one_snapshot(spark, tmp_path):
    from haulwise.sources.sinks import read_graph_snapshot, write_graph_snapshot
    nodes = spark.createDataFrame([("a", "1")], "node_type string, node_id string")
    edges = spark.createDataFrame([("E", "1", "1")], "edge_type string, src string, dst string")
    for snap in ("s1", "s2", "s1"):
        write_graph_snapshot(nodes, edges, str(tmp_path), snap)
    n, e = read_graph_snapshot(spark, str(tmp_path), "s1")
    assert n.count() == 1 and e.count() == 1


def test_page_rejects_bad_numbers(spark):
    from haulwise.sources.tables import page
    df = spark.range(45)
    assert [r.id for r in page(df, [F.col("id")], 3, 20).collect()] == [40, 41, 42, 43, 44]
    with pytest.raises(ValueError):
        page(df, [F.col("id")], 0)


# -- indexes, scenarios, nested limits ------------------------------------------------------------

def _units(rnd, n, groups):
    import numpy as np
    rng = np.random.default_rng(rnd)
    middle = rng.standard_normal((groups, 16))
    v = middle[rng.integers(0, groups, n)] + rng.standard_normal((n, 16)) * 0.15
    v[: n // 3] = v[0]  # a hot vector
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def test_cells_are_exact_when_certified_and_few_when_vectors_gather(spark):
    import numpy as np
    from haulwise.plans import cells
    v = _units(4, 900, 40)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(900)], "item_id bigint, vec array<double>")
    asked = rows.select(F.col("item_id").alias("query_id"), "vec")
    index = cells.build(rows, cells=60)
    sim = np.round(v @ v.T, 6)
    np.fill_diagonal(sim, -9)
    want = {i: sorted(range(900), key=lambda j: (-sim[i, j], j))[:5] for i in range(900)}
    got = defaultdict(list)
    for r in sorted(cells.search(index, asked, 5, exclude_self=True).collect(), key=lambda r: r["rank"]):
        got[r.query_id].append((r.item_id, r.similarity))
    assert all([s for _, s in got[i]] == [sim[i, j] for j in want[i]] for i in want)
    spread = rows.filter("item_id >= 300")
    index, asked = cells.build(spread, cells=60), asked.filter("query_id >= 300")
    probes = cells.probes_for(index, 5, 0.9)
    row = cells.cost(index, asked, probes).first()
    near = {(r.query_id, r.item_id) for r in cells.search(index, asked, 5, exclude_self=True, probes=probes).collect()}
    true = {(r.query_id, r.item_id) for r in cells.search(index, asked, 5, exclude_self=True).collect()}
    assert row.share < 0.2 and len(near & true) >= 0.9 * len(true)


def test_cells_of_odd_tables(spark):
    from haulwise.plans import cells
    rows = spark.createDataFrame([(1, [1.0, 0.0])], "item_id bigint, vec array<double>")
    asked = rows.select(F.col("item_id").alias("query_id"), "vec")
    assert [tuple(r) for r in cells.search(cells.build(rows), asked, 3).collect()] == [(1, 1, 1.0, 1)]
    none = cells.build(rows.limit(0))
    assert cells.search(none, asked, 3).count() == 0 and cells.search(cells.build(rows), asked.limit(0), 3).count() == 0


def test_keyword_index_skips_and_stays_exact(spark, monkeypatch):
    """A word in every chunk is spread over shards; the answer equals the sum over all matches."""
    from haulwise.plans import postings
    monkeypatch.setattr(postings, "SHARD", 50)
    rnd = random.Random(8)
    word = lambda: f"r{rnd.randrange(400)}" if rnd.random() < 0.4 else f"c{int(rnd.expovariate(1))}"
    chunks = spark.createDataFrame([(i, "hot " + " ".join(word() for _ in range(rnd.randrange(5, 60)))) for i in range(600)], "chunk_id bigint, chunk_text string")
    asked = spark.createDataFrame([(i, "hot " + " ".join(word() for _ in range(12))) for i in range(12)] + [(99, "unknown"), (100, "")], "query_id bigint, text string")
    index = ev.keyword_index(chunks)
    assert index.blocks.filter("term = 'hot'").agg(F.max("n")).first()[0] < 100
    full = postings._opened(index, postings._asks(index, asked)).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25"))
    want = defaultdict(list)
    for r in full.collect():
        want[r.query_id].append((-r.bm25, r.chunk_id))
    got = defaultdict(list)
    for r in sorted(ev.keyword_search(asked, chunks, 5, index).collect(), key=lambda r: r.keyword_rank):
        got[r.query_id].append((-r.bm25, r.chunk_id))
    assert got == {q: sorted(rows)[:5] for q, rows in want.items()}
    row = postings.cost(index, asked, 5).first()
    assert row.pairs_scored < 0.5 * row.pairs_that_share
    assert ev.keyword_search(asked, chunks.limit(0), 5).count() == 0


def test_scenario_spreads_like_two_whole_runs(spark):
    from haulwise.operators import scenario as sc, traversal as tv
    rnd = random.Random(2)
    edges = {(rnd.randrange(12), 12 + rnd.randrange(12)) for _ in range(40)} | {(12 + rnd.randrange(12), 24 + rnd.randrange(6)) for _ in range(30)} | {(25, 13)}
    kind = lambda i: "supplier" if i < 12 else "product" if i < 24 else "order"
    base = spark.createDataFrame([(kind(i), str(i), rnd.random()) for i in range(30)], "node_type string, node_id string, risk double")
    flow = spark.createDataFrame([(kind(a), str(a), kind(b), str(b)) for a, b in edges], "src_type string, src string, dst_type string, dst string")
    own = {r.node_id: r.risk for r in base.collect()}
    delta = {"0": 0.4, "5": -0.2, "14": 0.1, "25": 0.3}
    changed = spark.createDataFrame([(kind(int(i)), i, d) for i, d in delta.items()], "node_type string, node_id string, delta double")
    after = base.join(changed, ["node_type", "node_id"], "left").select("node_type", "node_id", (F.col("risk") + F.coalesce("delta", F.lit(0.0))).alias("risk"))
    for hops in (1, 3, 4):
        runs = [{r.node_id: r.score for r in tv.propagate_risk(b, flow, hops, 0.7, digits=None).collect()} for b in (base, after)]
        got = {r.node_id: r.delta for r in sc.spread_change(changed, flow, hops, 0.7).collect()}
        assert all(abs(runs[1][i] - runs[0][i] - got.get(i, 0.0)) < 1e-9 for i in own)


def test_scenario_overrides_are_checked_first(spark):
    from haulwise.operators import scenario as sc
    nodes = spark.createDataFrame([("supplier", str(i), 0.2, 0.8, 10.0) for i in range(5)],
                                  "node_type string, node_id string, risk double, reliability double, lead_time_days double")
    over = spark.createDataFrame([("supplier", "0", "reliability", 0.5), ("supplier", "1", "lead_time_days", -1.0), ("supplier", "1", "reliability", 0.1),
                                  ("supplier", "2", "lead_time_days", 55.0), ("supplier", "3", "own_risk", float("nan")), ("supplier", "9", "own_risk", 0.5),
                                  ("supplier", "4", "own_risk", None)], "node_type string, node_id string, feature string, value double")
    usable, bad = sc.check_features(over, nodes)
    assert {(r.node_id, r.reason) for r in bad.collect()} == {("1", "out of range"), ("3", "out of range"), ("9", "unknown node"), ("4", "out of range")}
    assert {(r.node_id, r.simulated) for r in sc.changed_risk(nodes, usable).collect()} == {("0", 0.5), ("2", 0.7)}


def test_nested_allocation_is_optimal(spark):
    """Against all integer grants, with stock per cell and a limit per product."""
    import itertools
    rnd = random.Random(11)
    lines, limits = [], []
    for p in range(8):
        whole = rnd.randrange(0, 9)
        for w in range(2):
            limits.append((p, w, rnd.randrange(0, 6), rnd.randrange(0, 7), float(whole), 100, 10))
            for o in range(3):
                lines.append((p * 100 + w * 10 + o, p, w, rnd.randrange(1, 5), round(rnd.uniform(1, 5), 3), D(2024, 1, 1), rnd.choice([7, 20, 30])))
    ldf = spark.createDataFrame(lines, "order_id int, product_id int, warehouse_id int, quantity int, customer_value double, placed_at date, sla_days int")
    cdf = spark.createDataFrame(limits, "product_id int, warehouse_id int, inventory int, warehouse_capacity int, supplier_capacity double, production_capacity int, lead_time_days int")
    allocated = dc.allocate_nested(dc.fifo_fallback(ldf), cdf)
    got = {r.order_id: (r.granted, r.reason) for r in allocated.collect()}
    totals = {r.product_id: r.objective_value for r in dc.allocation_result(allocated).collect()}
    for p in range(8):
        mine = [x for x in lines if x[1] == p]
        caps = {w: min(a, b) for q, w, a, b, *_ in limits if q == p}
        whole = next(int(x[4]) for x in limits if x[0] == p)
        best = 0.0
        for take in itertools.product(*[range(x[3] + 1 if x[6] >= 10 else 1) for x in mine]):
            if sum(take) <= whole and all(sum(t for t, x in zip(take, mine) if x[2] == w) <= caps[w] for w in caps):
                best = max(best, sum(t * x[4] for t, x in zip(take, mine)))
        assert abs(best - sum(got[x[0]][0] * x[4] for x in mine)) < 1e-6 and abs(best - totals[p]) < 1e-5
    assert all(got[x[0]] == (0, "lead time exceeds the agreed days") for x in lines if x[6] < 10)
    unknown = dc.allocate_nested(dc.fifo_fallback(ldf), cdf.filter("warehouse_id = 0"))
    row = dc.allocation_result(unknown).first()
    assert not row.optimal and row.granted is None and row.objective_value is None and row.reason == "no inventory"


def test_snapshot_changes(spark):
    from haulwise.sources import tables
    schema = "k bigint, a string, b string"
    old = spark.createDataFrame([(1, "x", None), (2, "x", "y"), (3, None, "z"), (4, "q", "q")], schema)
    new = spark.createDataFrame([(1, "x", None), (2, "x", "Y"), (3, "z", None), (5, "n", "n")], schema).select("b", "k", "a")
    got = {(r.row_id, r.operation) for r in tables.snapshot_changes({"t": (old, new, "k")}).collect()}
    assert got == {("2", "update"), ("3", "update"), ("4", "delete"), ("5", "insert")}
    assert tables.snapshot_changes({"t": (old.limit(0), new.limit(0), "k")}).count() == 0


def test_documents_without_a_text_are_pending(spark):
    docs = spark.createDataFrame([(1, None), (2, "Supplier#1 total 5 date 2024-01-02"), (3, "nothing")], "id int, text string")
    assert {r.id: r.parse_status for r in ev.parse_status(ev.extract_fields(docs, "text")).collect()} == {1: "pending", 2: "parsed", 3: "failed"}


def test_cells_meet_in_tiles_of_bounded_size(spark, monkeypatch):
    """Tiles of few rows, cells of several tiles: the exact search stays exact and the approximate one within its cells."""
    import numpy as np
    from haulwise.plans import cells
    monkeypatch.setattr(cells, "TILE_ROWS", 64)
    monkeypatch.setattr(cells, "SLICE", 16)
    v = _units(4, 900, 40)
    rows = spark.createDataFrame([(i, [float(x) for x in v[i]]) for i in range(900)], "item_id bigint, vec array<double>")
    asked = rows.select(F.col("item_id").alias("query_id"), "vec").filter("query_id % 3 = 0")
    index = cells.build(rows, cells=60)
    sim = np.round(v @ v.T, 6)
    np.fill_diagonal(sim, -9)
    got, near = defaultdict(list), defaultdict(list)
    for out, probes in ((got, None), (near, 7)):
        for r in sorted(cells.search(index, asked, 5, exclude_self=True, probes=probes).collect(), key=lambda r: r["rank"]):
            out[r.query_id].append((r.item_id, r.similarity))
    cell = {r.item_id: r.cell for r in index.rows.collect()}
    some = np.flatnonzero(index.size)
    angle = np.arccos(np.clip(v @ index.centres[some].T, -1, 1))
    for i in range(0, 900, 3):
        assert [s for _, s in got[i]] == sorted(sim[i], reverse=True)[:5]
        inside = set(some[np.argsort(angle[i], kind="stable")[:7]])
        want = sorted((j for j in range(900) if cell[j] in inside and j != i), key=lambda j: (-sim[i, j], j))[:5]
        assert [s for _, s in near[i]] == [sim[i, j] for j in want]
    assert cells.cost(index, asked, 7).first().pairs == 300 * 900


def test_keyword_scores_stay_in_their_shards(spark, monkeypatch):
    """Repeated query numbers count as often as they occur, and a task returns no more than n rows of a query."""
    from haulwise.plans import postings
    monkeypatch.setattr(postings, "SHARD", 20)
    monkeypatch.setattr(postings, "ASKING", 2)
    rnd = random.Random(3)
    text = lambda n: "hot " + " ".join(f"c{int(rnd.expovariate(0.3))}" for _ in range(n))
    chunks = spark.createDataFrame([(i, text(rnd.randrange(4, 20))) for i in range(200)], "chunk_id bigint, chunk_text string")
    asked = spark.createDataFrame([(i % 5, text(6)) for i in range(7)], "query_id bigint, text string")
    index = ev.keyword_index(chunks)
    full = postings._opened(index, postings._asks(index, asked)).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25")).collect()
    want, got = defaultdict(list), defaultdict(list)
    for r in full:
        want[r.query_id].append((-r.bm25, r.chunk_id))
    for r in sorted(ev.keyword_search(asked, chunks, 4, index).collect(), key=lambda r: r.keyword_rank):
        got[r.query_id].append((-r.bm25, r.chunk_id))
    assert got == {q: sorted(rows)[:4] for q, rows in want.items()}
    row = postings.cost(index, asked, 4).first()
    assert row.pairs_that_share == len(full) and row.pairs_scored <= row.pairs_that_share
    kept = postings._in_shards(index, postings.limits(index, asked, 4), lambda s: s.first(s.scores(), 4), postings.FOUND)
    assert kept.groupBy("query_id", F.pmod(F.xxhash64("chunk_id"), F.lit(10)).alias("shard")).count().agg(F.max("count")).first()[0] <= 4


def test_chunks_move_to_their_shard_once(spark, monkeypatch):
    """F1 to F8: words, frequencies and blocks were shuffled one after the other, and asked blocks once for every few queries."""
    from haulwise.plans import postings
    monkeypatch.setattr(postings, "SHARD", 20)
    monkeypatch.setattr(postings, "ASKING", 2)
    rnd = random.Random(5)
    text = lambda n: "hot " + " ".join(f"c{int(rnd.expovariate(0.2))}" for _ in range(n))
    rows = [(i if i else None, text(rnd.randrange(4, 20))) for i in range(200)] + [(300, None)]
    chunks = spark.createDataFrame(rows + rows[20:40], "chunk_id bigint, chunk_text string")
    index = ev.keyword_index(chunks)
    plan = index.blocks._jdf.queryExecution().sparkPlan().toString()
    assert index.shards == 12 and "ENSURE_REQUIREMENTS" not in index.blocks._jdf.queryExecution().executedPlan().toString() and plan.count("Exchange") == 1
    asked = spark.createDataFrame([(i % 5 if i else None, text(6)) for i in range(9)], "query_id bigint, text string")
    # a number of words may stand beside the text; queries may come in several turns
    counted = ev.keyword_index(chunks.withColumn("n_terms", F.size(F.expr("regexp_extract_all(lower(chunk_text), '([a-z0-9]+)', 1)"))))
    whole = sorted(map(tuple, ev.keyword_search(asked, chunks, 4, index).collect()))
    cost = postings.cost(index, asked, 4).first()
    monkeypatch.setattr(postings, "SENT", 2)
    assert sorted(map(tuple, ev.keyword_search(asked, chunks, 4, counted).collect())) == whole and postings.cost(counted, asked, 4).first() == cost
    full, want = postings._opened(index, postings._asks(index, asked)).groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 6).alias("bm25")).collect(), {}
    for r in full:
        want.setdefault(r.query_id, []).append((-r.bm25, r.chunk_id))
    found = {}
    for q, chunk, score, rank in sorted(whole, key=lambda r: (r[0], r[3])):
        found.setdefault(q, []).append((-score, chunk))
    assert found == {q: sorted(x for x in some if x[1] is not None)[:4] for q, some in want.items() if q is not None}


def test_shuffled_rows_go_when_a_query_ends(spark, tmp_path):
    """F1 to F10: they stayed until the driver's garbage was collected. A frame that is collected again is computed again."""
    import os
    df = spark.range(200_000).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).count()
    local = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    tops = [str(d) for d in local.localDirsString()]
    held = lambda: {n for top in tops for _, _, names in os.walk(top) for n in names if n.startswith("shuffle_")}
    before = held()
    first = sorted(map(tuple, df.collect()))
    assert not held() - before and sorted(map(tuple, df.collect())) == first and len(first) == 7
