"""Hops by node type."""

import random
from collections import Counter, defaultdict

from haulwise.operators import scenario as sc, traversal as tv

LAYERS = [("supplier", "component"), ("component", "product"), ("product", "order")]
CYCLE = [("a", "b"), ("b", "a"), ("b", "c"), ("d", "a"), ("c", "e")]


def graph(spark, pairs, seed):
    rnd = random.Random(seed)
    nodes = [(t, str(i)) for t in dict.fromkeys(x for p in pairs for x in p) for i in range(6)]
    edges = [(s, str(rnd.randrange(6)), d, str(rnd.randrange(5))) for s, d in pairs for _ in range(12)]
    base = [(*n, rnd.random()) for n in nodes] + [(*nodes[0], 0.3), (None, "1", 0.4), ("alone", "1", 0.5)]
    odd = [(pairs[0][0], "9", pairs[0][1], "1"), (None, "1", pairs[0][1], "2"), (pairs[0][0], "1", None, "2")]
    return (base, edges + odd, spark.createDataFrame(base, "node_type string, node_id string, risk double"),
            spark.createDataFrame(edges + odd, "src_type string, src string, dst_type string, dst string"))


def hop_by_hop(base, edges, hops, damping):
    now = [r[2] for r in base]
    for _ in range(hops):
        came, at = defaultdict(list), defaultdict(list)
        for (t, i, _), v in zip(base, now):
            at[t, i].append(v)
        for a, b, c, d in edges:
            if None not in (a, b, c, d):
                came[c, d] += at.get((a, b), [])
        now = [r[2] * (1 - damping) + sum(x) / len(x) * damping if (x := came[r[:2]]) else r[2] for r in base]
    return Counter((t, i, round(v, 9)) for (t, i, _), v in zip(base, now))


def test_hops_by_type_equal_hops_over_the_whole_graph(spark):
    for pairs, hops in ((LAYERS, 0), (LAYERS, 2), (LAYERS, 3), (LAYERS, 5), (CYCLE, 1), (CYCLE, 4)):
        base, edges, b, e = graph(spark, pairs, hops)
        got = tv.propagate_risk(b, e, hops, 0.7).collect()
        assert Counter((r.node_type, r.node_id, round(r.score, 9)) for r in got) == hop_by_hop(base, edges, hops, 0.7)


def test_layers_are_joined_once(spark, monkeypatch):
    """the plain loop joins every edge in every hop."""
    calls, plain = [], tv.over_types

    def counted(start, edges, hops, step, sources=None):
        return plain(start, edges, hops, lambda kind, e, src: (calls.append(kind), step(kind, e, src))[1], sources)
    monkeypatch.setattr(tv, "over_types", counted)
    monkeypatch.setattr(sc, "over_types", counted)
    _, _, b, e = graph(spark, LAYERS, 1)
    tv.propagate_risk(b, e, 3, 0.7).count()
    assert calls == ["component", "product", "order"]
    calls.clear()
    sc.spread_change(spark.createDataFrame([("component", "1", 0.2)], "node_type string, node_id string, delta double"), e, 3, 0.7).count()
    assert sorted(set(calls)) == ["component", "order", "product"] and len(calls) == 3


def test_change_below_unchanged_sources(spark):
    """A changed node whose in-neighbours keep their score passes on what damping leaves of its own change."""
    for pairs in (LAYERS, CYCLE):
        base, edges, b, e = graph(spark, pairs, 7)
        kind = pairs[1][0]
        after = [(t, i, v + 0.1 * (t == kind and i in "13")) for t, i, v in base]
        changed = spark.createDataFrame([(kind, "1", 0.1), (kind, "3", 0.1), (kind, "4", 0.0), (kind, "5", None)], "node_type string, node_id string, delta double")
        inside = e.join(b.selectExpr("node_type src_type", "node_id src").distinct(), ["src_type", "src"], "left_semi")
        inside = inside.filter(f"not (src_type = '{pairs[0][0]}' and src = '0')")
        kept = [tuple(r) for r in inside.select("src_type", "src", "dst_type", "dst").collect()]
        first, then = (hop_by_hop(x[:-3], kept, 3, 0.7) for x in (base, after))
        want = {(t, i): v for t, i, v in then}
        got = {(r.node_type, r.node_id): r.delta for r in sc.spread_change(changed, inside, 3, 0.7).collect()}
        assert got and all(abs(want[t, i] - v - got.get((t, i), 0.0)) < 1e-8 for t, i, v in first)
