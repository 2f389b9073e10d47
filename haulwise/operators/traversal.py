"""Reachability, neighbourhood aggregation and risk propagation over the edge table."""

from __future__ import annotations

from collections.abc import Callable, Collection, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..functions import columns as fx
from ..plans.windows import top_per_key
from ..session import cut, written

NODE = ["node_type", "node_id"]


def _step(frontier: DataFrame, edges: DataFrame) -> DataFrame:
    src = edges.select(F.col("src_type").alias("node_type"), F.col("src").alias("node_id"),
                       F.col("dst_type").alias("_t"), F.col("dst").alias("_i"))
    return frontier.join(src, NODE).select(F.col("_t").alias("node_type"), F.col("_i").alias("node_id")).distinct()


def blast_radius(edges: DataFrame, seeds: DataFrame, max_hops: int) -> DataFrame:
    """Nodes reachable from the seeds with their smallest hop count.

    Each hop is one join and an anti join against what was seen; the frontier is
    checkpointed, so a lost executor costs one hop and the plan stays small.
    """
    seen = cut(seeds.select(*NODE, F.lit(0).alias("hop")).distinct())
    frontier = seen
    for hop in range(1, max_hops + 1):
        fresh = _step(frontier.select(*NODE), edges).join(seen.select(*NODE), NODE, "left_anti")
        frontier = cut(fresh.withColumn("hop", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def supplier_dependents(supplier_components: DataFrame, product_components: DataFrame,
                        suppliers: DataFrame) -> DataFrame:
    """Components and products that depend on the given suppliers."""
    own = supplier_components.join(suppliers.select("supplier_id"), "supplier_id", "left_semi")
    return own.join(product_components, "component_id").select(
        "supplier_id", "component_id", "product_id").distinct()


def orders_affected_by(supplier_components: DataFrame, product_components: DataFrame, items: DataFrame,
                       suppliers: DataFrame) -> DataFrame:
    """Distinct orders that contain a product fed by one of the given suppliers.

    The supplier side is reduced to distinct products before it meets the orders.
    """
    products = supplier_dependents(supplier_components, product_components, suppliers).select("product_id").distinct()
    return items.join(products, "product_id", "left_semi").select("order_id").distinct()


def induced_subgraph(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges among the given nodes; a node without any keeps one row with NULL ends."""
    ids = nodes.select(*NODE).distinct()
    as_src = ids.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src"))
    as_dst = ids.select(F.col("node_type").alias("dst_type"), F.col("node_id").alias("dst"))
    inside = edges.select("edge_type", "src_type", "src", "dst_type", "dst").join(
        as_src, ["src_type", "src"], "left_semi").join(as_dst, ["dst_type", "dst"], "left_semi")
    inside = inside.select("edge_type", "src_type", "src", "dst_type", "dst")
    touched = inside.select(F.col("src_type").alias("node_type"), F.col("src").alias("node_id")).unionByName(
        inside.select(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id"))).distinct()
    alone = ids.join(touched, NODE, "left_anti").select(
        F.lit(None).cast("string").alias("edge_type"), F.col("node_type").alias("src_type"),
        F.col("node_id").alias("src"), F.lit(None).cast("string").alias("dst_type"), F.lit(None).cast("string").alias("dst"))
    return inside.unionByName(alone)


def sample_neighbors(edges: DataFrame, k: int, seed: int) -> DataFrame:
    """At most ``k`` neighbours per node and edge type, chosen by a seeded hash."""
    draw = F.md5(F.concat_ws("|", F.lit(str(seed)), "src", "dst"))
    return top_per_key(edges.select("edge_type", "src", "dst").withColumn("_draw", draw),
                       ["edge_type", "src"], [F.col("_draw"), F.col("dst")], k).drop("_draw")


def mean_aggregate(values: DataFrame, edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean of the in-neighbours' columns per node: every neighbour counts the same.

    ``values`` holds (node_id, cols...), ``edges`` holds (src, dst).
    """
    joined = edges.select("src", "dst").join(values.withColumnRenamed("node_id", "src"), "src")
    return joined.groupBy(F.col("dst").alias("node_id")).agg(
        F.count("*").alias("n_neighbors"), *[fx.r6(F.avg(c)).alias(f"mean_{c}") for c in cols])


def attention_aggregate(src_values: DataFrame, dst_values: DataFrame, edges: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Softmax-weighted neighbour mean; the weight is the fixed similarity
    ``-|own - neighbour|`` summed over the columns (not learned).

    sum(e^s x) / sum(e^s) is two partial sums, so no window holds a hub.
    """
    src = src_values.select(F.col("node_id").alias("src"), *[F.col(c).alias(f"s_{c}") for c in cols])
    dst = dst_values.select(F.col("node_id").alias("dst"), *[F.col(c).alias(f"d_{c}") for c in cols])
    sim = F.lit(0.0)
    for c in cols:
        sim = sim - F.abs(F.col(f"s_{c}") - F.col(f"d_{c}"))
    e = edges.select("src", "dst").join(src, "src").join(dst, "dst").withColumn("_w", F.exp(sim))
    return e.groupBy(F.col("dst").alias("node_id")).agg(*[
        fx.r6(F.sum(F.col("_w") * F.col(f"s_{c}")) / F.sum("_w")).alias(f"att_{c}") for c in cols])


def typed_aggregate(values: DataFrame, edges: DataFrame, col: str, types: Sequence[str]) -> DataFrame:
    """One neighbour mean per edge type, kept in separate columns.

    ``values`` holds (node_type, node_id, col); the type list is fixed. Edges meet the written values of one
    node type at a time: where these are few, the edges are neither shuffled nor sorted by source.
    """
    src = written(values.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src"), F.col(col).alias("_x")), "values")
    kinds = sorted(r.src_type for r in src.select("src_type").distinct().dropna().collect())
    wanted = edges.filter(F.col("edge_type").isin(*types))
    of_kind = [wanted.filter(F.col("src_type") == k).join(
        written(src.filter(F.col("src_type") == k), "values"), ["src_type", "src"]) for k in kinds]
    joined = reduce(DataFrame.unionByName, of_kind or [wanted.join(src, ["src_type", "src"])])
    return joined.groupBy(F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id")).agg(*[
        fx.r6(F.avg(F.when(F.col("edge_type") == t, F.col("_x")))).alias(f"mean_{t.lower()}") for t in types])


def over_types(start: DataFrame, edges: DataFrame, hops: int, step: Callable[[str, DataFrame, DataFrame], DataFrame],
               sources: Collection[str] | None = None) -> DataFrame:
    """(node_type, node_id, value) after ``hops`` hops, each of which gives a node a value from its in-neighbours'.

    ``start`` holds the values before the first hop. A type without in-edges keeps them, and a type stands still one
    hop after all types that lead to it; so a hop is computed only for the types whose values of that hop are read
    later or are the result, and without cycles of types every edge is joined once. ``step`` gets such a type, the
    edges into it and the values of its sources, and returns its new values; values read later are written, so
    that the size of a small side is known. With ``sources``, only these types have values at the start; other types
    are reached from them or left out.
    """
    # one row per pair of node types
    into: dict[str, set[str]] = {}
    for r in edges.select("src_type", "dst_type").distinct().dropna().collect():
        into.setdefault(r.dst_type, set()).add(r.src_type)
    if sources is not None:
        reached = set(sources)
        while more := {t for t, of in into.items() if of & reached} - reached:
            reached |= more
        into = {t: of & reached for t, of in into.items() if t in reached}
    last = {t: 0 for of in into.values() for t in of if t not in into}
    while more := {t: 1 + max((last[s] for s in of), default=0) for t, of in into.items() if t not in last and of <= last.keys()}:
        last |= more
    last = {t: min(last.get(t, hops), hops) for t in {*last, *into}}
    read: set[tuple[str, int]] = set()
    todo = {(t, n) for t, n in last.items() if n}
    while todo:
        new = {(s, min(n - 1, last[s])) for t, n in todo for s in into[t]} - read
        read, todo = read | new, {x for x in new if x[1]}

    moved = [t for t, n in last.items() if n]
    out = start.filter(~F.coalesce(F.col("node_type").isin(*moved), F.lit(False))) if moved else start
    values = {(t, 0): written(start.filter(F.col("node_type") == t), "values") for t, n in sorted(read) if n == 0}
    for hop in range(1, hops + 1):
        for t in sorted(t for t in into if (t, hop) in read or last[t] == hop):
            src = reduce(DataFrame.unionByName, [values[s, min(hop - 1, last[s])] for s in sorted(into[t])] or [start.limit(0)])
            now = step(t, edges.filter(F.col("dst_type") == t), src)
            if (t, hop) in read:
                now = values[t, hop] = written(now, "values")
            out = out.unionByName(now) if last[t] == hop else out
    return out


def propagate_risk(base: DataFrame, edges: DataFrame, hops: int, damping: float, digits: int | None = 9) -> DataFrame:
    """Risk spreading along edges for a fixed number of hops.

    score' = (1 - damping) * own base + damping * mean of the in-neighbours;
    nodes without in-neighbours keep their base. ``base`` holds (node_type,
    node_id, risk) for every node. Hops go type by type (``over_types``). Scores are
    rounded to ``digits``, if given.
    """
    def step(kind: str, e: DataFrame, src: DataFrame) -> DataFrame:
        src = src.select(F.col("node_type").alias("src_type"), F.col("node_id").alias("src"), "score")
        mean = e.join(src, ["src_type", "src"]).groupBy(
            F.col("dst_type").alias("node_type"), F.col("dst").alias("node_id")).agg(F.avg("score").alias("_m"))
        return base.filter(F.col("node_type") == kind).join(mean, NODE, "left").select(
            *NODE, F.when(F.col("_m").isNull(), F.col("risk")).otherwise(
                F.col("risk") * F.lit(1 - damping) + F.col("_m") * F.lit(damping)).alias("score"))
    out = over_types(base.select(*NODE, F.col("risk").alias("score")),
                     edges.select("src_type", "src", "dst_type", "dst"), hops, step)
    return out if digits is None else out.withColumn("score", F.round("score", digits))
