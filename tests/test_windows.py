"""Segmented windows and tiles equal the plain forms, with one key holding a third of the rows."""

import random

import numpy as np
import pytest
from pyspark.sql import Window as W, functions as F

from haulwise.plans.tiles import top_k_dot
from haulwise.plans.windows import (
    drop_context, lagged, latest_per_key, nested_in_parts, running_last, running_sum, with_lookback)


@pytest.fixture(scope="module")
def events(spark):
    rnd = random.Random(5)
    rows = [(0 if i % 3 == 0 else rnd.randrange(1, 40), rnd.randrange(0, 400), i, rnd.randrange(0, 100), rnd.random() < 0.3)
            for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, t int, id int, v int, flag boolean")
    return df.withColumn("seg", F.floor(F.col("t") / 20)).cache()


def plain():
    return W.partitionBy("k").orderBy("t", "id")


def same(a, b):
    a, b = sorted(map(tuple, a.collect()), key=repr), sorted(map(tuple, b.collect()), key=repr)
    assert a == b and a


def test_lagged(events):
    got = lagged(events, ["k"], "seg", ["t", "id"], {"p": "v"})
    same(got.select("id", "p"), events.withColumn("p", F.lag("v").over(plain())).select("id", "p"))


@pytest.mark.parametrize("n", [1, 4, 9])
def test_lookback_frames(events, n):
    w = W.partitionBy("k", "seg").orderBy("t", "id").rowsBetween(-n, 0)
    got = drop_context(with_lookback(events, ["k"], "seg", ["t", "id"], n).withColumn("s", F.sum("v").over(w)))
    same(got.select("id", "s"), events.withColumn("s", F.sum("v").over(plain().rowsBetween(-n, 0))).select("id", "s"))


def test_running_sum(events):
    got = running_sum(events, ["k"], "seg", ["t", "id"], {"s": F.col("v"), "c": F.lit(1)})
    w = plain().rowsBetween(W.unboundedPreceding, 0)
    same(got.select("id", "s", "c"), events.select("id", F.sum("v").over(w), F.count("*").over(w)))


@pytest.mark.parametrize("inclusive", [True, False])
def test_running_last(events, inclusive):
    value = F.when(F.col("flag"), F.col("v"))
    got = running_last(events, ["k"], "seg", ["t", "id"], {"x": value}, inclusive)
    w = plain().rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    same(got.select("id", "x"), events.select("id", F.last(value, ignorenulls=True).over(w)))


def test_latest_limits_before_the_shuffle(events):
    df = latest_per_key(events, ["k"], [F.col("t").desc(), F.col("id").desc()])
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert df.count() == events.select("k").distinct().count()


def test_nested_in_parts_keeps_everything(events):
    got = nested_in_parts(events, ["k"], F.col("id"), F.col("id"), "ids", per_part=50)
    assert got.agg(F.sum(F.size("ids"))).first()[0] == 3000
    assert got.agg(F.max(F.size("ids"))).first()[0] < 120
    assert got.filter("k = 0").count() > 10


@pytest.mark.parametrize("tile_rows", [7, 1000])
def test_top_k_dot_equals_brute_force(spark, tile_rows):
    rng = np.random.default_rng(2)
    vec = np.round(rng.normal(size=(60, 5)), 1)
    block = [0 if i % 3 else i % 4 for i in range(60)]
    rows = [(i, block[i], [float(x) for x in vec[i]]) for i in range(60)]
    q = spark.createDataFrame(rows, "query_id bigint, block int, vec array<double>")
    c = spark.createDataFrame(rows, "item_id bigint, block int, vec array<double>")
    got = {}
    for r in top_k_dot(q, c, 3, exclude_self=True, tile_rows=tile_rows).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.item_id))
    for i in range(60):
        want = sorted((-round(float(vec[i] @ vec[j]), 6), j) for j in range(60) if block[j] == block[i] and j != i)[:3]
        assert [x for _, x in sorted(got.get(i, []))] == [j for _, j in want]


def test_items_come_in_pieces_and_queries_stay(spark, monkeypatch):
    """both sides were copied for every tile of the other, so shuffled rows grew with the square of the input."""
    import numpy as np
    from haulwise.plans import cells, tiles
    rng = np.random.default_rng(4)
    v = rng.normal(size=(300, 6))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    data = [(i, [0, 0, 1, None][i % 4], [float(x) for x in v[i]]) for i in range(300)]
    rows = spark.createDataFrame(data, "item_id bigint, block int, vec array<double>")
    asked = rows.withColumnRenamed("item_id", "query_id")
    sim = np.round(v @ v.T, 6)
    want = {i: sorted((-sim[i, j], j) for j, b, _ in data if b == block and j != i)[:3] for i, block, _ in data if block is not None}
    index = cells.build(rows.select("item_id", "vec"), cells=12)
    near = {i: sorted((-sim[i, j], j) for j in range(300) if j != i)[:3] for i in range(300)}
    for size in (1000, 70):
        monkeypatch.setattr(tiles, "PIECE_ROWS", size)
        copied, kept = [], tiles.in_pieces
        monkeypatch.setattr(tiles, "in_pieces", lambda q, n, held, compared: copied.append(n) or kept(q, n, held, compared))
        for found, right in ((top_k_dot(asked, rows, 3, exclude_self=True, tile_rows=16), want), (cells.search(index, asked.select("query_id", "vec"), 3, exclude_self=True), near)):
            got = {}
            for r in sorted(found.collect(), key=lambda r: (r.query_id, r["rank"])):
                got.setdefault(r.query_id, []).append((-r.similarity, r.item_id))
            assert got == right
        assert copied[0] == (1 if size == 1000 else 5)
        assert "FlatMapCoGroups" not in found._jdf.queryExecution().executedPlan().toString()
        monkeypatch.setattr(tiles, "in_pieces", kept)
