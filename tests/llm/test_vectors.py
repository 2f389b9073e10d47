"""Hard negatives and vector codes against brute force, SQL and odd rows."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from check_sql import compare, connect
from haulwise.llm import catalog, codes, negatives

ROWS = "vec_id long, embedding array<float>, label int, id string, v string"


@pytest.mark.parametrize("name", ["op12_hard_negatives", "op13_vector_codes"])
def test_queries_equal_sql(spark, folder, name):
    assert compare(catalog.queries()[name](spark, folder), connect(folder), catalog.sql()[name]) is None


def usable(row, scale):
    v = row[1]
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) and abs(np.float32(x).item() * scale) < 1 << 27 for x in v)


def whole(row, scale):
    return [math.floor(np.float32(x).item() * scale) for x in row[1]]


def brute_negatives(rows, every, positives=5, n=5, low=80, high=100):
    held = {}
    for r in rows:
        if r[0] is not None and r[2] is not None and usable(r, 256):
            held[r[0]] = min(held.get(r[0], (str(r[2]), whole(r, 256))), (str(r[2]), whole(r, 256)))
    out = []
    for a, (label, v) in held.items():
        if a % every:
            continue
        near = sorted((-sum(x * y for x, y in zip(v, w)), b, other) for b, (other, w) in held.items() if b != a and len(w) == len(v))
        for p, b, _ in [x for x in near if x[2] == label][:positives]:
            found = [(-s, c) for s, c, other in near if other != label and low * -p <= 100 * -s <= high * -p][:n]
            out += [(a, b, i + 1, c, -p, s) for i, (s, c) in enumerate(found)]
    return sorted(out)


def mined(df, every, **kw):
    got = negatives.hard_negatives(df, F.col("vec_id") % every == 0, **kw)
    return sorted((r.anchor_id, r.positive_id, r["rank"], r.negative_id, r.positive_score, r.negative_score) for r in got.collect())


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash") for r in rows], ROWS)


@pytest.mark.parametrize("tight", [False, True])
def test_negatives_in_cells_and_bundles(spark, monkeypatch, tight):
    """A hot vector, several cells and bundles; with tight directions most of the lists is never walked."""
    for name, value in (("CELL_ROWS", 40), ("BUNDLE_ROWS", 8), ("CLUSTER_ROWS", 4), ("FIRST_CHUNK", 4), ("CHUNK", 16)):
        monkeypatch.setattr(negatives, name, value)
    rng = np.random.default_rng(3)
    middle = rng.standard_normal((8, 16))
    v = middle[rng.integers(0, 8, 400)] + rng.standard_normal((400, 16)) * (0.05 if tight else 1)
    v[:130] = v[0]
    rows = [(i, [float(x) for x in v[i]], int(rng.integers(0, 3))) for i in range(400)]
    assert mined(table(spark, rows), 5) == brute_negatives(rows, 5)
    assert mined(table(spark, rows), 7, positives=2, negatives=3, low=50, high=90) == brute_negatives(rows, 7, 2, 3, 50, 90)


ODD = [(None, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (0, [1.0, 2.0], 1), (1, None, 1), (2, [1.0, 2.0], None), (3, [1.0, None], 1), (4, [1.0, float("nan")], 1),
       (5, [float("inf"), 1.0], 2), (6, [], 1), (7, [0.0, 0.0], 2), (8, [0.0, 0.0], 1), (9, [1.0, 2.0], 2), (9, [1.0, 1.0], 2), (10, [1.0, 2.0, 3.0], 1),
       (11, [1.0, 2.0, 3.0], 1), (12, [-1.0, -2.0], 1), (13, [0.9, 2.0], 1), (14, [1e30, 1.0], 1), (15, [1.0, 2.0, 2.9], 2), (16, [2.0, 1.0], 3), (20, [1.0, 2.0], 3)]


def test_negatives_of_odd_rows(spark):
    assert mined(table(spark, ODD), 1) == brute_negatives(ODD, 1)
    assert mined(table(spark, ODD).limit(0), 1) == [] and mined(table(spark, ODD), 1000000) == brute_negatives(ODD, 1000000)


def test_list_ends_early():
    """The walk of an anchor in a tight group leaves most of the rows alone."""
    rng = np.random.default_rng(5)
    v = np.repeat(np.eye(8) * 1000, 200, axis=0) + rng.integers(-20, 20, (1600, 8))

    class Counted(negatives.Side):
        def __init__(self, at):
            self.id, self.v = np.array(at), v[at].astype(np.int64)
            self.norm, self.label = np.sqrt((self.v.astype(float) ** 2).sum(axis=1)), np.array(["a"] * len(at), object)
    looked = []
    original = negatives._best
    rows, asked = Counted(list(range(1600))), Counted([0, 1, 2])
    try:
        negatives._best = lambda held, fresh: looked.append(fresh.shape[1]) or original(held, fresh)
        low, high = np.full((3, 1), -np.inf), np.full((3, 1), np.inf)
        q, _, r, s = negatives.walk(rows, asked, np.zeros(3, int), np.full(3, 0.05), low, high, np.eye(8)[:1], 5, True)
    finally:
        negatives._best = original
    exact = asked.v @ rows.v.T
    for i in range(3):
        exact[i, i] = -1
        assert s[q == i].tolist() == sorted(exact[i].tolist(), reverse=True)[:5] and (r < 200).all()
    assert sum(looked) < 800


def brute_codes(rows, parts=4, entries=256, rounds=4, scale=1024):
    kept = [(r[0], r[2], whole(r, scale)) for r in rows if usable(r, scale)]
    ids = [k[0] for k in kept if k[0] is not None]
    if not ids:
        return [], None
    dim = len(min((k for k in kept if k[0] == min(ids)), key=lambda k: len(k[2]))[2])
    kept = [k for k in kept if len(k[2]) == dim]
    fill = -(-dim // parts) * parts - dim
    x = np.array([k[2] + [0] * fill for k in kept], dtype=object).reshape(len(kept), parts, -1)
    first = {}
    for i, k in enumerate(kept):
        if k[0] is not None and (k[0] not in first or k[2] < kept[first[k[0]]][2]):
            first[k[0]] = i
    books = [[list(x[first[i]][p]) for i in sorted(first)[:entries]] for p in range(parts)]

    def nearest(p, row):
        return min((sum((a - b) ** 2 for a, b in zip(row, entry)), e) for e, entry in enumerate(books[p]))
    for step in range(rounds + 1):
        own = [[nearest(p, x[i][p]) for p in range(parts)] for i in range(len(kept))]
        if step < rounds:
            for p in range(parts):
                for e in range(len(books[p])):
                    some = [x[i][p] for i in range(len(kept)) if own[i][p][1] == e]
                    if some:
                        books[p][e] = [sum(c) // len(some) for c in zip(*some)]
    error = [sum(d for d, _ in o) for o in own]
    per = {}
    for k, e in zip(kept, error):
        per[k[1]] = per.get(k[1], 0) + e
    digest = hashlib.sha256(",".join(str(c) for p in books for entry in p for c in entry).encode()).hexdigest()
    return [(k[0], k[1], "".join(f"{e:02x}" for _, e in o), d, per[k[1]]) for k, o, d in zip(kept, own, error)], digest


def coded(df):
    got, books = codes.compress(df)
    return sorted(((r.vec_id, r.label, r.code, r.error, r.label_error) for r in codes.with_label_error(got).collect()), key=str), codes.digest(books)


def test_codes_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(codes, "ENTRIES", 6)
    monkeypatch.setattr(codes, "TILE", 7)
    monkeypatch.setattr(codes.fit, "__defaults__", (4, 6, 4))
    rng = np.random.default_rng(2)
    v = rng.standard_normal((150, 8))
    v[40:90] = v[40]
    v[:, 3] *= 3000
    rows = [(int(i) if i % 50 else None, [float(x) for x in v[i]], int(i % 3) if i % 11 else None) for i in range(150)]
    rows += [(3, [0.0] * 8, 1), (3, [0.0] * 8, 1), (-5, [1.0] * 8, 0)]
    want, digest = brute_codes(rows, entries=6)
    assert coded(table(spark, rows)) == (sorted(want, key=str), digest)


def test_codes_of_odd_rows(spark):
    want, digest = brute_codes(ODD)
    assert coded(table(spark, ODD)) == (sorted(want, key=str), digest)
    assert coded(table(spark, ODD).limit(0))[0] == []
    assert coded(table(spark, [(None, [1.0, 2.0], 1)]))[0] == []
