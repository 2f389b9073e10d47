"""Near duplicates by MinHash banding, exact confirmation and connected components.

A document's set holds its distinct shingles of ``k`` words (a shorter text is one
shingle; a text without words has none and is linked with nothing). Texts of equal
sets are one node, named by a hash of the set. Nodes get
``BANDS * ROWS`` minima of universal hashes; two that agree on a whole band share a
bucket. At a similarity of 0.8 a pair shares no bucket with probability
(1 - 0.8 ** ROWS) ** BANDS = 5e-9. In a bucket only pairs of different components are
compared: first with the ends of the bucket, so that a large group of copies costs
pairs in proportion to its size; what is then still apart pair by pair, in large
buckets inside tasks over blocks of members. A pair must agree on enough minima and
is confirmed on the full sets. Components come from
alternating large-star and small-star.

Defined results: rows that share a doc_id are one document, whose texts are tied together and
linked by each of them; a null doc_id is linked with nothing, has a null component and is kept; so is a
text without words, whatever other texts its document has. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .graph import components, linked
from .store import staged
from .text import Words, join2, mix, slices

SHINGLE = 5
PERCENT = 80
ROWS, BANDS = 5, 48
# Agreement of the minima below which a pair is dropped unseen: five standard errors under 0.8.
AGREE = 0.8 - 5 * (0.8 * 0.2 / (ROWS * BANDS)) ** 0.5
# Bands of the first round; buckets up to this size, and blocks of larger ones, in the last.
FIRST_BANDS = 3
SMALL_BUCKET = 32
BLOCK = 256
# Bytes of text whose shingles a task holds at a time (or one longer text).
HELD_BYTES = 1 << 20
_U = np.uint64


def _coefficients() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20240229)
    n = ROWS * BANDS
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def shingle_sets(texts: pa.Array, k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of every text; A-Z count as lower case."""
    w = Words(texts, lower=True)
    h = w.hashes()
    chain = mix(h + _U(k))
    last = chain.copy()
    for i in range(1, k):
        if len(h) > i:
            last[:-i] = join2(last[:-i], h[i:])
    out = []
    for a, b in zip(w.first[:-1], w.first[1:]):
        if b - a >= k:
            out.append(np.unique(last[a:b - k + 1]))
        elif b > a:
            whole = _U(b - a)
            key = np.array([whole], np.uint64)
            for x in h[a:b]:
                key = join2(key, np.array([x]))
            out.append(key)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def minima(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Minimum of every hash function over the set, in pieces that stay in cache."""
    x = (s >> _U(32)).astype(np.uint32)
    best = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 512):
        best = np.minimum(best, (np.multiply.outer(a, x[i:i + 512]) + b[:, None]).min(axis=1))
    return best


def _sketch(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _coefficients()
        band = np.arange(BANDS, dtype=np.uint64)
        for batch in slices(batches, budget=HELD_BYTES):
            n, prints, nodes, signs, bands = [], [], [], [], []
            for s in shingle_sets(batch.column("text"), k):
                n.append(len(s))
                prints.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                nodes.append(int.from_bytes(prints[-1][:8], "little", signed=True))
                m = minima(s, a, b)
                signs.append(m.tobytes())
                key = band.copy()
                for row in m.reshape(BANDS, ROWS).T:
                    key = join2(key, row.astype(np.uint64))
                bands.append(key.view(np.int64))
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "n": pa.array(n, pa.int64()), "fp": pa.array(prints, pa.binary()), "node": pa.array(nodes, pa.int64()),
                                   "sign": pa.array(signs, pa.binary()), "bands": pa.array(bands, pa.list_(pa.int64()))})
    return work


def _sets(k: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=HELD_BYTES):
            sets = shingle_sets(batch.column("text"), k)
            nodes = [int.from_bytes(hashlib.blake2b(s.tobytes(), digest_size=16).digest()[:8], "little", signed=True) for s in sets]
            yield pa.record_batch({"doc": pa.array(nodes, pa.int64()), "shingles": pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))})
    return work


def _agreement(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        both = [np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint32).reshape(batch.num_rows, ROWS * BANDS) for c in ("sa", "sb")]
        ok = (both[0] == both[1]).mean(axis=1) >= AGREE
        yield batch.select(["a", "b"]).filter(pa.array(ok))


def _verified(pairs: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose minima agree and whose full sets reach the similarity."""
    close = (pairs.join(signs.toDF("a", "na", "sa"), "a").join(signs.toDF("b", "nb", "sb"), "b")
             .filter(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b", "sa", "sb")
             .mapInArrow(_agreement, "a long, b long"))
    full = close.join(sets.toDF("a", "xa"), "a").join(sets.toDF("b", "xb"), "b")
    common = F.size(F.array_intersect("xa", "xb"))
    return full.filter(100 * common >= percent * (F.size("xa") + F.size("xb") - common)).select("a", "b")


def _apart(members: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of buckets that still hold two components, with the two ends of their bucket."""
    named = members.join(roots, members["doc"] == roots["node"], "left").select("key", "doc", F.coalesce("root", "doc").alias("root"))
    ends = named.groupBy("key").agg(F.min(F.struct("root", "doc")).alias("low"), F.max(F.struct("root", "doc")).alias("high"), F.count("*").alias("size"))
    return named.join(ends.filter("low.root < high.root"), "key")


def _by_blocks(apart: DataFrame, roots: DataFrame, signs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of large buckets that are still apart, found inside tasks.

    Members that such buckets connect form a cluster, which is dealt into blocks; a task
    compares two blocks and returns no more links than join what it holds.
    """
    edges = apart.filter("low <> doc").select(F.least("low", "doc").alias("a"), F.greatest("low", "doc").alias("b"))
    clusters = components(edges).toDF("doc", "cluster")
    sizes = clusters.groupBy("cluster").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = clusters.join(sizes, "cluster").withColumn("own", F.pmod(F.xxhash64("doc"), "blocks").cast("int"))
    full = (placed.join(roots.withColumnRenamed("node", "doc"), "doc", "left").withColumn("root", F.coalesce("root", "doc"))
            .join(signs, "doc").join(sets, "doc"))
    pairs = full.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    pairs = pairs.select("cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc", "root", "sign", "shingles")

    def work(table: pa.Table) -> pa.Table:
        doc, root = table.column("doc").to_numpy(), table.column("root").to_numpy()
        sign = np.frombuffer(b"".join(table.column("sign").to_pylist()), np.uint32).reshape(len(doc), ROWS * BANDS)
        column = table.column("shingles").combine_chunks()
        bounds, values = column.offsets.to_numpy(), column.values.to_numpy()
        held = [values[x:y] for x, y in zip(bounds[:-1], bounds[1:])]
        own, first = table.column("own").to_numpy(), table.column("i").to_numpy()
        left = np.flatnonzero(own == first)
        right = np.flatnonzero(own != first) if (table.column("j").to_numpy() != first).any() else left
        parent = {int(r): int(r) for r in root}

        def top(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x
        out: tuple[list, list] = ([], [])
        for x in left:
            close = right[((sign[right] == sign[x]).mean(axis=1) >= AGREE) & (root[right] != root[x])]
            for y in close:
                if top(int(root[x])) == top(int(root[y])):
                    continue
                n, m = len(held[x]), len(held[y])
                common = len(np.intersect1d(held[x], held[y], assume_unique=True)) if 100 * min(n, m) >= percent * max(n, m) else 0
                if 100 * common >= percent * (n + m - common):
                    parent[top(int(root[x]))] = top(int(root[y]))
                    out[0].append(min(doc[x], doc[y]))
                    out[1].append(max(doc[x], doc[y]))
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})
    return pairs.groupBy("cluster", "i", "j").applyInArrow(work, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).filter("a < b").distinct()


def duplicate_groups(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id, kept."""
    kind = docs.schema["doc_id"].dataType
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketch = staged(docs.mapInArrow(_sketch(k), "doc_id long, n long, fp binary, node long, sign binary, bands array<long>"), "sketches")
    some = sketch.filter("n > 0 and doc_id is not null")
    # a node is a set; its smallest doc_id stands for the texts that share it. Every plan below starts from written
    # tables: what a plan joins, shuffles and broadcasts at once takes memory of the driver, whatever its rows
    of_set = [F.first(c).alias(c) for c in ("n", "sign", "bands")]
    classes = staged(some.groupBy("node").agg(F.min("doc_id").alias("rep"), *of_set), "classes")
    buckets = classes.select(F.col("node").alias("doc"), F.posexplode("bands").alias("band", "key"))
    crowded = buckets.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1").select("key")
    members = staged(buckets.join(crowded, "key").select("key", "band", "doc"), "buckets")
    wanted = members.select(F.col("doc").alias("node")).distinct()
    asked = staged(classes.join(wanted, "node", "left_semi").select(F.col("node").alias("doc"), "rep", "n", "sign"), "signs")
    signs = asked.drop("rep")
    # a document of several texts brings all of them
    sets = staged(docs.join(asked.select(F.col("rep").alias("_rep")), F.col("doc_id") == F.col("_rep"), "left_semi")
                   .mapInArrow(_sets(k), "doc long, shingles array<long>").dropDuplicates(["doc"]), "sets")
    # texts of one document belong together from the start
    several = some.groupBy("doc_id").agg(F.min("node").alias("low"), F.max("node").alias("high")).filter("low < high")
    tied = some.join(several, "doc_id").filter("node > low").select(F.col("low").alias("a"), F.col("node").alias("b"))
    roots = linked(tied)

    def grown(found: DataFrame) -> DataFrame:
        return linked(roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(found))

    # few bands tie a large group together before all bands are looked at
    tested = None
    for some_bands in (members.filter(F.col("band") < FIRST_BANDS), members):
        apart = _apart(some_bands, roots)
        ends = F.explode(F.array("low", "high"))
        pairs = _ordered(apart.select("doc", "root", ends.alias("end")).filter("root <> end.root").select(F.col("doc").alias("x"), F.col("end.doc").alias("y")))
        fresh = staged(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        tested = fresh if tested is None else tested.unionByName(fresh)
        roots = grown(_verified(fresh, signs, sets, percent))
    apart = staged(_apart(members, roots).select("key", "doc", "root", F.col("low.doc").alias("low"), "size"), "apart")
    largest = apart.agg(F.max("size")).first()[0] or 0
    if largest:
        other = apart.select("key", F.col("doc").alias("y"), F.col("root").alias("other"))
        pairs = apart.filter(F.col("size") <= SMALL_BUCKET).join(other, "key").filter("root < other").select(F.col("doc").alias("x"), "y")
        found = _verified(staged(_ordered(pairs).join(tested, ["a", "b"], "left_anti"), "pairs"), signs, sets, percent)
        if largest > SMALL_BUCKET:
            found = staged(found, "links").unionByName(_by_blocks(apart.filter(F.col("size") > SMALL_BUCKET), roots, signs, sets, percent))
        roots = grown(found)
    named = classes.select("node", "rep").join(roots, "node", "left").select("node", "rep", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("rep").alias("component"))
    named = staged(named.join(smallest, "root").select("node", "component"), "components")
    lone = sketch.filter("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    grouped = some.select("doc_id", "n", "node").join(named, "node").select("doc_id", "n", "component")
    return grouped.unionByName(lone).select(
        F.col("doc_id").cast(kind).alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").cast(kind).alias("component_id"),
        F.coalesce(F.col("doc_id") == F.col("component"), F.lit(True)).alias("kept"))


def keep_one(docs: DataFrame, k: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` whose document stands for its group, with all their columns."""
    gone = duplicate_groups(docs, k, percent).filter("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
