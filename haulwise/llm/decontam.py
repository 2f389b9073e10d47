"""Benchmark decontamination with an FM-index per training shard.

A shard is a run of documents of about ``SHARD_BYTES`` of text; its index (``fmindex.py``)
is written once as a row of a table, with equal texts indexed once. Benchmark items become
windows of ``WINDOW`` consecutive words (an item of fewer words is one window), held in
blocks of about ``BLOCK_WORDS`` words, so that what a task holds and what is broadcast at a
time does not grow with the benchmark. Every block is searched backwards in all shards;
the occurrences are located and merged to spans of words.

A longer text is cut at word limits into parts of ``SHARD_BYTES`` that share ``WINDOW - 1`` words,
and a long item into runs of ``RUN`` words that share as many. Words are compared by 64-bit hashes.

Defined results: a null or empty text has no words and no hits; an item without words has
no window; a null item_id is named by the empty string; equal item_ids are one name. Every
row of documents is a document of its own, also with a repeated or null doc_id. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import spread
from .fmindex import FMIndex
from .store import staged
from .text import Words, raw, slices

WINDOW = 10
SHARD_BYTES = 4 << 20
# Words of the benchmark per block, and per row of a long item.
BLOCK_WORDS = 2_000_000
RUN = 4096

# Bytes that end a word: all of ASCII but digits and letters.
BREAK = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])


def words(texts: pa.Array) -> Words:
    """Words of lower-cased texts: digits, letters a-z and all characters beyond ASCII."""
    return Words(texts, lower=True, space=BREAK)


def _parts(data: np.ndarray, size: int) -> Iterator[pa.Array]:
    """A long text cut in front of word breaks."""
    at = 0
    while at < len(data):
        to = min(at + size, len(data))
        while to < len(data) and not BREAK[data[to]]:
            step = BREAK[data[to:to + size]]
            to += int(step.argmax()) if step.any() else len(step)
        yield pa.array([data[at:to].tobytes()], pa.binary())
        at = to


MEMBERS = "array<struct<row:bigint,doc_id:{kind},fp:bigint,n_words:bigint,base:bigint,text:int>>"
INDEX = "shard struct<" + ",".join(f"{f}:binary" for f in FMIndex.FIELDS) + ">, members " + MEMBERS


def index(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """The written index of ``docs`` (doc_id, text): one row per shard, with the documents in it.

    A member is a document (``row`` numbers the rows of ``docs``, ``fp`` is a hash of its text), the number of
    its words first seen in this shard, the place of the shard's first word in it, and its text's number in the
    shard (-1: no words).
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = spread(docs.select("doc_id", "text")).select(F.monotonically_increasing_id().alias("row"), "doc_id", F.xxhash64("text").alias("fp"), "text")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=SHARD_BYTES):
            ids = [batch.column(c) for c in ("row", "doc_id", "fp")]
            data, _ = raw(batch.column("text"))
            if batch.num_rows > 1 or len(data) <= 2 * SHARD_BYTES:
                found = words(batch.column("text"))
                h = found.hashes()
                held, number, texts = {}, [], []
                for a, b in zip(found.first[:-1], found.first[1:]):
                    key = h[a:b].tobytes()
                    if b > a and key not in held:
                        held[key] = len(texts)
                        texts.append(h[a:b])
                    number.append(held.get(key, -1))
                yield from row(ids, texts, found.counts, 0, number)
                continue
            tail, seen = np.zeros(0, np.uint64), 0
            for part in _parts(data, SHARD_BYTES):
                fresh = words(part).hashes()
                both = np.concatenate([tail, fresh])
                if len(both):
                    yield from row(ids, [both], np.array([len(fresh)]), seen - len(tail), [0])
                seen += len(fresh)
                tail = both[max(0, len(both) - window + 1):]
            if not seen:
                yield from row(ids, [], np.array([0]), 0, [-1])

    def row(ids: list, texts: list, counts: np.ndarray, base: int, number: list) -> Iterator[pa.RecordBatch]:
        n = len(number)
        fields = [*ids, pa.array(counts, pa.int64()), pa.array([base] * n, pa.int64()), pa.array(number, pa.int32())]
        members = pa.StructArray.from_arrays(fields, ["row", "doc_id", "fp", "n_words", "base", "text"])
        blobs = FMIndex.build(texts).dump() if texts else dict.fromkeys(FMIndex.FIELDS, b"")
        yield pa.record_batch({"shard": pa.array([blobs], pa.struct([(f, pa.binary()) for f in FMIndex.FIELDS])),
                               "members": pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), members)})
    return staged(rows.mapInArrow(work, INDEX.format(kind=kind)), "fm-index")


def phrases(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Word hashes of ``items`` (item_id, text): item, words; long items in runs that share ``window - 1`` words."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            names, runs = [], []
            found = words(batch.column("text"))
            h = found.hashes().view(np.int64)
            for name, a, b in zip(batch.column("item").to_pylist(), found.first[:-1], found.first[1:]):
                for i in range(a, b, RUN):
                    if i == a or b - i >= window:
                        names.append(name)
                        runs.append(h[i:min(i + RUN + window - 1, b)])
            yield pa.record_batch({"item": pa.array(names, pa.string()), "words": pa.array(runs, pa.list_(pa.int64()))})
    named = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return named.mapInArrow(work, "item string, words array<long>")


class Phrases:
    """Distinct windows of one block of items, by length, and the items that hold each."""

    def __init__(self, table: pa.Table, window: int) -> None:
        self.items = table.column("item").to_pylist()
        column = table.column("words").combine_chunks()
        ends, flat = column.offsets.to_numpy(), column.values.to_numpy().view(np.uint64)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        size = np.diff(ends)
        for n in sorted(set(np.minimum(size, window).tolist())):
            own = np.flatnonzero(np.minimum(size, window) == n)
            count = size[own] - n + 1
            item = np.repeat(own, count)
            start = np.repeat(ends[own], count) + np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
            rows = flat[start[:, None] + np.arange(n)]
            distinct, which = np.unique(rows, axis=0, return_inverse=True)
            order = np.argsort(which.ravel(), kind="stable")
            self.by_length[n] = distinct, np.searchsorted(which.ravel()[order], np.arange(len(distinct) + 1)), item[order]


def merge(begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Overlapping and touching spans as one."""
    order = np.argsort(begins, kind="stable")
    begins, reach = begins[order], np.maximum.accumulate(ends[order])
    fresh = np.ones(len(begins), bool)
    fresh[1:] = begins[1:] > reach[:-1]
    last = np.append(np.flatnonzero(fresh)[1:], len(begins)) - 1
    return begins[fresh], reach[last]


HITS = "row long, begins array<long>, ends array<long>, items array<string>"


def _hits(shards: DataFrame, block, window: int) -> DataFrame:
    """Merged spans and item names per document row of every shard, for one broadcast block."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Phrases(block.value, window)
        for batch in batches:
            for shard, members in zip(batch.column("shard"), batch.column("members")):
                held = shard.as_py()
                if not held["starts"]:
                    continue
                found = FMIndex.load(held)
                spans: dict[int, tuple[list, list, list]] = {}
                for n, (windows, first, item) in asked.by_length.items():
                    which, text, place = found.occurrences(windows)
                    order = np.argsort(text, kind="stable")
                    which, text, place = which[order], text[order], place[order]
                    cuts = np.flatnonzero(np.diff(text, prepend=-1, append=-1)) if len(text) else []
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        parts = spans.setdefault(int(text[a]), ([], [], []))
                        parts[0].append(place[a:b])
                        parts[1].append(place[a:b] + n)
                        parts[2].extend(item[first[w]:first[w + 1]] for w in np.unique(which[a:b]))
                if not spans:
                    continue
                merged = {t: (*merge(np.concatenate(x), np.concatenate(y)), sorted({asked.items[i] for i in np.unique(np.concatenate(z))}))
                          for t, (x, y, z) in spans.items()}
                flat = members.values
                text, base, row = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("text", "base", "row"))
                hit = np.flatnonzero(np.isin(text, list(merged)))
                got = [merged[int(t)] for t in text[hit]]
                yield pa.record_batch({"row": pa.array(row[hit], pa.int64()),
                                       "begins": pa.array([g[0] + s for g, s in zip(got, base[hit])], pa.list_(pa.int64())),
                                       "ends": pa.array([g[1] + s for g, s in zip(got, base[hit])], pa.list_(pa.int64())),
                                       "items": pa.array([g[2] for g in got], pa.list_(pa.string()))})
    return shards.mapInArrow(work, HITS)


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of one document from several shards and blocks, merged."""
    for batch in batches:
        begins, ends = list(batch.column("begins").to_pylist()), list(batch.column("ends").to_pylist())
        for i in np.flatnonzero([len(b) > 1 for b in begins]):
            a, b = merge(np.array(begins[i]), np.array(ends[i]))
            begins[i], ends[i] = a.tolist(), b.tolist()
        kind = pa.list_(pa.int64())
        out = {c: batch.column(c) for c in batch.schema.names}
        yield pa.record_batch(out | {"begins": pa.array(begins, kind), "ends": pa.array(ends, kind)})


def search(shards: DataFrame, asked: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per document of an ``index``: row, doc_id, fp, n_words, the merged word spans (begins, ends) and the items found (sorted)."""
    spark = shards.sparkSession
    asked = staged(asked, "phrases")
    size = asked.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    blocks = -(-size // BLOCK_WORDS)
    # a block per pass: what the driver and a task hold is bounded, whatever the benchmark's size
    hits = []
    for i in range(blocks):
        held = asked.filter(F.pmod(F.xxhash64("item", "words"), F.lit(blocks)) == i).toArrow()
        if held.num_rows:
            block = spark.sparkContext.broadcast(held)
            hits.append(staged(_hits(shards, block, window), "hits"))
            block.destroy()
    flat = shards.select(F.explode("members").alias("m")).select("m.row", "m.doc_id", "m.fp", "m.n_words")
    kinds = {"begins": "array<long>", "ends": "array<long>", "items": "array<string>"}
    every = flat.select("*", *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()])
    for h in hits:
        every = every.unionByName(h, allowMissingColumns=True)
    gathered = every.groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.max("fp").alias("fp"), F.coalesce(F.sum("n_words"), F.lit(0)).alias("n_words"),
        *[F.flatten(F.collect_list(c)).alias(c) for c in ("begins", "ends")], F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    kind = shards.schema["members"].dataType.elementType["doc_id"].dataType.simpleString()
    return gathered.mapInArrow(_merged, f"row long, doc_id {kind}, fp long, n_words long, begins array<long>, ends array<long>, items array<string>")


def find(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """``search`` of all windows of ``items`` (item_id, text) in an index of ``docs`` (doc_id, text)."""
    return search(index(docs, window), phrases(items, window), window)


def remove(docs: DataFrame, found: DataFrame) -> DataFrame:
    """``docs`` with the words of the spans in ``found`` cut from their texts, from the first byte of a span's first word to its last one's end."""
    spans = found.filter(F.size("begins") > 0).select(F.col("doc_id").alias("_doc"), F.col("fp").alias("_fp"), F.col("begins").alias("_begins"),
                                                      F.col("ends").alias("_ends")).dropDuplicates(["_doc", "_fp"])
    joined = docs.join(spans, docs["doc_id"].eqNullSafe(F.col("_doc")) & (F.xxhash64(docs["text"]) == F.col("_fp")), "left").drop("_doc", "_fp")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=SHARD_BYTES):
            texts = batch.column("text").to_pylist()
            for i, (begins, ends) in enumerate(zip(batch.column("_begins").to_pylist(), batch.column("_ends").to_pylist())):
                if begins:
                    at = words(batch.column("text").slice(i, 1))
                    data, kept, last = at.data.tobytes(), [], 0
                    for a, b in zip(begins, ends):
                        kept.append(data[last:at.start[a]])
                        last = at.end[b - 1]
                    texts[i] = b"".join([*kept, data[last:]]).decode()
            rest = {c: batch.column(c) for c in batch.schema.names if c not in ("_begins", "_ends")}
            yield pa.record_batch(rest | {"text": pa.array(texts, pa.string())})
    return joined.mapInArrow(work, docs.schema)


SQL = r"""
WITH low AS (SELECT doc_id, row_number() OVER () AS r, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT r, doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, list_aggregate(w[i:i + least(len(w), 10) - 1], 'string_agg', ' ') AS g
       FROM (SELECT *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT r, i, n, list_aggregate(w[i:i + n - 1], 'string_agg', ' ') AS g
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
hit AS (SELECT dw.r, dw.i, dw.n, bw.item FROM dw JOIN bw USING (n, g)),
spots AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
names AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(h, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN spots USING (r) LEFT JOIN names USING (r)
"""
