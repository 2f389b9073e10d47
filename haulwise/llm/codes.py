"""Vector code compression: product codes from per-dimension value dictionaries.

Components become integers, ``floor(SCALE * x)``, and vectors are cut into ``PARTS`` equal
parts. Blocks of vectors are written once: for each dimension the dictionary of the block's distinct integers,
and each vector's number in it. A round tabulates, per dimension, the squared difference of every distinct integer
to all codebook entries; the distance of a part is then a sum of table rows, gathered by
the dictionary numbers. Tasks return sums and counts per entry, so what a round shuffles and
collects (``PARTS * ENTRIES`` rows a task, one codebook on the driver) does not grow with the table.

Defined results: vectors that are null, empty or hold null or non-finite components take no
part, nor do vectors with a component of ``LIMIT`` or more after scaling (their squared distances would not
fit 64 bits) and vectors of another length than the one of the smallest vec_id. Lengths
that PARTS does not divide are filled up with zeros. Of several rows with one vec_id the smallest vector
stands in the first codebook; all are coded. Rows with a null vec_id are coded, but are in no first
codebook; without any vec_id there is no codebook and no row. Null labels are one label.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .store import staged

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
LIMIT = 1 << 27
# Vectors of a block, and rows of it whose distances are summed at a time.
BLOCK_VALUES = 1 << 19
TILE = 256


def scaled(vectors: DataFrame, embedding: str, scale: int) -> DataFrame:
    """Rows with usable vectors, and their integers as ``_v``."""
    v = F.col(embedding)
    usable = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double") * scale) < LIMIT))
    return vectors.filter(v.isNotNull() & (F.size(v) > 0) & usable).withColumn(
        "_v", F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("int")))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Integer rows, filled up with zeros to ``width``."""
    flat = column.flatten().to_numpy().astype(np.int64)
    rows = flat.reshape(len(column), len(flat) // max(1, len(column)))
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


def _blocks(rows: DataFrame, width: int) -> DataFrame:
    """One row per block: its ids and labels, the dictionaries, and numbers of (dimension, vector)."""
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("vec_id", "label")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = max(1, BLOCK_VALUES // width)
        for batch in batches:
            for at in range(0, batch.num_rows, size):
                part = batch.slice(at, size)
                values, numbers = [], []
                for column in matrix(part.column("v"), width).T:
                    held, number = np.unique(column, return_inverse=True)
                    values.append(held)
                    numbers.append(number.astype(np.int32))
                one = pa.array([0, part.num_rows], pa.int32())
                yield pa.record_batch({
                    "vec_id": pa.ListArray.from_arrays(one, part.column("vec_id")), "label": pa.ListArray.from_arrays(one, part.column("label")),
                    "values": pa.array([np.concatenate(values).tobytes()], pa.binary()), "sizes": pa.array([[len(h) for h in values]], pa.list_(pa.int32())),
                    "numbers": pa.array([np.concatenate(numbers).tobytes()], pa.binary())})
    return rows.mapInArrow(work, f"vec_id array<{kinds['vec_id']}>, label array<{kinds['label']}>, values binary, sizes array<int>, numbers binary")


def nearest(values: list[np.ndarray], numbers: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest entry of one part and its squared distance, by gathers and adds over the dictionaries of the part's dimensions."""
    reach = max(max(abs(int(h[0])), abs(int(h[-1]))) for h in values) + int(np.abs(book).max())
    kind = np.int32 if reach * reach * len(values) < 1 << 31 else np.int64
    tables = [((held[:, None] - book[:, d]) ** 2).astype(kind) for d, held in enumerate(values)]
    n = numbers.shape[1]
    best, far = np.empty(n, np.int64), np.empty(n, np.int64)
    total, row = np.empty((TILE, len(book)), kind), np.empty((TILE, len(book)), kind)
    for at in range(0, n, TILE):
        m = min(TILE, n - at)
        np.take(tables[0], numbers[0, at:at + m], axis=0, out=total[:m], mode="clip")
        for table, number in zip(tables[1:], numbers[1:]):
            np.take(table, number[at:at + m], axis=0, out=row[:m], mode="clip")
            total[:m] += row[:m]
        best[at:at + m] = total[:m].argmin(axis=1)  # the first of equal ones
        far[at:at + m] = total[np.arange(m), best[at:at + m]]
    return best, far


def _opened(batch: pa.RecordBatch, i: int, parts: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Dictionaries and numbers of every part of a block."""
    sizes = np.array(batch.column("sizes")[i].as_py())
    values = np.split(np.frombuffer(batch.column("values")[i].as_py(), np.int64), np.cumsum(sizes)[:-1])
    numbers = np.frombuffer(batch.column("numbers")[i].as_py(), np.int32).reshape(len(sizes), -1)
    step = len(sizes) // parts
    for p in range(parts):
        yield values[p * step:(p + 1) * step], numbers[p * step:(p + 1) * step]


def _moved(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks after one round: floors of the means, unused entries as they were."""
    parts, entries, step = books.shape

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((parts, entries, step), np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            for i in range(batch.num_rows):
                for p, (values, numbers) in enumerate(_opened(batch, i, parts)):
                    best, _ = nearest(values, numbers, books[p])
                    counts[p] += np.bincount(best, minlength=entries)
                    order = np.argsort(best, kind="stable")
                    used, first = np.unique(best[order], return_index=True)
                    for d, (held, number) in enumerate(zip(values, numbers)):
                        sums[p, used, d] += np.add.reduceat(held[number[order]], first)
        slot = np.flatnonzero(counts.ravel())
        rows = sums.reshape(-1, step)[slot]
        yield pa.record_batch([pa.array(slot, pa.int32()), pa.array(counts.ravel()[slot], pa.int64()), *(pa.array(c, pa.int64()) for c in rows.T)],
                              ["slot", "n", *(f"s{d}" for d in range(step))])
    names = [f"s{d}" for d in range(step)]
    found = blocks.select("values", "sizes", "numbers").mapInArrow(work, "slot int, n long, " + ", ".join(f"{c} long" for c in names))
    got = found.groupBy("slot").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).toArrow()
    after = books.reshape(-1, step).copy()
    slot, n = got.column("slot").to_numpy(), got.column("n").to_numpy()
    if len(slot):
        after[slot] = np.stack([got.column(c).to_numpy() for c in names], axis=1) // n[:, None]
    return after.reshape(books.shape)


def fit(rows: DataFrame, blocks: DataFrame, width: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """Codebooks (part, entry, dimension of the part) of ``rows`` (vec_id, v) and their ``blocks``."""
    ids = rows.select("vec_id").filter("vec_id is not null").distinct().orderBy("vec_id").limit(entries)
    # at most ``entries`` rows
    first = rows.select("vec_id", "v").join(F.broadcast(ids), "vec_id").groupBy("vec_id").agg(F.min("v").alias("v")).orderBy("vec_id").toArrow()
    books = matrix(first.column("v").combine_chunks(), width).reshape(first.num_rows, parts, width // parts).transpose(1, 0, 2)
    for _ in range(rounds):
        books = _moved(blocks, books)
    return books


CODED = "vec_id {vec_id}, label {label}, code string, error long"


def assign(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code (two hex digits a part) and summed squared distance of every vector."""
    parts = len(books)
    kinds = {c: blocks.schema[c].dataType.elementType.simpleString() for c in ("vec_id", "label")}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digits = np.array([b"%02x" % e for e in range(256)], "S2")
        for batch in batches:
            for i in range(batch.num_rows):
                found = [nearest(values, numbers, books[p]) for p, (values, numbers) in enumerate(_opened(batch, i, parts))]
                code = np.stack([digits[best] for best, _ in found], axis=1).view(f"S{2 * parts}").ravel()
                yield pa.record_batch({"vec_id": batch.column("vec_id")[i].values, "label": batch.column("label")[i].values,
                                       "code": pa.array(code.astype(str), pa.string()), "error": pa.array(sum(far for _, far in found), pa.int64())})
    return blocks.mapInArrow(work, CODED.format(**kinds))


def digest(books: np.ndarray) -> str:
    """SHA-256 of all entries' components by part, entry and position, joined by commas."""
    return hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, embedding: str = "embedding", scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """Coded rows (vec_id, label, code, error) of ``vectors`` (vec_id, label, ``embedding``), and the codebooks."""
    rows = scaled(vectors, embedding, scale).select("vec_id", "label", F.col("_v").alias("v"))
    smallest = rows.filter("vec_id is not null").agg(F.min(F.struct("vec_id", F.size("v").alias("dim")))).first()[0]
    dim = smallest.dim if smallest else 0
    width = -(-dim // PARTS) * PARTS or PARTS
    rows = rows.filter(F.size("v") == dim)
    blocks = staged(_blocks(rows, width), "code-blocks")
    books = fit(rows, blocks, width)
    return assign(blocks, books), books


def with_label_error(coded: DataFrame) -> DataFrame:
    """``coded`` with the error summed over its label; the labels' sums are joined, so a frequent label is not one task."""
    coded = staged(coded, "codes")
    sums = coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    return coded.join(sums, coded["label"].eqNullSafe(sums["_label"])).drop("_label")


def _sql(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    step = 64 // parts
    steps = [f"""k AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label,
  list_transform(embedding, lambda x: floor({SCALE} * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT r, part, v[part * {step} + 1:(part + 1) * {step}] AS s FROM k, (SELECT unnest(range({parts})) AS part)),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, s FROM p WHERE r <= {entries})"""]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (SELECT r, p.part, min((list_inner_product(p.s, p.s) - 2 * list_inner_product(p.s, c.s)
  + list_inner_product(c.s, c.s))::BIGINT * {entries} + e) AS m FROM p JOIN c{i} c ON p.part = c.part GROUP BY r, p.part)""")
        if i < rounds:
            steps.append(f"""c{i + 1} AS MATERIALIZED (SELECT part, e, coalesce(t, s) AS s FROM c{i} LEFT JOIN (SELECT part, e, list(f ORDER BY j) AS t FROM
  (SELECT part, m % {entries} AS e, j, floor(sum(s[j]) / count(*)) AS f FROM a{i} JOIN p USING (r, part), (SELECT unnest(range(1, {step + 1})) AS j) GROUP BY ALL)
  GROUP BY part, e) USING (part, e))""")
    return "WITH " + ",\n".join(steps) + f""",
h AS (SELECT sha256(string_agg(array_to_string(list_transform(s, lambda x: x::BIGINT::VARCHAR), ','), ',' ORDER BY part, e)) AS h FROM c{rounds}),
o AS (SELECT r, string_agg(printf('%02x', (m % {entries})::INTEGER), '' ORDER BY part) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, h AS codebooks_sha256 FROM k JOIN o USING (r), h"""


SQL = _sql()
