"""Best-fit packing of tokenised documents by a configuration linear program.

Tasks tokenise whole texts, cut those that are longer than a sequence, and number the
pieces of each length. Only the histogram of lengths, at most ``SEQUENCE`` numbers,
reaches the driver. There the covering program over configurations (multisets of
lengths that fit a sequence) is solved by multiplicative weights: lengths that lag
behind weigh more, a knapsack dynamic program prices them, and every configuration
close to the best price receives a step. The fractional solution is rounded by
cumulative floors; places that the histogram cannot fill take what rounding left
over, by best fit. A configuration and its copies are numbers of the length, so tasks
then place every piece with a lookup.

Defined results: a null text is empty and makes one piece of one token (the end
mark); repeated rows are packed one by one; an empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window as W, functions as F

from .store import staged
from .text import slices

SEQUENCE = 2048
END = 0
ROUNDS = 160
STEP = 0.5
EAGER = 3.0
NEAR_BEST = 0.3
# Units (words with their blank) that a task remembers before it starts anew.
HELD_UNITS = 500_000
PIECES = "piece int, start long, length long, ids_crc32 long"

Config = tuple[tuple[int, int], ...]


class Encoder:
    """Token ids of whole texts, as little-endian 32-bit bytes.

    The vocabulary never merges across a blank that stands between two characters
    other than white space, so a text is a sequence of units (a blank and what follows
    it). Units are remembered; those of some texts that are not known yet are encoded
    as one text and taken apart by the byte lengths of their tokens. A text with the
    name of a special token goes through the tokenizer file.
    """

    def __init__(self, tokenizer: str, ranks: str, pattern: str) -> None:
        import base64
        import tiktoken
        with open(ranks, "rb") as f:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bpe = tiktoken.Encoding("units", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.size = np.zeros(max(table.values()) + 1, np.int64)
        self.size[list(table.values())] = [len(k) for k in table]
        self.file, self.full = tokenizer, None
        self.units: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.bpe.encode_ordinary(text), "<u4").tobytes()

    def named(self, text: str) -> bytes:
        if self.full is None:
            from tokenizers import Tokenizer
            self.full = Tokenizer.from_file(self.file)
        return np.array(self.full.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, units: list[str]) -> None:
        """Encode unknown units together; each starts after a blank."""
        ids = np.array(self.bpe.encode_ordinary(" " + " ".join(units)), "<u4")
        ends = np.cumsum([len(u.encode()) + 1 for u in units])
        stops = np.searchsorted(np.cumsum(self.size[ids]), ends) + 1
        raw, at = ids.tobytes(), 0
        for u, stop in zip(units, (stops * 4).tolist()):
            self.units[u] = raw[at:stop]
            at = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out: list = [b""] * len(texts)
        split = {}
        for i, text in enumerate(texts):
            if text and "<|" in text:
                out[i] = self.named(text)
            elif text:
                split[i] = text.split(" ")
        if len(self.units) >= HELD_UNITS:
            self.units.clear()
        known = self.units
        # a unit that is empty or has white space at an end never becomes known
        new = [u for u in set().union(*split.values()).difference(known) if u and not (u[0].isspace() or u[-1].isspace())]
        if new:
            self.learn(new)
        for i, units in split.items():
            try:
                out[i] = self.plain(units[0]) + b"".join(map(known.__getitem__, units[1:]))
            except KeyError:
                out[i] = self.plain(texts[i])
            else:
                if units[0][-1:].isspace() or not units[0]:
                    out[i] = self.plain(texts[i])
        return out


def cut_pieces(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, size: int = SEQUENCE) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, checksum, its task, and its number among that task's pieces of this length."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, seen = Encoder(tokenizer, ranks, pattern), np.zeros(size + 1, np.int64)
        task, end = TaskContext.get().partitionId(), np.array([END], "<u4").tobytes()
        for batch in slices(batches):
            row, piece, start, length, crc = [], [], [], [], []
            for i, ids in enumerate(encoder.encode(batch.column("text").to_pylist())):
                ids = memoryview(ids + end)
                n = len(ids) // 4
                at, k = 0, 0
                while at < n:
                    take = (n - 1) % size + 1 if not at else size
                    row.append(i)
                    piece.append(k)
                    start.append(at)
                    length.append(take)
                    crc.append(zlib.crc32(ids[4 * at:4 * (at + take)]))
                    at, k = at + take, k + 1
            lengths = np.array(length, np.int64)
            order = np.argsort(lengths, kind="stable")
            ranked = lengths[order]
            nth = np.empty(len(order), np.int64)
            nth[order] = np.arange(len(order)) - np.searchsorted(ranked, ranked)
            nth += seen[lengths]
            seen += np.bincount(lengths, minlength=size + 1)
            yield pa.record_batch({
                "doc_id": batch.column("doc_id").take(pa.array(row, pa.int64())), "piece": pa.array(piece, pa.int32()),
                "start": pa.array(start, pa.int64()), "length": pa.array(lengths), "ids_crc32": pa.array(crc, pa.int64()),
                "task": pa.array([task] * len(row), pa.int32()), "nth": pa.array(nth)})
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {PIECES}, task int, nth long")


def price(value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Knapsack program: the best value of every capacity, and the length to take first (0: leave one place empty)."""
    size = len(value) - 1
    best, pick = np.zeros(size + 1), np.zeros(size + 1, np.int64)
    for c in range(1, size + 1):
        ways = best[c - 1::-1] + value[1:c + 1] if c > 1 else best[:1] + value[1:2]
        k = int(ways.argmax())
        if ways[k] > best[c - 1]:
            best[c], pick[c] = ways[k], k + 1
        else:
            best[c] = best[c - 1]
    return best, pick


def _fill(seeds: np.ndarray, pick: np.ndarray) -> list[Config]:
    """The configuration of each seed: the seed and the best filling of what it leaves."""
    left = len(pick) - 1 - seeds
    items = [[int(s)] for s in seeds]
    live = np.flatnonzero(left > 0)
    while len(live):
        taken = pick[left[live]]
        for i, t in zip(live, taken):
            if t:
                items[i].append(int(t))
        left[live] -= np.maximum(taken, 1)
        live = live[left[live] > 0]
    out = []
    for x in items:
        kinds, times = np.unique(x, return_counts=True)
        out.append(tuple(zip(kinds[::-1].tolist(), times[::-1].tolist())))
    return out


def fractional(demand: np.ndarray, rounds: int = ROUNDS) -> dict[Config, float]:
    """Multiplicative weights on the covering program: how often to use each configuration.

    The price of a length is its volume times a weight that falls exponentially with
    the share of its demand that is covered. No step covers more than ``STEP`` of any
    demand, which bounds the width of the program, nor more than is still uncovered.
    """
    kinds = np.flatnonzero(demand)
    covered, use = np.zeros(len(demand)), {}
    for _ in range(rounds):
        share = covered[kinds] / demand[kinds]
        bare = share < 1 - 1e-9
        if not bare.any():
            break
        value = np.full(len(demand), -1.0)
        value[kinds[bare]] = (kinds * np.exp(-EAGER * (share - share.min())))[bare]
        best, pick = price(value)
        worth = value[kinds] + best[len(demand) - 1 - kinds]
        seeds = kinds[bare & (worth >= (1 - NEAR_BEST) * best[-1])]
        configs = list(set(_fill(seeds, pick)))
        # configurations of a round share what each length may gain
        wanted = np.zeros(len(demand))
        for config in configs:
            for k, n in config:
                wanted[k] += n
        gain = np.minimum(STEP * demand, demand - covered) / np.maximum(wanted, 1)
        for config in configs:
            x = min(gain[k] for k, n in config)
            use[config] = use.get(config, 0.0) + x
            for k, n in config:
                covered[k] += n * x
    return use


def rounded(demand: np.ndarray, use: dict[Config, float]) -> list[tuple[Config, int]]:
    """Whole copies by cumulative floors in order of the longest lengths; the rest by best fit into gaps and new sequences."""
    size, left = len(demand) - 1, demand.astype(np.int64).copy()
    gaps: list[list[tuple[Config, int]]] = [[] for _ in range(size + 1)]
    room = np.zeros(size + 1, np.int64)

    def put(config: Config, copies: int) -> None:
        if copies:
            free = size - sum(k * n for k, n in config)
            gaps[free].append((config, copies))
            room[free] += copies

    total = 0.0
    for config in sorted(use, reverse=True):
        before, total = int(total), total + use[config]
        groups = [((), int(total) - before)]
        for k, n in config:
            after = []
            for have, copies in groups:
                whole = min(copies, int(left[k]) // n)
                left[k] -= whole * n
                after.append((have + ((k, n),), whole))
                some = int(left[k]) if whole < copies else 0
                if some:
                    left[k] = 0
                    after.append((have + ((k, some),), 1))
                after.append((have, copies - whole - bool(some)))
            groups = [g for g in after if g[1]]
        for have, copies in groups:
            if have:
                put(have, copies)
    for k in range(size, 0, -1):
        while left[k]:
            fits = np.flatnonzero(room[k:])
            if len(fits):
                free = k + int(fits[0])
                config, copies = gaps[free].pop()
                room[free] -= copies
                used = min(copies, int(left[k]))
                put(config, copies - used)
                kinds = dict(config)
                kinds[k] = kinds.get(k, 0) + 1
                put(tuple(sorted(kinds.items(), reverse=True)), used)
                left[k] -= used
            else:
                each = min(size // k, int(left[k]))
                put(((k, each),), int(left[k]) // each)
                left[k] -= int(left[k]) // each * each
    merged: dict[Config, int] = {}
    for held in gaps:
        for config, copies in held:
            merged[config] = merged.get(config, 0) + copies
    return list(merged.items())


class Places:
    """Where the pieces of each length go: runs of their numbers, sorted by length and number."""

    def __init__(self, plan: list[tuple[Config, int]]) -> None:
        rows, taken, base = [], {}, 0
        for config, copies in plan:
            offset = 0
            for k, n in config:
                rows.append((k, taken.get(k, 0), n, base, offset))
                taken[k] = taken.get(k, 0) + n * copies
                offset += k * n
            base += copies
        table = np.array(sorted(rows), np.int64).reshape(-1, 5)
        self.sequences = base
        self.key = (table[:, 0] << 48) | table[:, 1]
        self.since, self.each, self.base, self.offset = table[:, 1], table[:, 2], table[:, 3], table[:, 4]

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.key, (length << 48) | number, "right") - 1
        within = number - self.since[at]
        return self.base[at] + within // self.each[at], self.offset[at] + within % self.each[at] * length


def pack(pieces: DataFrame, size: int = SEQUENCE) -> DataFrame:
    """Place pieces (with ``length``, ``task`` and ``nth``): adds sequence_id and offset.

    ``pieces`` is written once, so that the numbers of a task cannot change.
    """
    spark = pieces.sparkSession
    pieces = staged(pieces, "pieces")
    counts = pieces.groupBy("task", "length").agg(F.count("*").alias("n"))
    earlier = W.partitionBy("length").orderBy("task").rowsBetween(W.unboundedPreceding, -1)
    bases = counts.select("task", "length", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    demand = np.zeros(size + 1, np.int64)
    for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most `size` rows
        demand[r.length] = r.n
    places = Places(rounded(demand, fractional(demand)) if demand.any() else [])
    shared = spark.sparkContext.broadcast(places)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sequence, offset = shared.value.find(b.column("length").to_numpy(), b.column("number").to_numpy())
            yield pa.record_batch([*b.columns[:-1], pa.array(sequence), pa.array(offset)], [*b.schema.names[:-1], "sequence_id", "offset"])
    kind = pieces.schema["doc_id"].dataType.simpleString()
    return (pieces.join(bases, ["task", "length"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("nth") + F.col("base")).alias("number"))
            .mapInArrow(work, f"doc_id {kind}, {PIECES}, sequence_id long, offset long"))


def pack_documents(docs: DataFrame, tokenizer: str, ranks: str, pattern: str, size: int = SEQUENCE) -> DataFrame:
    """Tokenise, cut and pack ``docs`` (doc_id, text)."""
    return pack(cut_pieces(docs, tokenizer, ranks, pattern, size), size)
