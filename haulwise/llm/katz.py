"""Scoring by a word bigram model with Katz back-off.

The model counts words and word pairs of all training texts. Counts are discounted by
Good-Turing: small counts by the ratio of neighbouring counts of counts, larger ones by
the line fitted to their logarithms, so every history keeps some mass. That mass goes
to the words not seen after it, in proportion to their unigram probability; the
back-off weight normalises exactly. What unigram discounting frees is the probability
of one unknown word. A text is its words and one end mark; its score is the sum over
tokens, seen pairs by their discounted count, others by weight and unigram.

The work is dealt by word: counts of a word and of all pairs that end in it live in one
bucket, as sorted arrays in a table with one row per bucket. Words that make up more
than a fixed part of a bucket have their pairs spread over all buckets, and their few
numbers travel with the tasks. Back-off weights are a second table, by history. Texts
send their pairs to the buckets and get sums per text back, packed by chunks of texts.

Histories are named by 48 bits of the word's hash, words by 64.

Defined results: a null text is empty (an end mark only); a null doc_id is scored but
not learned from; rows are scored one by one; without training texts every word is
unknown. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .store import staged
from .text import Words, join2, mix, slices

CHUNK_BYTES = 4 << 20
HOT_PARTS = 16
TURING = 5
# The line is fitted to counts up to this one; larger counts follow it.
FITTED = 1000
_U = np.uint64
START, END = _U(0x5BD1E99500010000), _U(0x27D4EB2F00020000)
_HIGH = _U(0xFFFFFFFFFFFF0000)


class Discount(NamedTuple):
    """Discounted counts: a table up to ``TURING``, then the fitted line of slope ``slope``."""

    table: np.ndarray
    slope: float

    def __call__(self, count: np.ndarray) -> np.ndarray:
        r = np.maximum(count, 1).astype(float)
        return np.where(count <= TURING, self.table[np.minimum(count, TURING).astype(int)], r * (1 + 1 / r) ** (self.slope + 1))


def good_turing(histogram: dict[int, int]) -> Discount:
    """From counts of counts. The line is fitted to counts averaged over the gaps between them."""
    r = np.array(sorted(histogram), float)
    slope = -2.0
    if len(r) > 1:
        n = np.array([histogram[int(x)] for x in r], float)
        after, before = np.append(r[1:], 2 * r[-1] - r[-2]), np.insert(r[:-1], 0, 0)
        slope = min(float(np.polyfit(np.log(r), np.log(2 * n / (after - before)), 1)[0]), -1.05)
    table = np.zeros(TURING + 1)
    for k in range(1, TURING + 1):
        line = k * (1 + 1 / k) ** (slope + 1)
        turing = (k + 1) * histogram.get(k + 1, 0) / histogram[k] if histogram.get(k) else 0.0
        table[k] = turing if 0 < turing < k else line
    return Discount(table, slope)


class Model(NamedTuple):
    """What every task holds: totals, discounts, and the numbers of the hot words (at most ``HOT_PARTS`` a bucket)."""

    buckets: int
    tokens: int
    kinds: int
    texts: int
    unknown: float
    words: Discount
    pairs: Discount
    hot: np.ndarray
    hot_counts: np.ndarray
    hot_weights: np.ndarray


class Tokens:
    """Tokens and their histories of some texts, each ending in the end mark."""

    def __init__(self, texts: pa.Array) -> None:
        w = Words(texts, lower=True)
        n = len(w.first) - 1
        self.counts = w.counts + 1
        self.token = np.empty(len(w.start) + n, np.uint64)
        ends = w.first[1:] + np.arange(n)
        is_word = np.ones(len(self.token), bool)
        is_word[ends] = False
        self.token[is_word], self.token[ends] = w.hashes(), END
        self.history = np.concatenate([[START], self.token[:-1]])[:len(self.token)] & _HIGH
        self.history[w.first[:-1] + np.arange(n)] = START
        self.text = np.repeat(np.arange(n), self.counts)


def home(word: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(word) % _U(buckets)).astype(np.int64)


def _place(word: np.ndarray, pair: np.ndarray, hot: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket of a pair: that of its word, or for a hot word one chosen by the pair."""
    return np.where(np.isin(word, hot), home(pair, buckets), home(word, buckets))


def _short(h: np.ndarray) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(h, "<u8").view(np.uint8).reshape(-1, 8)[:, 2:]).tobytes()


def _long(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 2:] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def _packed(counts: np.ndarray) -> bytes:
    """Counts in four bytes each, or in eight where one of them needs it."""
    return counts.astype("<u4" if not len(counts) or counts.max() < 1 << 32 else "<i8").tobytes()


def _pair_counts(pc: bytes, ph: bytes) -> np.ndarray:
    """Counts of as many pairs as there are histories."""
    return np.frombuffer(pc, "<u4" if len(pc) // 4 <= len(ph) // 6 else "<i8").astype(np.int64)


def _runs(sorted_keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _bounds(sorted_buckets: np.ndarray, buckets: int) -> np.ndarray:
    return np.searchsorted(sorted_buckets, np.arange(buckets + 1))


def _all(table: pa.Table, name: str, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _lookup(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _hot_words(docs: DataFrame, buckets: int) -> np.ndarray:
    """Words that hold more than 1 / (HOT_PARTS * buckets) of all tokens: at most so many."""
    parts = HOT_PARTS * buckets

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=CHUNK_BYTES):
            t = Tokens(batch.column("text")).token
            word, n = np.unique(t, return_counts=True)
            often = n * 2 * parts >= len(t)
            yield pa.record_batch({"word": pa.array(np.append(word[often].view(np.int64), 0)), "n": pa.array(np.append(n[often], len(t)))})
    counts = docs.select("text").mapInArrow(work, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    total = counts.filter("word = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rows = counts.filter((F.col("word") != 0) & (F.col("n") * parts >= total)).collect()
    return np.sort(np.array([r.word for r in rows] + [int(START.view(np.int64))], np.int64).view(np.uint64))


def _count(docs: DataFrame, hot: np.ndarray, buckets: int) -> DataFrame:
    """The table of counts: per bucket its words with counts, and its pairs sorted by word and history."""
    def chunk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=CHUNK_BYTES):
            t = Tokens(batch.column("text"))
            word, n = np.unique(t.token, return_counts=True)
            at = home(word, buckets)
            order = np.argsort(at, kind="stable")
            word, n, wb = word[order], n[order].astype("<u4"), _bounds(at[order], buckets)
            pair = join2(t.history, t.token)
            order = np.argsort(pair)
            first = _runs(pair[order])
            times = np.diff(np.append(first, len(pair))).astype("<u4")
            pick = order[first]
            w, h, k = t.token[pick], t.history[pick], pair[pick]
            at = _place(w, k, hot, buckets)
            order = np.lexsort((w, at))
            w, h, times, pb = w[order], h[order], times[order], _bounds(at[order], buckets)
            rows = {c: [] for c in ("bucket", "word", "n", "pw", "pn", "ph", "pc")}
            for b in range(buckets):
                i, j, x, y = wb[b], wb[b + 1], pb[b], pb[b + 1]
                if i == j and x == y:
                    continue
                runs = _runs(w[x:y])
                for c, v in zip(rows, (b, word[i:j].tobytes(), n[i:j].tobytes(), w[x:y][runs].tobytes(),
                                       np.diff(np.append(runs, y - x)).astype("<u4").tobytes(), _short(h[x:y]), times[x:y].tobytes())):
                    rows[c].append(v)
            yield pa.record_batch({c: pa.array(v, pa.int32() if c == "bucket" else pa.binary()) for c, v in rows.items()})

    def merge(table: pa.Table) -> pa.Table:
        word, n = _all(table, "word", "<u8"), _all(table, "n", "<u4").astype(np.int64)
        order = np.argsort(word)
        runs = _runs(word[order])
        word, n = word[order][runs], np.add.reduceat(n[order], runs) if len(runs) else n
        w = np.repeat(_all(table, "pw", "<u8"), _all(table, "pn", "<u4"))
        h, c = _long(b"".join(table.column("ph").to_pylist())), _all(table, "pc", "<u4").astype(np.int64)
        order = np.lexsort((h, w))
        w, h = w[order], h[order]
        runs = np.flatnonzero(np.concatenate([[True], (w[1:] != w[:-1]) | (h[1:] != h[:-1])])) if len(w) else np.zeros(0, np.int64)
        c = np.add.reduceat(c[order], runs) if len(runs) else c
        w, h = w[runs], h[runs]
        runs = _runs(w)
        out = {"word": word.tobytes(), "n": n.astype("<i8").tobytes(), "pw": w[runs].tobytes(),
               "pn": np.diff(np.append(runs, len(w))).astype("<u4").tobytes(), "ph": _short(h), "pc": _packed(c)}
        return pa.table({"bucket": table.column("bucket").slice(0, 1), **{k: pa.array([v], pa.binary()) for k, v in out.items()}})
    kinds = "bucket int, word binary, n binary, pw binary, pn binary, ph binary, pc binary"
    return docs.select("text").mapInArrow(chunk, kinds).groupBy("bucket").applyInArrow(merge, kinds)


class Bucket:
    """One row of the table of counts, ready for lookups."""

    def __init__(self, row: dict, model: Model) -> None:
        self.word, self.n = np.frombuffer(row["word"], "<u8"), np.frombuffer(row["n"], "<i8")
        self.pw = np.repeat(np.frombuffer(row["pw"], "<u8"), np.frombuffer(row["pn"], "<u4"))
        self.ph, self.pc, self.model = _long(row["ph"]), _pair_counts(row["pc"], row["ph"]), model

    def count(self, word: np.ndarray) -> np.ndarray:
        at, found = _lookup(self.word, word)
        n = np.where(found, self.n[at], 0) if len(self.word) else np.zeros(len(word), np.int64)
        at, found = _lookup(self.model.hot, word)
        return np.where(found, self.model.hot_counts[at], n)

    def unigram(self, count: np.ndarray) -> np.ndarray:
        return np.where(count > 0, self.model.words(count) / max(self.model.tokens, 1), self.model.unknown)


def _totals(counts: DataFrame, hot: np.ndarray) -> list:
    """Counts of counts (kinds 1 and 2), sums (0), and counts of hot words (3)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                word, n, c = np.frombuffer(row["word"], "<u8"), np.frombuffer(row["n"], "<i8"), _pair_counts(row["pc"], row["ph"])
                out = [(0, 0, int(n.sum())), (0, 1, len(n))]
                for kind, x in ((1, n), (2, c)):
                    r, times = np.unique(x[x <= FITTED], return_counts=True)
                    out += [(kind, int(a), int(b)) for a, b in zip(r, times)]
                at, found = _lookup(word, hot)
                out += [(3, int(w), int(n[i])) for w, i in zip(hot[found].view(np.int64), at[found])]
                yield pa.record_batch([pa.array(x, pa.int64()) for x in zip(*out)], ["kind", "key", "n"])
    return counts.select("word", "n", "ph", "pc").mapInArrow(work, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n")).collect()


def _freed(counts: DataFrame, model: Model) -> DataFrame:
    """Per history: mass its discounts free, and unigram mass of the words seen after it; hot histories in part -1."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                b = Bucket(batch.slice(i, 1).to_pylist()[0], model)
                h, spot = np.unique(b.ph, return_inverse=True)
                left = np.bincount(spot, weights=b.pc - model.pairs(b.pc), minlength=len(h))
                seen = np.bincount(spot, weights=b.unigram(b.count(b.pw)), minlength=len(h))
                part = np.where(np.isin(h, model.hot & _HIGH), -1, home(h, model.buckets))
                order = np.argsort(part, kind="stable")
                h, left, seen, part = h[order], left[order], seen[order], part[order]
                cuts = np.append(_runs(part), len(part))
                spans = list(zip(cuts[:-1], cuts[1:]))
                yield pa.record_batch({"part": pa.array([int(part[i]) for i, _ in spans], pa.int32()), "h": pa.array([_short(h[i:j]) for i, j in spans], pa.binary()),
                                       "left": pa.array([left[i:j].tobytes() for i, j in spans], pa.binary()), "seen": pa.array([seen[i:j].tobytes() for i, j in spans], pa.binary())})
    return counts.mapInArrow(work, "part int, h binary, left binary, seen binary")


def _weights(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Histories and the logarithm of back-off weight times history count."""
    h, spot = np.unique(_long(b"".join(table.column("h").to_pylist())), return_inverse=True)
    left, seen = (np.bincount(spot, weights=_all(table, c, "<f8"), minlength=len(h)) for c in ("left", "seen"))
    return h, np.log10(left / (1 - seen))


def _merged_weights(table: pa.Table) -> pa.Table:
    h, weight = _weights(table)
    return pa.table({"part": table.column("part").slice(0, 1), "h": pa.array([_short(h)], pa.binary()), "weight": pa.array([weight.tobytes()], pa.binary())})


def _discounted_sum(counts: DataFrame, words: Discount) -> float:
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"s": pa.array([float(words(np.frombuffer(n, "<i8")).sum()) for n in batch.column("n").to_pylist()], pa.float64())})
    return counts.select("n").mapInArrow(work, "s double").agg(F.coalesce(F.sum("s"), F.lit(0.0))).first()[0]


def fit(train: DataFrame, everything: DataFrame, buckets: int) -> tuple[Model, DataFrame, DataFrame]:
    """Count ``train`` (text); hot words are judged on ``everything``. Returns the model and its two written tables."""
    hot = _hot_words(everything, buckets)
    counts = staged(_count(train, hot, buckets), "counts")
    got = {(r.kind, r.key): r.n for r in _totals(counts, hot)}
    tokens, kinds = got.get((0, 0), 0), got.get((0, 1), 0)
    words, pairs = (good_turing({r: n for (kind, r), n in got.items() if kind == k}) for k in (1, 2))
    hot_counts = np.array([got.get((3, int(w)), 0) for w in hot.view(np.int64)], np.int64)
    unknown = 1 - _discounted_sum(counts, words) / tokens if tokens else 1.0
    texts = int(hot_counts[hot == END][0]) if (hot == END).any() else train.count()
    model = Model(buckets, tokens, kinds, texts, unknown, words, pairs, hot, hot_counts, np.zeros(len(hot)))
    few = _freed(counts, model).filter("part = -1").toArrow()  # hot histories only, a row for each bucket
    h, weight = _weights(few) if few.num_rows else (np.zeros(0, np.uint64), np.zeros(0))
    at, found = _lookup(h, hot & _HIGH)
    model = model._replace(hot_weights=np.where(found, weight[at] if len(weight) else 0.0, 0.0))
    weights = _freed(counts, model).filter("part >= 0").groupBy("part").applyInArrow(_merged_weights, "part int, h binary, weight binary")
    return model, counts, staged(weights, "weights")


_SENT = "bucket int, chunk long, ids binary, counts binary, word binary, at binary, h binary"
_BACK = "part int, chunk long, ids binary, counts binary, score binary, base binary, known binary, h binary, text binary"


def _questions(docs: DataFrame, model: Model) -> DataFrame:
    """Per chunk of texts and bucket the pairs to look up, in text order; one row per chunk holds ids and lengths."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk = TaskContext.get().partitionId() << 32
        # larger chunks name each word less often; Arrow hands over at most 10,000 rows by default, far from 65,536
        for batch in slices((b.slice(i, 1 << 16) for b in batches for i in range(0, b.num_rows, 1 << 16)), budget=2 * CHUNK_BYTES):
            t = Tokens(batch.column("text"))
            n, at = batch.num_rows, _place(t.token, join2(t.history, t.token), model.hot, model.buckets)
            order = np.argsort(at, kind="stable")
            cuts = _bounds(at[order], model.buckets)
            rows = [(chunk % model.buckets, chunk, pa.array(batch.column("row")).to_numpy().astype("<i8").tobytes(), t.counts.astype("<u4").tobytes(), None, None, None)]
            for b in np.flatnonzero(np.diff(cuts)):
                pick = order[cuts[b]:cuts[b + 1]]
                word, spot = np.unique(t.token[pick], return_inverse=True)
                rows.append((int(b), chunk, None, np.bincount(t.text[pick], minlength=n).astype("<u4").tobytes(), word.tobytes(),
                             spot.astype("<u2" if len(word) <= 1 << 16 else "<u4").tobytes(), _short(t.history[pick])))
            kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 5)
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["bucket", "chunk", "ids", "counts", "word", "at", "h"])
            chunk += 1
    return docs.select("row", "text").mapInArrow(work, _SENT)


def _answers(model: Model):
    def work(asked: pa.Table, table: pa.Table) -> pa.Table:
        out, unseen = [], []
        empty = {c: b"" for c in ("word", "n", "pw", "pn", "ph", "pc")}
        b = Bucket(table.to_pylist()[0] if table.num_rows else empty, model)
        key = join2(b.ph, b.pw)
        order = np.argsort(key)
        key, pc = key[order], b.pc[order]
        for i in range(asked.num_rows):
            row = asked.slice(i, 1).to_pylist()[0]
            if row["ids"] is not None:
                out.append((-1, row["chunk"], row["ids"], row["counts"], None, None, None, None, None))
                continue
            word, lengths = np.frombuffer(row["word"], "<u8"), np.frombuffer(row["counts"], "<u4")
            spot = np.frombuffer(row["at"], "<u2" if len(word) <= 1 << 16 else "<u4").astype(np.int64)
            h, text = _long(row["h"]), np.repeat(np.arange(len(lengths)), lengths)
            count = b.count(word)
            at, seen = _lookup(key, join2(h, word[spot]))
            value = np.log10(b.unigram(count))[spot]
            if seen.any():
                value[seen] = np.log10(model.pairs(pc[at[seen]]))
            # a word is the history of the next token: its count divides there, unless it was never seen
            value -= np.where((word != END) & (count > 0), np.log10(np.maximum(count, 1)), 0)[spot]
            place, hot = _lookup(model.hot & _HIGH, h)
            value += np.where(~seen & hot, model.hot_weights[place], 0)
            base = np.log10((count + 1) / (model.tokens + model.kinds + 1))[spot]
            sums = [np.bincount(text, weights=v, minlength=len(lengths)) for v in (value, base, (count > 0)[spot])]
            sums = [sums[0].tobytes(), sums[1].tobytes(), sums[2].astype("<u4").tobytes()]
            out.append((-1, row["chunk"], None, None, *sums, None, None))
            rest = np.flatnonzero(~seen & ~hot)
            unseen.append((h[rest], text[rest].astype("<u2"), np.full(len(rest), row["chunk"], "<i8")))
        # one row per part for all chunks: histories and texts, and the chunks with their numbers of these
        h, text, chunk = (np.concatenate(x) for x in zip(*unseen)) if unseen else (np.zeros(0, np.uint64),) * 3
        part = home(h, model.buckets)
        order = np.argsort(part, kind="stable")
        cuts = [*_runs(part[order]), len(part)]
        for x, y in zip(cuts[:-1], cuts[1:]):
            pick = order[x:y]
            runs = _runs(chunk[pick])
            out.append((int(part[pick[0]]), None, chunk[pick][runs].tobytes(), np.diff(np.append(runs, y - x)).astype("<u4").tobytes(),
                        None, None, None, _short(h[pick]), text[pick].tobytes()))
        kinds = (pa.int32(), pa.int64(), *[pa.binary()] * 7)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 9, kinds)],
                                    ["part", "chunk", "ids", "counts", "score", "base", "known", "h", "text"])
    return work


def _backed(asked: pa.Table, table: pa.Table) -> pa.Table:
    """Back-off weights of the unseen pairs, summed per chunk and text."""
    row = table.to_pylist()[0] if table.num_rows else {"h": b"", "weight": b""}
    key, weight = _long(row["h"]), np.frombuffer(row["weight"], "<f8")
    chunk = np.repeat(_all(asked, "ids", "<i8"), _all(asked, "counts", "<u4"))
    at, found = _lookup(key, _long(b"".join(asked.column("h").to_pylist())))
    chunk, text, value = chunk[found], _all(asked, "text", "<u2")[found], weight[at[found]]
    order = np.lexsort((text, chunk))
    chunk, text, value = chunk[order], text[order], value[order]
    # one sum per chunk and text
    first = np.flatnonzero(np.concatenate([[True], (chunk[1:] != chunk[:-1]) | (text[1:] != text[:-1])])) if len(chunk) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, first) if len(first) else value
    chunk, text = chunk[first], text[first]
    cuts = [*_runs(chunk), len(chunk)]
    out = [(int(chunk[x]), text[x:y].tobytes(), value[x:y].tobytes()) for x, y in zip(cuts[:-1], cuts[1:])]
    return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.binary(), pa.binary()))], ["chunk", "text", "score"])


def _summed(model: Model):
    def work(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        head = next(r for r in rows if r["ids"] is not None)
        ids, counts = np.frombuffer(head["ids"], "<i8"), np.frombuffer(head["counts"], "<u4").astype(np.int64)
        score, base, known = np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(ids), np.int64)
        for r in rows:
            if r["base"] is not None:
                score, base = (s + np.frombuffer(r[c], "<f8") for s, c in ((score, "score"), (base, "base")))
                known = known + np.frombuffer(r["known"], "<u4")
            elif r["text"] is not None:
                np.add.at(score, np.frombuffer(r["text"], "<u2"), np.frombuffer(r["score"], "<f8"))
        # the first token's history is the start, seen once per training text
        score = score - (np.log10(model.texts) if model.texts else 0)
        return pa.table({"row": pa.array(ids), "n_tokens": pa.array(counts), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(score)})
    return work


def score(docs: DataFrame, model: Model, counts: DataFrame, weights: DataFrame) -> DataFrame:
    """Per row of ``docs`` (row: an integer to carry along, text): n_tokens, n_known, base_score and score."""
    answers = staged(_questions(docs, model).groupBy("bucket").cogroup(counts.groupBy("bucket")).applyInArrow(_answers(model), _BACK), "answers")
    backed = (answers.filter("part >= 0").select("part", "ids", "counts", "h", "text").groupBy("part")
              .cogroup(weights.groupBy("part")).applyInArrow(_backed, "chunk long, text binary, score binary"))
    parts = answers.filter("part = -1").select("chunk", "ids", "counts", "score", "base", "known").unionByName(backed, allowMissingColumns=True)
    return parts.groupBy("chunk").applyInArrow(_summed(model), "row long, n_tokens long, n_known long, base_score double, score double")


def score_documents(docs: DataFrame, learn) -> DataFrame:
    """Learn from the rows of ``docs`` (doc_id, text) where the column ``learn`` holds, and score all."""
    spark = docs.sparkSession
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col("doc_id").cast("long").alias("row"), "doc_id", "text")
    model, counts, weights = fit(docs.filter(learn), docs, buckets)
    known = docs.filter("row is not null")
    scored = score(known, model, counts, weights)
    lone = docs.filter("row is null")
    if not lone.isEmpty():
        scored = scored.unionByName(score(lone.withColumn("row", F.lit(0).cast("long")), model, counts, weights).withColumn("row", F.lit(None).cast("long")))
    return scored.withColumnRenamed("row", "doc_id").withColumn("train_tokens", F.lit(model.tokens).cast("long"))
