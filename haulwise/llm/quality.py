"""Quality rules: a linear-chain conditional random field labels lines content or boilerplate.

Each text is a sequence of its lines that hold a word. ``fit`` trains the field on
labelled documents. The labels of their lines are latent: they start as their
document's, a first field without a chain tells what single lines look like, and each
round takes the likelier label of every line, as far as the document's share of content
still agrees with its label, and trains the chain on these. Viterbi decoding gives
the best label sequence of a text, and the share of its words that stand in content
lines decides whether it is retained. Three counts of the whole text come first:
texts of fewer than ``MIN_WORDS`` words, or with more than ``MAX_REPEAT`` per cent
of their words in repeated five-word windows, fail without asking the field.

Defined results: a null text counts as empty and fails; blank lines belong to no
sequence; repeated rows are judged one by one; without labelled rows (or with one
class only) the field accepts every line. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .text import LOWER, Words, join2, slices, span_hashes

MIN_WORDS = 10
MAX_REPEAT = 20
WINDOW = 5
MIN_CONTENT = 0.5
# The field is fitted on at most so many labelled documents, of at most so many lines each.
TRAIN_DOCS = 2000
TRAIN_LINES = 400
# Rounds of line labels, chain included.
ROUNDS = 3

SYMBOLS = b"#*$%&|<>"
N_FEATURES = 14
CONTENT, BOILER = 1, 0

MEASURES = ("n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
            "base_failed boolean, content_share double, kept boolean")


class Field(NamedTuple):
    """Weights of the chain: ``unary`` scores content against boilerplate, ``move[a, b]`` a step from a to b."""

    unary: np.ndarray
    move: np.ndarray


class Lines(NamedTuple):
    """Lines with a word: features, number of words, and ``first[d]:first[d+1]`` the lines of text d."""

    features: np.ndarray
    words: np.ndarray
    first: np.ndarray


def _flags(chars: bytes) -> np.ndarray:
    t = np.zeros(256, bool)
    t[list(chars)] = True
    return t


_IS_SYMBOL = _flags(SYMBOLS)
_IS_UPPER = _flags(bytes(range(65, 91)))
_IS_LETTER = _flags(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_IS_DIGIT = _flags(bytes(range(48, 58)))
_IS_MARK = _flags(b"!?=\"_/\\{}[]")
_IS_STOP = _flags(b".!?:;,")


def _line_spans(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """Byte spans of all ``\\n``-separated lines, in order."""
    breaks = np.flatnonzero(w.data == 10)
    start = np.sort(np.concatenate([w.offs[:-1], breaks + 1]))
    end = np.sort(np.concatenate([w.offs[1:], breaks]))
    return start, end


def _sums(flag: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Number of set bytes of each non-empty span."""
    at = np.empty(2 * len(start), np.int64)
    at[0::2], at[1::2] = start, end
    padded = np.append(flag, False)
    return np.add.reduceat(padded, at, dtype=np.int64)[0::2] if len(at) else np.zeros(0, np.int64)


def line_features(w: Words, hashes: np.ndarray) -> tuple[Lines, np.ndarray]:
    """Features of the lines with a word, and per text the number of lines equal to an earlier one."""
    start, end = _line_spans(w)
    a, b = np.searchsorted(w.start, start), np.searchsorted(w.start, end)
    solid = b > a
    start, end, a, b = start[solid], end[solid], a[solid], b[solid]
    first = np.searchsorted(start, w.offs)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n, size = (b - a).astype(float), (end - start).astype(float)
    key = join2(span_hashes(w.data, start, end), doc.astype(np.uint64))
    _, seen = np.unique(key, return_index=True)
    again = np.ones(len(start), bool)
    again[seen] = False
    # words of a line that stand in it already
    line = np.repeat(np.arange(len(start)), b - a)
    inside = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(start) and len(line) != len(w.start) \
        else np.arange(len(line))
    pair = join2(hashes[inside], line.astype(np.uint64))
    distinct = np.bincount(line[np.unique(pair, return_index=True)[1]], minlength=len(start)) if len(line) \
        else np.zeros(len(start))
    share = lambda table: _sums(table[w.data], start, end) / size
    letters, symbols, marks = share(_IS_LETTER), share(_IS_SYMBOL), share(_IS_MARK)
    upper = np.divide(_sums(_IS_UPPER[w.data], start, end), np.maximum(letters * size, 1))
    last = w.data[w.end[b - 1] - 1] if len(start) else np.zeros(0, np.uint8)
    repeat = np.where(n >= 4, 1 - distinct / n, 0)
    x = np.stack([
        np.ones(len(start)), symbols > 0.01, np.minimum(symbols * 5, 1), marks > 0.02, upper > 0.3,
        share(_IS_DIGIT) > 0.1, letters < 0.6, n <= 3, again, repeat > 0.35, repeat, _IS_STOP[last],
        (size / n) > 14, np.minimum(n / 60, 1)], axis=1).astype(np.float32) if len(start) \
        else np.zeros((0, N_FEATURES), np.float32)
    return Lines(x, n, first), np.bincount(doc[again], minlength=len(first) - 1)


def _by_step(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts ordered by falling number of lines, and how many have a line number t."""
    lengths = np.diff(first)
    order = np.argsort(-lengths, kind="stable")
    steps = lengths[order]
    top = int(steps[0]) if len(steps) else 0
    return order, np.searchsorted(-steps, -np.arange(top), "left")


def viterbi(field: Field, lines: Lines) -> np.ndarray:
    """Best label of every line; equal scores go to content."""
    out = np.empty(len(lines.words), np.int8)
    order, active = _by_step(lines.first)
    begin = lines.first[order]
    gain = lines.features @ field.unary
    back = np.empty((len(gain), 2), np.int8)
    score = np.zeros((len(order), 2))
    for t, m in enumerate(active):
        at = begin[:m] + t
        if t:
            ways = score[:m, :, None] + field.move[None]
            back[at] = choice = (ways[:, CONTENT] >= ways[:, BOILER]).astype(np.int8)
            score[:m] = np.take_along_axis(ways, choice[:, None, :].astype(np.int64), 1)[:, 0]
        score[:m, CONTENT] += gain[at]
    label = (score[:, CONTENT] >= score[:, BOILER]).astype(np.int8)
    for t in range(len(active) - 1, -1, -1):
        m = active[t]
        at = begin[:m] + t
        out[at] = label[:m]
        if t:
            label[:m] = back[at, label[:m]]
    return out


def _likelihood(field: Field, lines: Lines, truth: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Log-likelihood of the labels, its gradients and the lines' probability of content, by the forward-backward recursion."""
    order, active = _by_step(lines.first)
    begin = lines.first[order]
    gain = np.zeros((len(truth), 2))
    gain[:, CONTENT] = lines.features @ field.unary
    ahead, behind = np.zeros_like(gain), np.zeros_like(gain)
    for t, m in enumerate(active):
        at = begin[:m] + t
        ahead[at] = gain[at]
        if t:
            ahead[at] += np.logaddexp.reduce(ahead[at - 1][:, :, None] + field.move[None], axis=1)
    for t in range(len(active) - 2, -1, -1):
        at = begin[:active[t + 1]] + t
        behind[at] = np.logaddexp.reduce(field.move[None] + (gain[at + 1] + behind[at + 1])[:, None, :], axis=2)
    length = np.diff(lines.first)
    some = np.flatnonzero(length)
    z_doc = np.logaddexp.reduce(ahead[lines.first[some + 1] - 1], axis=1)
    z = np.repeat(z_doc, length[some])
    p = np.exp(ahead + behind - z[:, None])
    inner = np.ones(len(truth), bool)
    inner[lines.first[some]] = False
    nxt = np.flatnonzero(inner)
    edge = np.exp(ahead[nxt - 1][:, :, None] + field.move[None] + (gain[nxt] + behind[nxt])[:, None, :] - z[nxt][:, None, None])
    seen = np.zeros((2, 2))
    np.add.at(seen, (truth[nxt - 1], truth[nxt]), 1)
    value = gain[np.arange(len(truth)), truth].sum() + (seen * field.move).sum() - z_doc.sum()
    return value, lines.features.T @ ((truth == CONTENT) - p[:, CONTENT]), seen - edge.sum(axis=0), p[:, CONTENT]


def fit_field(lines: Lines, truth: np.ndarray, begin: Field | None = None, rounds: int = 150, rate: float = 0.15, ridge: float = 3e-4) -> Field:
    """Maximum likelihood with a ridge penalty, by adaptive-moment gradient steps from ``begin`` (or zero)."""
    theta = np.concatenate([begin.unary, begin.move.ravel()]) if begin else np.zeros(N_FEATURES + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):
        field = Field(theta[:N_FEATURES], theta[N_FEATURES:].reshape(2, 2))
        _, du, dm, _ = _likelihood(field, lines, truth)
        g = np.concatenate([du, dm.ravel()]) / len(truth) - ridge * theta
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9 ** k)) / (np.sqrt(v / (1 - 0.99 ** k)) + 1e-8)
    return Field(theta[:N_FEATURES].copy(), theta[N_FEATURES:].reshape(2, 2).copy())


def agreeing(content: np.ndarray, lines: Lines, good: np.ndarray) -> np.ndarray:
    """Likelier label of every line; where a text's share of content contradicts its label, its least certain lines change."""
    label = (content >= 0.5).astype(np.int8)
    for d in range(len(good)):
        at = np.arange(lines.first[d], lines.first[d + 1])
        words = lines.words[at]
        order = at[np.argsort(-content[at] if good[d] else content[at], kind="stable")]
        while len(at) and ((words @ label[at]) >= MIN_CONTENT * words.sum()) != good[d]:
            label[order[label[order] != good[d]][0]] = good[d]
    return label


def learn_lines(lines: Lines, good: np.ndarray) -> tuple[Field, np.ndarray]:
    """The field and the line labels that labelled texts (``good``: 0 or 1 per text) give."""
    label = np.repeat(good, np.diff(lines.first)).astype(np.int8)
    alone = lines._replace(first=np.arange(len(label) + 1))
    field = fit_field(alone, label)
    seen = alone
    for _ in range(ROUNDS):
        label = agreeing(_likelihood(field, seen, label)[3], lines, good)
        field, seen = fit_field(lines, label, field, 80), lines
    return field, label


def _features_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        w = Words(batch.column("text"), lower=True)
        lines, _ = line_features(w, w.hashes())
        rows = [(i, lines.first[i], lines.first[i + 1]) for i in range(batch.num_rows)]
        keep = [r for r in rows if 0 < r[2] - r[1] <= TRAIN_LINES]
        yield pa.record_batch({
            "x": pa.array([lines.features[a:b].tobytes() for _, a, b in keep], pa.binary()),
            "n": pa.array([lines.words[a:b].astype("<f8").tobytes() for _, a, b in keep], pa.binary()),
            "quality": batch.column("quality").take(pa.array([i for i, _, _ in keep], pa.int64())).cast(pa.int32())})


def fit(docs: DataFrame, labels: DataFrame) -> Field | None:
    """Train on ``labels`` (doc_id, quality 0/1); at most ``TRAIN_DOCS`` rows, chosen by a hash of doc_id."""
    known = labels.filter("quality in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    rows = (docs.filter("text is not null").select("doc_id", "text").join(F.broadcast(known), "doc_id")
            .mapInArrow(_features_out, "x binary, n binary, quality int").collect())
    if len({r.quality for r in rows}) < 2:
        return None
    blocks = [np.frombuffer(r.x, np.float32).reshape(-1, N_FEATURES) for r in rows]
    sizes = np.array([len(b) for b in blocks])
    words = np.concatenate([np.frombuffer(r.n, "<f8") for r in rows])
    lines = Lines(np.concatenate(blocks), words, np.concatenate([[0], np.cumsum(sizes)]))
    return learn_lines(lines, np.array([r.quality for r in rows], np.int8))[0]


def _repeat_words(w: Words, hashes: np.ndarray) -> np.ndarray:
    """Per text, the words inside windows of ``WINDOW`` words that the text holds twice or more."""
    n = len(w.first) - 1
    doc = np.repeat(np.arange(n), w.counts)
    at = np.flatnonzero(np.arange(len(doc)) + WINDOW <= w.first[1:][doc])
    if not len(at):
        return np.zeros(n, np.int64)
    key = doc[at].astype(np.uint64)
    for k in range(WINDOW):
        key = join2(key, hashes[at + k])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    step = np.zeros(len(doc) + 1, np.int64)
    np.add.at(step, at[twice], 1)
    np.add.at(step, at[twice] + WINDOW, -1)
    return np.bincount(doc[np.cumsum(step)[:-1] > 0], minlength=n)


def measure(texts: pa.Array, field: Field | None) -> dict[str, np.ndarray]:
    """The columns of ``MEASURES`` for some whole texts."""
    w = Words(texts)
    hashes = w.hashes()
    lines, dup = line_features(w, span_hashes(w.data, w.start, w.end, LOWER))
    n = w.counts.astype(np.int64)
    runs = list(zip(w.offs[:-1], w.offs[1:]))
    heads = ((w.data & 0xC0) != 0x80) & (w.data != 32) & ((w.data < 9) | (w.data > 13))
    symbols = _IS_SYMBOL[w.data]
    repeated = _repeat_words(w, hashes)
    failed = (n < MIN_WORDS) | (100 * repeated > MAX_REPEAT * n)
    good = viterbi(field, lines) == CONTENT if field is not None else np.ones(len(lines.words), bool)
    doc = np.repeat(np.arange(len(n)), np.diff(lines.first))
    share = np.bincount(doc, weights=lines.words * good, minlength=len(n)) / np.maximum(n, 1)
    return {"n_words": n, "word_chars": np.array([np.count_nonzero(heads[a:b]) for a, b in runs], np.int64),
            "n_symbols": np.array([np.count_nonzero(symbols[a:b]) for a, b in runs], np.int64),
            "n_dup_lines": dup.astype(np.int64), "n_repeat_words": repeated.astype(np.int64), "base_failed": failed,
            "content_share": share, "kept": ~failed & (share >= MIN_CONTENT)}


def judge(docs: DataFrame, field: Field | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id and the measures."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            got = measure(batch.column("text"), field)
            yield pa.record_batch([batch.column("doc_id"), *map(pa.array, got.values())], ["doc_id", *got])
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, {MEASURES}")


def retain(docs: DataFrame, field: Field | None) -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield batch.filter(pa.array(measure(batch.column("text"), field)["kept"]))
    return docs.mapInArrow(work, docs.schema)
