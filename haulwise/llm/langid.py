"""Language identification by interpolated Kneser-Ney character models.

Texts become lower-case letters with single blanks between runs of letters. ``fit``
counts all character 4-grams per language and derives from them, in Spark, the
discounted probabilities and back-off weights of every order (lower orders use
continuation counts). The logarithm of an interpolated probability is a sum over the n-grams that end at a
symbol: what an n-gram adds to its lower order, and its weight as a history. So the model is one table of
(language, n-gram, weight), and the cross-entropy of a text a sum over the weights of all its n-grams.

The table is kept as it is, however large: it is dealt into pieces of at most ``GROUP`` languages and about
``PIECE_ROWS`` rows by the n-gram's 64-bit key. A task holds one piece at a time, as sorted keys
with a row of weights each. A model of one piece is applied in one pass over the texts; one of several takes a pass for each,
and the sums of a text are added up by a hash of the text.

A text gets the language of lowest cross-entropy per symbol. A softmax turns that into a score; its temperature, and
how far above a language's own texts a text may lie before it is rejected, come from all labelled texts: each is scored
by a model of the other half of the texts (dealt by a hash of the text). The model that is kept counts both halves.
The limit is a multiple of the median distance, so that texts of another language among the labelled ones do not widen it. A model
that holds a text has learned its n-grams and finds it likely whatever it is, so ``accept`` judges every text by the half without it.

Defined results: null text, or text without a letter, is ``und`` with score 0 and
rejected; ties go to the language that sorts first; nothing learned means ``und`` for
all. Repeated rows count as often as they occur, but once in the calibration. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F
from pyspark.sql.types import StructType

from .store import staged
from .text import slices

ORDER = 4
# Languages and rows of one piece of the model.
GROUP = 16
PIECE_ROWS = 2_000_000
# Distinct labelled texts that a calibration needs; with 0 there is none.
CALIBRATION_ROWS = 1
# Temperatures that are tried, digits of an entropy whose median is taken, texts that give a language limits of its own.
GRID = [2.0 ** k for k in np.arange(-2, 9, 0.5)]
DIGITS = 3
OWN_LIMITS = 20
# Bytes of text whose symbols a task holds at a time (or one longer text).
HELD_BYTES = 1 << 17
# A text is rejected when it lies further above its language's median than this many spreads: median distances as of a normal spread.
FAR = 20.0
NORMAL = 1.4826
SHORT = 150.0
# A task merges its counts before they outgrow this many n-grams, then hands them on.
HELD_GRAMS = 500_000
UNKNOWN = "und"
_U = np.uint64
_BLANK = 32
# Bits of a code point, and of two.
_POINT, _PAIR = 21, 42
# Random odd factors of a key, one for each place of an n-gram, and a term for each order.
_FACTORS = np.random.default_rng(20240301).integers(1 << 62, 1 << 63, 2 * ORDER, dtype=np.uint64) * _U(2) + _U(1)

_letters: list[np.ndarray] = []


def _is_letter(points: np.ndarray) -> np.ndarray:
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0][points]


def symbols(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Letters and single blanks of all texts, and where each text begins; every text starts with a blank."""
    low = [" " + t.lower() + " " if t else " " for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    begin = np.concatenate([[0], np.cumsum([len(t) for t in low])]).astype(np.int64)
    letter = _is_letter(points)
    use = letter.copy()
    use[1:] |= letter[:-1]
    use[begin[:-1]] = True
    kept = np.concatenate([[0], np.cumsum(use)])
    # the blank that opens a text stands directly before its first letter
    return np.where(letter, points, _BLANK)[use].astype(_U), kept[begin]


def grams(x: np.ndarray, begin: np.ndarray) -> list[np.ndarray]:
    """The symbols of the 4-gram that ends at every symbol, last one first; in front of a text they are 0."""
    inside = np.arange(len(x)) - np.repeat(begin[:-1], np.diff(begin))
    places = [x]
    for back in range(1, ORDER):
        places.append(np.where(inside < back, _U(0), np.roll(x, back)))
    return places


def keys(places: list[np.ndarray]) -> list[np.ndarray]:
    """64-bit keys of the n-grams of every order."""
    total, out = np.zeros(len(places[0]), _U), []
    for n, symbol in enumerate(places):
        total = total + symbol * _FACTORS[n]
        out.append(total + _FACTORS[ORDER + n])
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """4-grams of a task by language: two symbols each in ``hi`` and ``lo``, their number, and that without the half that is ``aside``."""
    held: dict[str, list[tuple]] = {}
    names = ("hi", "lo", "c", "kept")

    def merged(parts: list[tuple]) -> tuple:
        hi, lo, c, kept = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((lo, hi))
        hi, lo = hi[order], lo[order]
        heads = np.flatnonzero(np.concatenate([[True], (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])]))
        return hi[heads], lo[heads], np.add.reduceat(c[order], heads), np.add.reduceat(kept[order], heads)

    def out() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            columns = merged(parts)
            yield pa.record_batch({"lang": pa.array([lang] * len(columns[0]), pa.string()), **{n: pa.array(v.astype(np.int64)) for n, v in zip(names, columns)}})
        held.clear()

    size = 0
    for batch in slices(batches, budget=HELD_BYTES):
        texts = batch.column("text").to_pylist()
        groups: dict[tuple, list] = {}
        for t, *group in zip(texts, batch.column("lang").to_pylist(), batch.column("aside").to_pylist()):
            groups.setdefault(tuple(group), []).append(t)
        for (lang, aside), some in groups.items():
            x, begin = symbols(some)
            # the blank that opens a text is a history only
            scored = np.ones(len(x), bool)
            scored[begin[:-1]] = False
            places = [p[scored] for p in grams(x, begin)]
            if len(places[0]):
                key = keys(places)[-1]
                order = np.argsort(key)
                key = key[order]
                heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                c = np.diff(np.append(heads, len(key)))
                a, b, c3, d = (p[order[heads]] for p in places)
                held.setdefault(lang, []).append((d << _U(_POINT) | c3, b << _U(_POINT) | a, c, np.zeros_like(c) if aside else c))
                size += len(c)
        if size > HELD_GRAMS:
            for lang in held:
                held[lang] = [merged(held[lang])]
            size = sum(len(v[0][0]) for v in held.values())
            if size > HELD_GRAMS // 2:
                yield from out()
                size = 0
    yield from out()


def _lower(level: int) -> list[Column]:
    """The n-gram of ``level`` symbols that ends like (hi, lo)."""
    return [F.col(c).bitwiseAND(F.lit((1 << _POINT * n) - 1)).alias(c) for c, n in (("hi", max(0, level - 2)), ("lo", min(2, level)))]


def _history() -> list[Column]:
    """(hi, lo) without its last symbol."""
    carried = F.shiftleft(F.col("hi").bitwiseAND(F.lit((1 << _POINT) - 1)), _POINT)
    return [F.shiftright("hi", _POINT).alias("h_hi"), F.shiftright("lo", _POINT).bitwiseOR(carried).alias("h_lo")]


def _weights(counts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``counts`` (lang, hi, lo, c) of 4-grams as weights (lang, level, hi, lo, own, w) of all n-grams, to be added up, and the floor of every language.

    A symbol never seen has the probability ``2 ** floor``; ``own`` is what an n-gram adds to the logarithm
    of its lower order (the floor for single symbols), ``w`` that plus the logarithm of its back-off weight as a history.
    """
    tables = {ORDER: counts}
    for level in range(ORDER - 1, 0, -1):
        tables[level] = staged(tables[level + 1].select("lang", *_lower(level)).groupBy("lang", "hi", "lo").agg(F.count("*").alias("c")), "orders")
    letters = tables[1].agg(F.count_distinct("lo")).first()[0]
    parts, below = [], None
    for level in range(1, ORDER + 1):
        table = tables[level]
        of = table.groupBy("lang").agg(F.count_if(F.col("c") == 1).alias("n1"), F.count_if(F.col("c") == 2).alias("n2"))
        of = of.select("lang", ((F.col("n1") + 0.5) / (F.col("n1") + 2 * F.col("n2") + 1)).alias("d"))
        named = table.select("*", *(_history() if level > 1 else (F.lit(0).cast("long").alias(c) for c in ("h_hi", "h_lo"))))
        # a history is followed by no more than all symbols there are
        same = W.partitionBy("lang", "h_hi", "h_lo")
        named = named.select("*", F.sum("c").over(same).alias("total"), F.count("*").over(same).alias("kinds"), F.row_number().over(same.orderBy("lo")).alias("turn"))
        named = named.join(of, "lang").withColumn("g", F.col("d") * F.col("kinds") / F.col("total"))
        p = F.greatest(F.col("c") - F.col("d"), F.lit(0.0)) / F.col("total")
        if level == 1:
            named = named.withColumn("base", F.lit(1 / (letters + 1)))
        else:
            lower = below.select(F.col("lang").alias("l_lang"), F.col("hi").alias("l_hi"), F.col("lo").alias("l_lo"), F.col("full").alias("base"))
            ending = _lower(level - 1)
            named = named.join(lower, (F.col("lang") == F.col("l_lang")) & (ending[0] == F.col("l_hi")) & (ending[1] == F.col("l_lo")))
        backed = F.col("g") * F.col("base")
        below = staged(named.select("lang", "hi", "lo", "h_hi", "h_lo", "turn", "g", (p + backed).alias("full"), F.log2((p + backed) / backed).alias("own"),
                                    F.log2(backed).alias("floor")), "orders")
        parts.append(below.select("lang", F.lit(level).alias("level"), "hi", "lo", "own", F.col("own").alias("w")))
        if level == 1:
            floor = below.filter("turn = 1").select("lang", "floor")
        else:
            parts.append(below.filter("turn = 1").select("lang", F.lit(level - 1).alias("level"), F.col("h_hi").alias("hi"), F.col("h_lo").alias("lo"),
                                                         F.lit(0.0).alias("own"), F.log2("g").alias("w")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, floor


def _keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        hi, lo, level = (b.column(c).to_numpy().astype(_U) for c in ("hi", "lo", "level"))
        one = _U((1 << _POINT) - 1)
        key = np.stack(keys([lo & one, lo >> _U(_POINT), hi & one, hi >> _U(_POINT)]))[level.astype(np.int64) - 1, np.arange(len(lo))]
        yield pa.record_batch([pa.array(key.view(np.int64)), *(b.column(c) for c in ("lang", "own", "w"))], ["key", "lang", "own", "w"])


class Piece:
    """Some n-grams under some languages: sorted keys, a row of weights each, and a last row of zeros for the others."""

    def __init__(self, rows: pa.Table, first: int, languages: int) -> None:
        key, number = rows.column("key").to_numpy().view(_U), rows.column("lang").to_numpy() - first
        self.first = first
        self.keys, at = np.unique(key, return_inverse=True)
        self.weights, self.own = np.zeros((2, len(self.keys) + 1, languages))
        for held, column in ((self.weights, "w"), (self.own, "own")):
            np.add.at(held, (at, number), rows.column(column).to_numpy())
        # where the keys with the same leading bits begin
        self.shift = _U(64 - (len(self.keys).bit_length() + 2))
        self.starts = np.searchsorted(self.keys >> self.shift, np.arange((1 << int(64 - self.shift)) + 1, dtype=_U))
        self.keys = np.append(self.keys, _U(0))

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Row of every wanted key; the last row for those that are not there."""
        lead = (wanted >> self.shift).view(np.int64)
        at, end = self.starts.take(lead), self.starts.take(lead + 1)
        out = np.where((self.keys.take(at) == wanted) & (at < end), at, len(self.keys) - 1)
        todo = np.flatnonzero((end - at > 1) & (out != at))
        while len(todo):
            at[todo] += 1
            same = self.keys[at[todo]] == wanted[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same & (at[todo] + 1 < end[todo])]
        return out

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Summed weights of every text under the languages of the piece, and the number of symbols scored."""
        x, begin = symbols(texts)
        value, ends = np.zeros((len(x), self.weights.shape[1])), np.zeros((len(texts), self.weights.shape[1]))
        for key in keys(grams(x, begin)):
            at = self.find(key)
            value += self.weights.take(at, axis=0)
            # the blank in front only backs off, and nothing follows the last symbol
            first, last = at[begin[:-1]], at[begin[1:] - 1]
            ends += self.own[first] + self.weights[last] - self.own[last]
        total = np.add.reduceat(value, begin[:-1], axis=0) if len(texts) else value
        return total - ends, np.diff(begin) - 1


class Model(NamedTuple):
    """Languages, the written table (key, lang, own, w), how it is dealt out, and what turns entropies into decisions."""

    languages: list[str]
    table: DataFrame
    pieces: list[tuple[int, int, int]]  # group of languages, parts it is dealt to by key, part
    floor: np.ndarray
    temperature: float
    mean: np.ndarray
    spread: np.ndarray
    limit: np.ndarray
    halves: tuple[Model, Model] | None = None  # of the texts that ``_half`` does not hold for, and of the others

    @property
    def rule(self) -> Rule:
        return Rule(self.languages, self.floor, self.temperature, self.mean, self.spread, self.limit)


class Rule(NamedTuple):
    languages: list[str]
    floor: np.ndarray
    temperature: float
    mean: np.ndarray
    spread: np.ndarray
    limit: np.ndarray

    def entropy(self, sums: np.ndarray, length: np.ndarray) -> np.ndarray:
        return -(self.floor + sums / np.maximum(length, 1)[:, None])

    def decide(self, sums: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        n = len(length)
        if not self.languages or not n:
            return {"lang_pred": np.full(n, UNKNOWN, object), "score": np.zeros(n), "entropy": np.zeros(n), "rejected": np.ones(n, bool)}
        e = self.entropy(sums, length)
        best = e.argmin(axis=1)
        low = e[np.arange(n), best]
        some = length > 0
        far = (low - self.mean[best]) / (self.spread[best] * np.sqrt(1 + SHORT / np.maximum(length, 1)))
        return {"lang_pred": np.where(some, np.array(self.languages, object)[best], UNKNOWN),
                "score": np.where(some, _softmax(e, self.temperature)[np.arange(n), best], 0.0), "entropy": np.where(some, low, 0.0),
                "rejected": ~some | (far > self.limit[best])}


def _softmax(entropy: np.ndarray, temperature: float) -> np.ndarray:
    z = -entropy * temperature
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _model(counts: DataFrame) -> Model:
    """The model of ``counts`` (lang, hi, lo, c), not yet calibrated."""
    weights, floors = _weights(counts)
    floor = {r.lang: r.floor for r in floors.collect()}
    languages = sorted(floor)
    none = np.zeros(len(languages))
    spark = counts.sparkSession
    numbers = spark.createDataFrame(list(zip(languages, range(len(languages)))), "name string, number int")
    rows = weights.join(numbers, F.col("lang") == F.col("name")).select("level", "hi", "lo", F.col("number").alias("lang"), "own", "w")
    rows = staged(rows.mapInArrow(_keyed, "key long, lang int, own double, w double"), "model-rows")
    sizes = {r.g: r.n for r in rows.groupBy(_group().alias("g")).agg(F.count("*").alias("n")).collect()}
    pieces = [(g, -(-sizes[g] // PIECE_ROWS), i) for g in sorted(sizes) for i in range(-(-sizes[g] // PIECE_ROWS))]
    return Model(languages, rows, pieces, np.array([floor[x] for x in languages]), 1.0, none, none + 1, none + np.inf)


def _half() -> Column:
    """To which half of all texts a text belongs."""
    return F.xxhash64("text") < 0


def _group() -> Column:
    return F.floor(F.col("lang") / GROUP).cast("int")


def load(model: Model, piece: tuple[int, int, int]) -> Piece:
    """One piece of the model's table."""
    group, parts, number = piece
    rows = model.table.filter((_group() == group) & (F.pmod(F.xxhash64("key"), F.lit(parts)) == number)).toArrow()
    return Piece(rows, group * GROUP, min(GROUP, len(model.languages) - group * GROUP))


def _summed(texts: DataFrame, model: Model, per_batch, schema: str, piece: tuple[int, int, int]) -> DataFrame:
    """``per_batch(batch, sums, length)`` of the rows of ``texts`` for one piece, which is sent to all tasks."""
    shared = texts.sparkSession.sparkContext.broadcast(load(model, piece))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, budget=HELD_BYTES):
            yield per_batch(batch, *shared.value.sums(batch.column("text").to_pylist()))
    return texts.mapInArrow(work, schema)


def _in_pieces(texts: DataFrame, model: Model) -> DataFrame:
    """Per distinct ``h`` of ``texts`` (h, text): n and the sums under all languages, gathered over the pieces of the model."""
    names = [f"s{i}" for i in range(GROUP)]

    def part(batch: pa.RecordBatch, sums: np.ndarray, length: np.ndarray, first: int) -> pa.RecordBatch:
        wide = np.zeros((len(length), GROUP))
        wide[:, :sums.shape[1]] = sums
        return pa.record_batch([batch.column("h"), pa.array(length), pa.array(np.full(len(length), first, np.int32)), *map(pa.array, wide.T)], ["h", "n", "first", *names])
    every = None
    texts = texts.dropDuplicates(["h"])
    for piece in model.pieces:
        got = staged(_summed(texts, model, lambda b, s, n, first=piece[0]: part(b, s, n, first), "h long, n long, first int, " + ", ".join(f"{c} double" for c in names), piece), "sums")
        every = got if every is None else every.unionByName(got)
    summed = every.groupBy("h", "first").agg(F.max("n").alias("n"), F.array(*[F.sum(c) for c in names]).alias("s"))
    flat = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("first", "s"))), lambda x: x["s"]))
    return summed.groupBy("h").agg(F.max("n").alias("n"), F.slice(flat, 1, len(model.languages)).alias("s"))


ANSWER = {"lang_pred": "string", "score": "double", "entropy": "double", "rejected": "boolean"}


def _answer(docs: DataFrame) -> list[str]:
    """Names of the answer's columns that no column of ``docs`` has."""
    mark = "_"
    while any(c.startswith(mark) for c in docs.columns):
        mark += "_"
    return [mark + c for c in ANSWER]


def decisions(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` (text, any other columns) with lang_pred, score, entropy and rejected behind them, named by ``_answer``."""
    names = _answer(docs)
    if model is None:
        return docs.select("*", *[F.lit(v).alias(c) for c, v in zip(names, (UNKNOWN, 0.0, 0.0, True))])
    rule = model.rule
    schema = StructType(docs.schema.fields.copy())
    for c, kind in zip(names, ANSWER.values()):
        schema = schema.add(c, kind)

    def decided(batch: pa.RecordBatch, sums: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        got = rule.decide(sums, length)
        columns = [pa.array(got["lang_pred"], pa.string()), *(pa.array(got[c]) for c in ("score", "entropy", "rejected"))]
        return pa.record_batch([*batch.columns, *columns], [*batch.schema.names, *names])
    if len(model.pieces) == 1:
        return _summed(docs, model, decided, schema, model.pieces[0])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield decided(b.select(["h"]), np.array(b.column("s").to_pylist(), float).reshape(b.num_rows, -1), b.column("n").to_numpy())
    h = F.xxhash64("text")
    sums = _in_pieces(docs.select(h.alias("h"), "text"), model)
    found = sums.mapInArrow(later, "h long, " + ", ".join(f"{c} {kind}" for c, kind in zip(names, ANSWER.values())))
    return docs.join(found, F.xxhash64(docs["text"]) == found["h"], "left").select(docs["*"], *[found[c] for c in names])


def fit(docs: DataFrame) -> Model | None:
    """Learn from all rows of ``docs`` (text, lang) that have both; any rows that must not count are left out before."""
    rows = docs.filter("text is not null and lang is not null").select("text", "lang", F.xxhash64("text").alias("h"))
    half = _half()
    counts = rows.withColumn("aside", half).mapInArrow(_count, "lang string, hi long, lo long, c long, kept long")
    counts = staged(counts.groupBy("lang", "hi", "lo").agg(F.sum("c").alias("c"), F.sum("kept").alias("kept")), "grams")
    if counts.isEmpty():
        return None
    model = _model(counts.select("lang", "hi", "lo", "c"))
    if not CALIBRATION_ROWS:
        return model
    judged, halves = None, []
    for texts, learned in ((rows.filter(half), F.col("kept")), (rows.filter(~half), F.col("c") - F.col("kept"))):
        part = counts.select("lang", "hi", "lo", "c", learned.alias("learned"))
        # a language with texts in one half only learns from these
        per = part.groupBy("lang").agg((F.sum("learned") > 0).alias("enough"))
        part = part.join(per, "lang").select("lang", "hi", "lo", F.when(F.col("enough"), F.col("learned")).otherwise(F.col("c")).alias("c")).filter("c > 0")
        halves.append(_model(staged(part, "grams")))
        got = staged(_judged(texts, halves[-1]).filter("n > 0").dropDuplicates(["h", "lang"]), "judged")
        judged = got if judged is None else judged.unionByName(got)
    model = _calibrated(model, judged)
    return model._replace(halves=tuple(_same_rule(model, h) for h in halves))


def _same_rule(model: Model, half: Model) -> Model:
    """``half`` with the temperature and limits of ``model``."""
    at = [model.languages.index(v) for v in half.languages]
    return half._replace(temperature=model.temperature, mean=model.mean[at], spread=model.spread[at], limit=model.limit[at])


JUDGED = "h long, lang string, n long, own double, loss array<double>"


def _judged(texts: DataFrame, model: Model) -> DataFrame:
    """Per row of ``texts`` (h, lang, text): h, lang, n, the entropy under its language and the loss at every temperature of ``GRID``."""
    rule, number = model.rule, {v: i for i, v in enumerate(model.languages)}

    def judged(batch: pa.RecordBatch, sums: np.ndarray, length: np.ndarray) -> pa.RecordBatch:
        e, at = rule.entropy(sums, length), np.arange(len(length))
        # a language without a letter is none; such texts have no length
        truth = np.array([number.get(v, 0) for v in batch.column("lang").to_pylist()], int)
        loss = np.array([-np.log(np.maximum(_softmax(e, t)[at, truth], 1e-9)) for t in GRID]).T
        return pa.record_batch([batch.column("h"), batch.column("lang"), pa.array(length, pa.int64()), pa.array(e[at, truth]), pa.array(list(loss), pa.list_(pa.float64()))],
                               ["h", "lang", "n", "own", "loss"])
    if len(model.pieces) == 1:
        return _summed(texts, model, judged, JUDGED, model.pieces[0])

    def later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield judged(b, np.array(b.column("s").to_pylist(), float).reshape(b.num_rows, -1), b.column("n").to_numpy())
    sums = _in_pieces(texts.select("h", "text"), model)
    return texts.select("h", "lang").distinct().join(sums, "h").select("h", "lang", "n", "s").mapInArrow(later, JUDGED)


def _median(values: list[tuple[float, int]]) -> float:
    """Median of (value, count)."""
    value, count = (np.array(x) for x in zip(*sorted(values)))
    upto = np.cumsum(count)
    return float(value[np.searchsorted(upto, upto[-1] / 2)])


def _calibrated(model: Model, judged: DataFrame) -> Model:
    """``model`` with the temperature and limits of all texts of ``judged``, in sums, extremes and counts of rounded entropies."""
    loss = judged.agg(F.count("*").alias("n"), *[F.avg(F.col("loss")[i]).alias(f"t{i}") for i in range(len(GRID))]).first()
    if loss.n < CALIBRATION_ROWS:
        return model
    # entropies of three digits: no more rows than there are such values of a language
    held: dict[str, list[tuple[float, int]]] = {}
    for r in judged.groupBy("lang", F.round("own", DIGITS).alias("value")).agg(F.count("*").alias("n")).collect():
        held.setdefault(r.lang, []).append((r.value, r.n))
    every = [x for some in held.values() for x in some]
    few = [sum(n for _, n in held.get(v, ())) <= OWN_LIMITS for v in model.languages]
    middle = _median(every)
    mean = np.array([middle if f else _median(held[v]) for v, f in zip(model.languages, few)])
    own = judged.sparkSession.createDataFrame([(v, float(m)) for v, m, f in zip(model.languages, mean, few) if not f], "of string, mean double")
    width = F.sqrt(1 + SHORT / F.col("n"))
    judged = judged.join(own, F.col("lang") == F.col("of"), "left")
    away = {}
    for name, frame, centre in (("lang", judged.filter("of is not null"), F.col("mean")), (None, judged, F.lit(middle))):
        z = F.round(F.abs(F.col("own") - centre) / width, DIGITS).alias("z")
        for r in frame.groupBy((F.col(name) if name else F.lit(None).cast("string")).alias("key"), z).agg(F.count("*").alias("n")).collect():
            away.setdefault(r.key, []).append((r.z, r.n))
    spread = np.array([max(NORMAL * _median(away[None if f else v]), 0.02) for v, f in zip(model.languages, few)])
    return model._replace(temperature=GRID[int(np.argmin(loss[1:]))], mean=mean, spread=spread, limit=np.full(len(mean), FAR))


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, lang_pred, score, entropy, rejected."""
    docs = docs.select("doc_id", "text")
    return decisions(docs, model).select("doc_id", *[F.col(c).alias(n) for c, n in zip(_answer(docs), ANSWER)])


def accept(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` that are not rejected, with all their columns; a text the model may hold is judged by the half without it."""
    def kept(some: DataFrame, judge: Model | None) -> DataFrame:
        return decisions(some, judge).filter(~F.col(_answer(docs)[-1])).select(*[F.col(f"`{c}`") for c in docs.columns])
    if model is None or model.halves is None:
        return kept(docs, model)
    return kept(docs.filter(_half()), model.halves[0]).unionByName(kept(docs.filter(~_half()), model.halves[1]))
