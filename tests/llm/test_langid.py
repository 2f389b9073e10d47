"""Kneser-Ney character models against brute force, many languages, pieces, foreign text and odd rows."""

import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from haulwise.llm import catalog, langid

TEXTS = [("aa", "abab cab"), ("aa", "Abba, cab!"), ("aa", "abab cab"), ("bb", "xyx yxz"), ("bb", "zzx 12 y"), ("bb", "ab xy"), ("cc", "\U00010430\U00010431 а б"), ("cc", "аб"),
         ("dd", ""), ("ee", None), (None, "abc")]


def letters(text):
    out = " "
    for c in text.lower() + " ":
        c = c if c.isalpha() else " "
        if not (c == " " and out[-1] == " "):
            out += c
    return out


def grams(text):
    """4-grams ending at every symbol after the opening blank; beyond it the symbol is 0."""
    x = "\0\0\0" + letters(text)
    return [x[i - 3:i + 1] for i in range(4, len(x))]


class Brute:
    """Interpolated Kneser-Ney of one language, by recursion over strings."""

    def __init__(self, texts, alphabet):
        self.alphabet = alphabet
        self.c = {4: Counter(g for t in texts for g in grams(t))}
        for n in (3, 2, 1):
            self.c[n] = Counter(g[1:] for g in self.c[n + 1])
        self.d, self.total, self.kinds = {}, {}, {}
        for n, c in self.c.items():
            n1, n2 = (sum(v == k for v in c.values()) for k in (1, 2))
            self.d[n] = (n1 + 0.5) / (n1 + 2 * n2 + 1)
            self.total[n], self.kinds[n] = defaultdict(int), defaultdict(int)
            for g, v in c.items():
                self.total[n][g[:-1]] += v
                self.kinds[n][g[:-1]] += 1

    def p(self, gram):
        n = len(gram)
        if n == 0:
            return 1 / self.alphabet
        h = gram[:-1]
        if h not in self.total[n]:
            return self.p(gram[1:])
        c, d, t = self.c[n][gram], self.d[n], self.total[n][h]
        return max(c - d, 0) / t + d * self.kinds[n][h] / t * self.p(gram[1:])

    def entropy(self, text):
        g = grams(text)
        return -sum(math.log2(self.p(x)) for x in g) / len(g)


def learned(spark, rows, monkeypatch=None):
    return langid.fit(spark.createDataFrame(rows, "lang string, text string"))


def raw(spark, model, texts):
    """Entropies under all languages from the pieces of the model."""
    length = None
    out = np.zeros((len(texts), len(model.languages)))
    for one in model.pieces:
        piece = langid.load(model, one)
        sums, length = piece.sums(texts)
        out[:, piece.first:piece.first + sums.shape[1]] += sums
    return model.rule.entropy(out, length)


ASKED = ["abab", "cab xy", "Zx", "qq \U00010430 xyz, ab", "аб \U00010431", "а"]


@pytest.mark.parametrize("rows", [2_000_000, 5])
def test_entropies_equal_recursion(spark, monkeypatch, rows):
    monkeypatch.setattr(langid, "PIECE_ROWS", rows)
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 0)
    model = learned(spark, TEXTS)
    assert model.languages == ["aa", "bb", "cc"] and (len(model.pieces) > 3) == (rows == 5)
    seen = {g[-1] for lang, t in TEXTS if lang and t for g in grams(t)}
    got = raw(spark, model, ASKED)
    for i, lang in enumerate(model.languages):
        brute = Brute([t for v, t in TEXTS if v == lang], len(seen) + 1)
        assert np.abs(got[:, i] - [brute.entropy(t) for t in ASKED]).max() < 1e-9


def test_symbols_beyond_the_basic_plane_are_their_own():
    x, _ = langid.symbols(["\U00010430а"])
    assert x.tolist() == [32, 0x10430, ord("а"), 32]


def test_many_languages(spark):
    """More languages than a piece holds: each has its own letters."""
    rows = [(f"l{i:03d}", " ".join([chr(0x4E00 + 5 * i + j) * 2 for j in range(5)] * 3)) for i in range(300)]
    model = learned(spark, rows)
    assert len(model.languages) == 300 and len(model.pieces) == 19
    asked = spark.createDataFrame([(i, t[3:30], "x") for i, (_, t) in enumerate(rows)], "doc_id long, text string, lang_pred string")
    got = {r.doc_id: r.lang_pred for r in langid.identify(asked, model).collect()}
    assert got == {i: v for i, (v, _) in enumerate(rows)}


def test_pieces_do_not_change_decisions(spark, docs, monkeypatch):
    whole = langid.fit(docs)
    monkeypatch.setattr(langid, "PIECE_ROWS", 20_000)
    split = langid.fit(docs)
    assert len(split.pieces) > 1 == len(whole.pieces)
    a, b = (sorted(tuple(r) for r in langid.identify(docs, m).select("doc_id", "lang_pred", F.round("entropy", 6), F.round("score", 4), "rejected").collect()) for m in (whole, split))
    assert a == b


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


def test_foreign_text_is_rejected_and_clean_text_kept(spark, docs):
    model = langid.fit(docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
    held = docs.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0)
    named = langid.identify(held, model).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (named.lang_pred == named.lang).mean() > 0.97 and named.rejected.mean() < 0.03 and named.score.between(0, 1).all()
    foreign = ["Ὁ βίος βραχύς ἡ δὲ τέχνη μακρή ὁ δὲ καιρὸς ὀξύς", "съешь ещё этих мягких французских булок да выпей чаю", "zxqj kwvz qqxz jjkw vvzx qkzj wxqz zzqj kxwv " * 5, "漢字仮名交じり文 日本語", "123 !", "", None]
    asked = spark.createDataFrame([(i, t, "x") for i, t in enumerate(foreign)], "doc_id long, text string, _rejected string")
    assert all(r.rejected for r in langid.identify(asked, model).collect())
    assert langid.accept(asked, model).columns == asked.columns and langid.accept(asked, model).count() == 0


def test_scores_are_calibrated_on_texts_left_out(spark, docs):
    model = langid.fit(docs)
    assert 2.0 ** -2 < model.temperature < 2.0 ** 8 and np.isfinite(model.limit).all()


def test_ties_and_nothing_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 0)
    model = learned(spark, [("zz", "abc"), ("aa", "abc"), ("aa", "abc")][:2])
    got = langid.identify(spark.createDataFrame([(1, "abc"), (1, "abc"), (None, "q")], "doc_id long, text string"), model).collect()
    assert [r.lang_pred for r in got] == ["aa", "aa", "aa"]
    assert learned(spark, [(None, "abc"), ("aa", None)]) is None and learned(spark, [("aa", "12")]) is None
    got = langid.identify(spark.createDataFrame([(1, "abc")], "doc_id long, text string"), None).first()
    assert (got.lang_pred, got.score, got.rejected) == ("und", 0.0, True)


def test_query_returns_every_row(spark, folder, docs):
    assert catalog.language_id(spark, folder).count() == docs.count()


def test_every_text_counts_and_calibrates(spark, docs, monkeypatch):
    """The entropies are those of all texts, and limits change with any of them."""
    rows = docs.select("lang", "text").filter("lang is not null and text is not null")
    some = rows.limit(120)
    model = langid.fit(some)
    monkeypatch.setattr(langid, "CALIBRATION_ROWS", 0)
    plain = langid.fit(some)
    asked = [r.text for r in some.limit(20).collect()]
    assert np.abs(raw(spark, model, asked) - raw(spark, plain, asked)).max() < 1e-9
    monkeypatch.undo()
    seen = []
    kept = langid._calibrated
    monkeypatch.setattr(langid, "_calibrated", lambda m, judged: seen.append(judged.count()) or kept(m, judged))
    langid.fit(some.union(some))
    letters_in = {t for t in (r.text for r in some.collect()) if any(c.isalpha() for c in t)}
    assert seen == [len({(r.lang, r.text) for r in some.collect() if r.text in letters_in})]


def test_foreign_texts_under_a_label_are_not_accepted(spark):
    """texts that the model had learned were always accepted, and the farthest of them set the limit."""
    rng = np.random.default_rng(11)

    def text(syllables, words):
        return " ".join("".join(rng.choice(syllables, rng.integers(1, 4))) for _ in range(words))
    rows = [(100 * k + i, lang, text(syllables, 40)) for k, (lang, syllables) in enumerate((("aa", ["ba", "ne", "to", "ri"]), ("bb", ["scho", "uf", "ein", "lig"]))) for i in range(60)]
    rows += [(1000 + i, lang, text(list("qxzjkvwpgh"), 60)) for i, lang in enumerate(("aa", "aa", "bb", None))]
    rows += [(2000, None, text(["ba", "ne", "to", "ri"], 40)), (2001, "aa", None), (2002, "aa", "12")]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    model = langid.fit(docs)
    kept = {r.doc_id: (r.lang, r.text) for r in langid.accept(docs, model).collect()}
    assert kept == {i: (lang, t) for i, lang, t in rows if i < 1000 or i == 2000}
    assert langid.accept(docs.union(docs), model).count() == 2 * len(kept)
