"""FM-index and benchmark decontamination against brute force, SQL and odd rows."""

import hashlib
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from check_sql import compare, connect
from haulwise.llm import catalog, decontam
from haulwise.llm.fmindex import FMIndex

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
DOCS = "doc_id long, text string, row string, items string"


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    """Per document: number of words, hit places, names of items with occurring windows."""
    held = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), window)
        for i in range(len(w) - n + 1 if w else 0):
            held.setdefault(tuple(w[i:i + n]), set()).add("" if item is None else str(item))
    out = []
    for doc_id, text, *_ in docs:
        w, hit, names = words(text), set(), set()
        for n in {len(k) for k in held}:
            for i in range(len(w) - n + 1):
                if tuple(w[i:i + n]) in held:
                    hit.update(range(i, i + n))
                    names |= held[tuple(w[i:i + n])]
        out.append((doc_id, len(w), sorted(hit), sorted(names)))
    return out


def rows(found):
    got = [(r.doc_id, r.n_words, [p for a, b in zip(r.begins, r.ends) for p in range(a, b)], r["items"]) for r in found.collect()]
    return sorted(got, key=str)


def test_fm_index_finds_every_occurrence():
    rng = np.random.default_rng(1)
    scale = np.uint64(0x9E3779B97F4A7C15)
    for trial in range(60):
        v = rng.integers(1, 6)
        texts = [rng.integers(1, v + 1, rng.integers(1, 60)).astype(np.uint64) * scale for _ in range(rng.integers(1, 6))]
        texts += [texts[0]] * (trial % 3)
        index = FMIndex.load(FMIndex.build(texts).dump())
        for n in (1, 3, 10):
            phrases = [t[i:i + n] for t in texts for i in range(len(t) - n + 1)]
            phrases = np.unique([*phrases, rng.integers(1, v + 2, n).astype(np.uint64) * scale], axis=0)
            which, text, place = index.occurrences(phrases)
            want = [(k, d, i) for k, q in enumerate(phrases) for d, t in enumerate(texts) for i in range(len(t) - n + 1) if (t[i:i + n] == q).all()]
            assert sorted(zip(which.tolist(), text.tolist(), place.tolist())) == sorted(want)


def test_query_equals_sql_and_brute_force(spark, folder):
    name = "op11_decontamination"
    got = catalog.queries()[name](spark, folder)
    assert compare(got, connect(folder), catalog.sql()[name]) is None
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{folder}/benchmark.parquet").select("item_id", "text").collect()]
    want = [(d, n, len(hit), len(names), hashlib.sha256(",".join(names).encode()).hexdigest(), bool(hit)) for d, n, hit, names in brute(docs, items)]
    have = [(r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()]
    assert sorted(have) == sorted(want) and any(h[5] for h in have)


PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
ITEMS = [(1, PASSAGE), (2, "Short ITEM"), (2, "other words of item two"), (None, "nameless one"), (3, None), (4, ""), (5, "..."), (1, PASSAGE),
         (10, "eta theta iota kappa lambda mu nu xi omicron pi rho")]
LONG = " ".join(f"w{i % 13}" for i in range(4000))
ODD = [(None, f"x {PASSAGE} y"), (1, None), (2, ""), (3, " \n"), (4, "short--item, again SHORT\x00ITEM short item"), (4, "short--item, again SHORT\x00ITEM short item"),
       (5, f"{LONG} {PASSAGE.upper()} {LONG} nameless one"), (6, f"é{PASSAGE}"), (7, "alpha beta gamma delta epsilon zeta eta theta iota"),
       (8, f"{PASSAGE} nu xi omicron pi rho"), (9, "nameless one"), (9, "漢字 nameless é one")]


@pytest.mark.parametrize("size", [1 << 22, 64, 700])
def test_odd_rows_and_long_texts(spark, monkeypatch, size):
    monkeypatch.setattr(decontam, "SHARD_BYTES", size)
    docs = spark.createDataFrame([(*d, "clash", "clash") for d in ODD], DOCS)
    items = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, words string")
    assert rows(decontam.find(docs, items)) == sorted(brute(ODD, ITEMS), key=str)


def test_blocks_of_the_benchmark_and_long_items(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BLOCK_WORDS", 40)
    monkeypatch.setattr(decontam, "RUN", 7)
    items = [*ITEMS, (11, LONG[:300])]
    found = decontam.find(spark.createDataFrame(ODD, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(found) == sorted(brute(ODD, items), key=str)


def test_removal_cuts_only_hit_words(spark):
    docs = spark.createDataFrame([(*d, "r", "i") for d in ODD], DOCS)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    clean = decontam.remove(docs, decontam.find(docs, items))
    assert clean.columns == docs.columns
    left = sorted(((r.doc_id, words(r.text)) for r in clean.collect()), key=str)
    want = [(d, [w for i, w in enumerate(words(t)) if i not in set(hit)]) for (d, t), (_, _, hit, _) in zip(ODD, brute(ODD, ITEMS))]
    assert left == sorted(want, key=str)
    assert clean.filter("doc_id = 7").first().text == ODD[8][1] and clean.filter("doc_id = 1").first().text is None


def test_empty_tables(spark):
    none, docs = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(ODD, "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.find(none, items).count() == 0
    assert decontam.find(docs, items.limit(0)).filter(F.size("begins") > 0).count() == 0
    assert decontam.find(docs, items.limit(0)).count() == len(ODD)


def test_merge():
    begins, ends = decontam.merge(np.array([5, 0, 2, 20, 9]), np.array([9, 1, 3, 30, 11]))
    assert begins.tolist() == [0, 2, 5, 20] and ends.tolist() == [1, 3, 11, 30]


def test_words_of_nulls():
    assert decontam.words(pa.array(["", None, "A1-b\x7fc é"])).counts.tolist() == [0, 0, 4]
