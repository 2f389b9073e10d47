"""Corpus operators against brute force on small tables, and their behaviour on odd rows."""

import datetime as dt
import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

import corpus_pipeline
from check_sql import compare, connect
from haulwise.llm import ann, catalog, graph, katz, langid, licenses, lines, neardup, packing, pieces, quality, urls
from haulwise.llm.text import Words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 977}" for i in range(30000))
ODD = [(None, "null id here and some more words to read", "en", None, 1), (1, None, None, "s", 0), (2, "", "en", "s", 0),
       (3, " \n\t\n ", "en", "s", 5), (4, "One two three.\nOne two three.\nOne two three.\nOne two three.", "en", "s", 4),
       (5, LONG, "en", "s", 5), (5, LONG, "en", "s", 5), (6, "漢字 é \u0000 <|endoftext|> ▁ x", "fr", "s", 9), (7, "a", "de", "s", 1)]


@pytest.fixture(scope="module")
def docs(spark, folder):
    return spark.read.parquet(f"{folder}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text or "" for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def test_word_hashes():
    got = Words(pa.array(["", None, "a b  c\n", " x", "ABC abc", "\x0b\x1cq\x85"]), lower=True)
    assert got.counts.tolist() == [0, 0, 3, 1, 2, 1] and len(set(got.hashes().tolist())) == 6


@pytest.mark.parametrize("name", ["op3_url_filter", "op9_line_dedup"])
def test_equals_sql(spark, folder, name):
    assert compare(catalog.queries()[name](spark, folder), connect(folder), catalog.sql()[name]) is None


def test_packing_is_gapless_whole_and_dense(spark, folder, texts):
    got = catalog.pack(spark, folder).toPandas()
    from tokenizers import Tokenizer
    bpe = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for (sequence,), group in got.groupby(["sequence_id"]):
        group = group.sort_values("offset")
        assert group.offset.tolist() == np.concatenate([[0], np.cumsum(group.length)[:-1]]).tolist() and group.length.sum() <= 2048
    for doc_id, group in got.groupby("doc_id"):
        ids = np.array([*bpe.encode(texts[doc_id], add_special_tokens=False).ids, 0], "<u4")
        group = group.sort_values("piece")
        assert group.length.sum() == len(ids) and (group.length[1:] == 2048).all() and group.piece.tolist() == list(range(len(group)))
        for r in group.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
    assert got.sequence_id.nunique() <= math.ceil(got.length.sum() / 2048) * 1.02 + 1


def test_encoder_equals_tokenizer():
    from tokenizers import Tokenizer
    P = public_tokenizers
    ours, theirs = packing.Encoder(P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN), Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng, chars = np.random.default_rng(1), list("ab Z9  \n\t'sé漢 😀  \x1c.,!\r")
    sample = ["".join(rng.choice(chars, rng.integers(0, 40))) for _ in range(500)] + ["x <|endoftext|> y", " a", "a ", "a  b"]
    for text, ids in zip(sample, ours.encode(sample)):
        assert np.frombuffer(ids, "<u4").tolist() == theirs.encode(text, add_special_tokens=False).ids


def test_linear_program_covers_and_rounds():
    demand = np.zeros(101, np.int64)
    demand[[60, 40, 35, 30, 100, 7]] = [50, 30, 40, 20, 9, 300]
    use = packing.fractional(demand)
    covered = np.zeros(101)
    for config, x in use.items():
        assert sum(k * n for k, n in config) <= 100
        for k, n in config:
            covered[k] += n * x
    assert (covered <= demand + 1e-6).all() and covered.sum() > 0.5 * demand.sum()
    plan = packing.rounded(demand, use)
    placed = Counter()
    for config, copies in plan:
        assert sum(k * n for k, n in config) <= 100
        for k, n in config:
            placed[k] += n * copies
    assert all(placed[k] == demand[k] for k in range(101))


def test_quality_counts(spark, folder, texts):
    for r in catalog.quality_rules(spark, folder).collect():
        w = WORD.findall(texts[r.doc_id])
        windows = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        often = Counter(windows)
        repeated = {i + k for i, x in enumerate(windows) if often[x] > 1 for k in range(5)}
        solid = [x for x in texts[r.doc_id].split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (
            len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in texts[r.doc_id]), len(solid) - len(set(solid)), len(repeated))
        assert r.base_failed == (len(w) < 10 or 100 * len(repeated) > 20 * len(w)) and not (r.base_failed and r.kept)


def test_quality_field_learns_and_decodes(spark, folder, docs):
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    got = quality.judge(docs, quality.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.97 and got[got.quality == 0].kept.mean() < 0.2
    rng = np.random.default_rng(3)
    field = quality.Field(rng.normal(size=quality.N_FEATURES), rng.normal(size=(2, 2)))
    block = quality.Lines(rng.normal(size=(9, quality.N_FEATURES)), np.ones(9), np.array([0, 4, 4, 9]))
    best = quality.viterbi(field, block)
    gain = block.features @ field.unary
    for a, b in ((0, 4), (4, 9)):
        paths = [[(n >> i) & 1 for i in range(b - a)] for n in range(1 << (b - a))]
        score = lambda p: sum(gain[a + i] * y for i, y in enumerate(p)) + sum(field.move[x, y] for x, y in zip(p, p[1:]))  # noqa: E731, B023
        assert max(paths, key=score) == best[a:b].tolist()


def test_language_held_out(spark, folder, docs):
    got = catalog.language_id(spark, folder).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    assert (got[got.held_out].lang_pred == got[got.held_out].lang).mean() > 0.97 and got.score.between(0, 1).all()
    assert (got.held_out == [zlib.crc32(str(i).encode()) % 5 == 0 for i in got.doc_id]).all()


def brute_groups(texts, k):
    sets = {}
    for i, t in texts.items():
        w = words(t)
        sets[i] = set(zip(*[w[j:] for j in range(k)])) if len(w) >= k else ({tuple(w)} if w else set())
    parent, postings = {i: i for i in sets}, defaultdict(list)

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in postings[s])
        for j, n in common.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                parent[b] = a
        for s in sets[i]:
            postings[s].append(i)
    return {i: (len(sets[i]), top(i)) for i in sets}


def test_near_duplicates(spark, docs, texts, monkeypatch):
    want = brute_groups(texts, 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.duplicate_groups(docs, 2).collect()}
    assert got == want
    # a group whose members lie near the limit, all buckets through the blocks
    monkeypatch.setattr(neardup, "SMALL_BUCKET", 1)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    rng = np.random.default_rng(5)
    near = {i: " ".join(f"w{n}" if rng.random() > 0.06 else f"x{rng.integers(1 << 30)}" for n in range(120)) for i in range(60)}
    frame = spark.createDataFrame(list(near.items()), "doc_id long, text string")
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.duplicate_groups(frame, 2).collect()} == brute_groups(near, 2)


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (5, 6), (4, 9)], "a long, b long")
    assert {(r.node, r.root) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (9, 1), (4, 1), (5, 5), (6, 5)}


def test_katz_equals_brute_force(spark, folder, texts):
    tokens = {i: [*words(t), "</s>"] for i, t in texts.items()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in tokens}
    uni, bi, past = Counter(), Counter(), Counter()
    for i, w in tokens.items():
        if not held[i]:
            uni.update(w)
            bi.update(zip(["<s>", *w], w))
            past.update(["<s>", *w[:-1]])
    n, kinds = sum(uni.values()), len(uni)
    one, two = (katz.good_turing(Counter(c for c in x.values() if c <= katz.FITTED)) for x in (uni, bi))
    star = lambda d, c: float(d(np.array([c]))[0])
    unknown = 1 - sum(star(one, c) for c in uni.values()) / n
    single = lambda w: star(one, uni[w]) / n if uni[w] else unknown
    left, seen = defaultdict(float), defaultdict(float)
    for (h, w), c in bi.items():
        left[h] += c - star(two, c)
        seen[h] += single(w)

    def p(h, w):
        if bi[h, w]:
            return star(two, bi[h, w]) / past[h]
        return left[h] / past[h] / (1 - seen[h]) * single(w) if past[h] else single(w)
    for h in ("<s>", "the"):
        assert sum(p(h, w) for w in uni) + p(h, "\0never") == pytest.approx(1)
    got = catalog.lm_score(spark, folder).collect()
    assert len(got) == len(tokens)
    for r in got[::5]:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(uni[x] > 0 for x in w), n, held[r.doc_id])
        assert r.score == pytest.approx(sum(math.log10(p(h, x)) for h, x in zip(["<s>", *w], w)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((uni[x] + 1) / (n + kinds + 1)) for x in w), rel=1e-9)


def test_sentence_pieces(spark, folder, texts):
    import sentencepiece
    model = public_tokenizers.path("piece_bpe_32k.model")
    library, codec = sentencepiece.SentencePieceProcessor(model_file=model), pieces.Codec(model)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in catalog.sentence_pieces(spark, folder).collect():
        ids = library.encode(texts[r.doc_id], add_eos=True)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids)))
    rng, chars = np.random.default_rng(2), list("ab Z9  \n\t'sé漢 😀▁  \x1c.,!\r\x00ﬁ①Å가")
    for _ in range(300):
        text = "".join(rng.choice(chars, rng.integers(0, 40)))
        ids, begins, ends = codec.spans(text)
        assert ids == codec.encode(text) == library.encode(text, add_eos=True)
        whole = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces if not library.is_byte(p.id)]
        assert whole == [(b, e) for i, b, e in zip(ids, begins, ends) if not library.is_byte(i)][:-1]


def test_sentence_pieces_query_holds_spans(spark, folder, texts):
    """The rows of the query come from the spans of the library, byte pieces of one character sharing its source."""
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in catalog.sentence_pieces(spark, folder).limit(60).collect():
        text, spans = texts[r.doc_id], []
        size = len(text.encode())
        for p in library.encode(text, return_type="proto").pieces:
            spans.append([p.begin, p.end])
        bytes_of = [library.is_byte(p.id) for p in library.encode(text, return_type="proto").pieces]
        for i in range(len(spans)):  # the library gives a whole character to the last of its byte pieces
            if bytes_of[i] and spans[i][0] == spans[i][1]:
                j = next(j for j in range(i, len(spans)) if spans[j][1] > spans[j][0])
                spans[i] = spans[j]
        spans.append([size, size])
        assert r.spans_sha256 == hashlib.sha256(np.array(spans, "<i8").T.tobytes()).hexdigest()


def test_spans_with_symbols(tmp_path, spark):
    import sentencepiece
    sentencepiece.SentencePieceTrainer.train(
        sentence_iterator=iter(["the quick brown fox ﬁ jumps over <x> the lazy dog"] * 20), model_prefix=str(tmp_path / "m"), vocab_size=320,
        model_type="bpe", byte_fallback=True, user_defined_symbols=["<x>", "ﬁ"], normalization_rule_name="nmt_nfkc", hard_vocab_limit=False, minloglevel=2)
    library, codec = sentencepiece.SentencePieceProcessor(model_file=str(tmp_path / "m.model")), pieces.Codec(str(tmp_path / "m.model"))
    for text in ("the ﬁ<x>fox  ① ", "<x>", " ﬁ dog Å", ""):
        ids, begins, ends = codec.spans(text)
        assert ids == codec.encode(text) == [*library.encode(text), library.eos_id()]
        whole = [(p.begin, p.end) for p in library.encode(text, return_type="proto").pieces if not library.is_byte(p.id)]
        assert whole == [(b, e) for i, b, e in zip(ids, begins, ends) if not library.is_byte(i)][:-1]
    frame = spark.createDataFrame([(1, "the ﬁ<x>fox  ① ")], "doc_id long, text string")
    assert pieces.round_trip(frame, str(tmp_path / "m.model")).first().n_tokens == len(codec.encode("the ﬁ<x>fox  ① "))


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_character_map(rule):
    import sentencepiece
    library = sentencepiece.SentencePieceNormalizer(rule_name=rule, add_dummy_prefix=True, escape_whitespaces=True, remove_extra_whitespaces=True)
    spec = {n: v for n, v, _ in pieces._fields(library.serialized_model_proto())}[3]
    ours = pieces.Normaliser(spec)
    for text in ("ﬁ①Å  가 ｶﾞ x", "　a\tb", "ＡＢＣ  ", "", "   ", "é é"):
        assert ours(text)[0] == library.normalize(text)


def test_nearest_recall(spark, folder):
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    v = np.stack(rows.embedding).astype(float)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    got = catalog.nearest_vectors(spark, folder).toPandas()
    hits = total = 0
    for i in np.flatnonzero(rows.vec_id % 50 == 0):
        score = unit @ unit[i]
        score[i] = -2
        want = set(rows.vec_id[np.argsort(-score)[:5]])
        mine = got[got.query_id == rows.vec_id[i]].sort_values("rank")
        assert mine["rank"].tolist() == [1, 2, 3, 4, 5] and (np.diff(mine.score) <= 0).all()
        hits, total = hits + len(want & set(mine.vec_id)), total + 5
    assert hits >= 0.9 * total


def test_nearest_odd_rows(spark):
    rows = [(0, [1.0, 0.0], "x"), (1, [2.0, 0.0], "x"), (2, [3.0, 0.0], "x"), (2, [3.0, 0.0], "x"), (3, None, "x"), (4, [0.0, 0.0], "x"),
            (5, [float("nan"), 1.0], "x"), (6, [None, 1.0], "x"), (None, [1.0, 1.0], "x"), (50, [0.0, 1.0, 0.0], "x"), (7, [float("inf"), 1.0], "x")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    from pyspark.sql import functions as F
    got = ann.nearest(frame, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id, round(r.score, 9)) for r in got] == [(0, 1, 1, 1.0), (0, 2, 2, 1.0)]
    assert ann.nearest(frame.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_nearest_repeated_rows_take_one_place(spark):
    """Six copies of the nearest row, and six vectors of one id, leave room for the other candidates."""
    from pyspark.sql import functions as F
    copies = [(1, [1.0, 0.001])] * 6
    others = [(2, [1.0, 0.001 + i / 1e6]) for i in range(6)]
    rest = [(i, [1.0, i / 10]) for i in range(3, 10)]
    rows = [(0, [1.0, 0.0]), *copies, *others, *rest]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(frame, F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.rank, r.vec_id) for r in got] == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 5)]
    v = np.array([x for _, x in rows])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    ids = np.array([i for i, _ in rows])
    assert ann.Index(ids, v, unit).search(ids[:1], v[:1], unit[:1], 5)[1] == [1, 2, 3, 4, 5]


def test_license_scan(spark):
    rows = [(1, "a/LICENSE", "Released under the MIT License."), (2, "a/b/x.py", "code"), (3, "a/b/c/LICENSE", "nothing"), (4, "d/y.py", "z\nLicensed under the Apache License, Version 2.0.\nz"),
            (5, "top.py", None), (6, None, "Released under the MIT License."), (7, "a/b/c/w.py", ""), (7, "a/b/c/w.py", "")]
    got = licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()
    assert sorted((r.key, r.license, r.inherited_from) for r in got if r.key != 5) == sorted([
        (1, "MIT", None), (2, "MIT", "a"), (3, "MIT", "a"), (4, "Apache-2.0", None), (6, "MIT", None), (7, "MIT", "a"), (7, "MIT", "a")])
    assert [r.license for r in got if r.key == 5] == [None]
    assert licenses.scan(spark.createDataFrame([], "key long, path string, text string")).count() == 0


@pytest.mark.parametrize("n", [10, 1000])
def test_license_notices_amid_other_words(spark, n):
    """A notice is found with words before and after it and over lines, in tables of different size."""
    apache = 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'
    notices = [("MIT", "Copyright Acme. Released under the MIT License."), ("MIT", "Code released under the MIT License."),
               ("MIT", "Copyright 2024 Jane Doe. Released under the MIT License. All else is kept by the authors of this code"),
               ("MIT", "# Released under\n# the MIT\n# License.\nimport os"), ("Apache-2.0", apache),
               ("GPL-3.0", "see below\nThis program is free software: you can redistribute it\nand/or modify it under the terms of\nthe GNU General Public License as published"),
               (None, "The terms of the license are under review by the public office.")]
    filler = [(100 + i, None, f"code of the part {i} is under work by Jane Doe and others") for i in range(n)]
    rows = [(i, None, t) for i, (_, t) in enumerate(notices)] + filler
    got = {r.key: r for r in licenses.scan(spark.createDataFrame(rows, "key long, path string, text string")).collect()}
    assert len(got) == len(rows) and [got[i].own_license for i in range(len(notices))] == [v for v, _ in notices]
    assert all(got[k].own_license is None for k, _, _ in filler)
    # the weights of other words are their own: by hand for a passage of one line
    m = licenses.Matcher(licenses.TEMPLATES, {"the": 3}, 10, 0.0)
    v = {w: m.idf.get(w, math.log(11 / 6) + 1) for w in ("mit", "license", "code")}
    t = dict(m.templates[0][1])
    want = sum(v[w] * t.get(w, 0) for w in v) / math.sqrt(sum(x * x for x in v.values()))
    assert m.best(["mit", "license", "code"], {"code": 5}) == (pytest.approx(want), "MIT")


def test_url_filter_dates(spark):
    t = lambda d: dt.datetime(2024, 1, d)
    captures = spark.createDataFrame([(1, "http://a.b.com/x/y", t(1)), (2, "http://a.b.com/x/y", t(3)), (3, "http://a.b.com/x/y", t(5)), (4, None, t(5)), (5, "http://q.org/", None), (6, "junk", t(2))],
                                     "page_id long, url string, fetched timestamp")
    entries = spark.createDataFrame([("domain", "b.com", t(2), "add"), ("domain", "b.com", t(5), "remove"), ("prefix", "a.b.com/x/", t(3), "add"), ("prefix", "a.b.com/x/", t(4), "remove"), ("domain", None, t(1), "add")],
                                    "kind string, value string, since timestamp, action string")
    got = {r.page_id: (r.blocked, r.value) for r in urls.evaluate(captures, entries).collect()}
    assert got == {1: (False, None), 2: (True, "a.b.com/x/"), 3: (False, None), 4: (False, None), 5: (False, None), 6: (False, None)}
    assert urls.evaluate(captures.limit(0), entries.limit(0)).count() == 0


def test_odd_documents(spark, odd):
    n = len(ODD)
    assert quality.judge(odd, None).count() == n and quality.retain(odd, None).columns == odd.columns
    model = langid.fit(odd)
    named = langid.identify(odd, model).collect()
    assert len(named) == n and {r.lang_pred for r in named if r.doc_id in (1, 2, 3)} == {"und"}
    groups = neardup.duplicate_groups(odd, 5).collect()
    assert len(groups) == n and {(r.component_id, r.kept) for r in groups if r.doc_id == 5} == {(5, True)}
    assert [(r.component_id, r.kept) for r in groups if r.doc_id is None] == [(None, True)]
    cleaned = lines.dedup_lines(odd.withColumn("gone", odd["text"]).withColumn("row", odd["lang"])).collect()
    assert len(cleaned) == n
    by_id = {r.row.doc_id: r for r in cleaned}
    assert by_id[1].text is None and by_id[4].text == "One two three." and by_id[4].n_removed == 3 and by_id[5].text == LONG
    P = public_tokenizers
    packed = packing.pack_documents(odd, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).toPandas()
    assert packed[packed.piece == 0].shape[0] == n and packed[packed.doc_id == 1].length.tolist() == [1]
    scored = katz.score_documents(odd, odd["doc_id"] != 7).collect()
    assert len(scored) == n and all(math.isfinite(r.score) for r in scored)
    assert pieces.round_trip(odd, P.path("piece_bpe_32k.model")).count() == n
    assert pieces.encode_spans(odd, P.path("piece_bpe_32k.model")).count() == n


def test_empty_documents(none):
    P = public_tokenizers
    assert quality.fit(none, none.selectExpr("doc_id", "1 as quality")) is None and langid.fit(none) is None
    for frame in (quality.judge(none, None), langid.identify(none, None), neardup.duplicate_groups(none), lines.dedup_lines(none),
                  packing.pack_documents(none, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN),
                  katz.score_documents(none, none["doc_id"] != 7), pieces.round_trip(none, P.path("piece_bpe_32k.model"))):
        assert frame.count() == 0


def test_pipeline_stages(spark, folder, docs):
    result, before = docs, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        result = stage(spark, result, folder)
        assert result.columns == docs.columns, name
        now = result.count()
        assert 0 < now <= before
        before = now
    assert corpus_pipeline.run(spark, folder).select("doc_id").distinct().count() == before


@pytest.mark.parametrize("held", [200_000, 7])
def test_components_of_chains_take_few_rounds(spark, monkeypatch, held):
    """A task joins its own edges: a chain that fits one needs no step between tasks, and parts of it still meet."""
    from haulwise.llm import graph
    monkeypatch.setattr(graph, "TASK_EDGES", held)
    written, kept = [], graph.staged
    monkeypatch.setattr(graph, "staged", lambda df, name: written.append(name) or kept(df, name))
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101), (100, 102), (100, 101)], "a long, b long")
    got = {(r.node, r.root) for r in graph.components(edges).collect()}
    assert got == {(i, 0) for i in range(41)} | {(i, 100) for i in (100, 101, 102)}
    assert held == 7 or len(written) <= 2
