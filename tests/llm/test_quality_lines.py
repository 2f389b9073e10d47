"""Line labels of the quality field, its gradient, and counts beyond 32 bits."""

import numpy as np
import pyarrow as pa
import pytest

from haulwise.llm import katz, quality


@pytest.fixture(scope="module")
def trained(spark, folder):
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, quality.fit(docs, labels)


def chain(seed, sizes):
    rng = np.random.default_rng(seed)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return rng, quality.Lines(rng.normal(size=(first[-1], quality.N_FEATURES)), rng.integers(1, 9, first[-1]).astype(float), first)


def test_gradient_equals_differences():
    rng, lines = chain(5, [4, 0, 1, 7])
    truth = rng.integers(0, 2, 12)
    theta = rng.normal(size=quality.N_FEATURES + 4)
    at = lambda t: quality._likelihood(quality.Field(t[:-4], t[-4:].reshape(2, 2)), lines, truth)
    _, unary, move, content = at(theta)
    steps = np.eye(len(theta)) * 1e-5
    numeric = [(at(theta + e)[0] - at(theta - e)[0]) / 2e-5 for e in steps]
    assert np.allclose(np.concatenate([unary, move.ravel()]), numeric, atol=1e-5)
    # the probability of content, by all label sequences of the first text
    field, gain = quality.Field(theta[:-4], theta[-4:].reshape(2, 2)), lines.features @ theta[:-4]
    paths = [[(n >> i) & 1 for i in range(4)] for n in range(16)]
    weight = np.exp([sum(gain[i] * y for i, y in enumerate(p)) + sum(field.move[x, y] for x, y in zip(p, p[1:])) for p in paths])
    assert np.allclose(content[:4], weight @ np.array(paths) / weight.sum())


def test_labels_agree_with_their_text():
    rng, lines = chain(6, [5, 3, 1, 0, 8])
    good, content = np.array([1, 0, 0, 1, 0], np.int8), rng.random(17)
    label = quality.agreeing(content, lines, good)
    for d in (0, 1, 2, 4):
        at = slice(lines.first[d], lines.first[d + 1])
        share = lines.words[at] @ label[at] / lines.words[at].sum()
        assert (share >= quality.MIN_CONTENT) == good[d]
        # a text that agrees by itself keeps the likelier labels
        plain = content[at] >= 0.5
        if (lines.words[at] @ plain / lines.words[at].sum() >= quality.MIN_CONTENT) == good[d]:
            assert (label[at] == plain).all()


def test_share_lies_between_for_mixed_texts(trained):
    docs, labels, field = trained
    got = quality.judge(docs, field).filter("not base_failed").toPandas()
    assert ((got.content_share > 0) & (got.content_share < 1)).sum() >= 3


def test_planted_lines_are_found_in_good_texts(trained):
    docs, labels, field = trained
    rows = docs.join(labels, "doc_id").select("text", "quality").toPandas()
    got = quality.measure(pa.array(rows.text), field)
    rows = rows.assign(failed=got["base_failed"], share=got["content_share"], n=got["n_words"])[~got["base_failed"]]
    clean = rows[(rows.quality == 1) & (rows.share == 1) & (rows.n > 60)].text
    junk = "\n".join(rows[(rows.quality == 0) & (rows.share == 0)].text).split("\n")
    junk = [x for x in junk if 5 <= len(x.split()) <= 30][:12]
    assert len(clean) >= 20 and len(junk) >= 4
    # three lines of rejected texts in the middle of a good one
    planted = []
    for i, t in enumerate(clean):
        lines = t.split("\n")
        k = len(lines) // 2
        planted.append("\n".join(lines[:k] + [junk[(3 * i + j) % len(junk)] for j in range(3)] + lines[k:]))
    after = quality.measure(pa.array(planted), field)
    marked = (after["content_share"] < 1) & (after["content_share"] > 0)
    assert marked.mean() > 0.9


def test_pair_counts_beyond_32_bits():
    for counts in ([], [1, 2, 3], [1, 1 << 32, 7], [(1 << 40) + 5]):
        c = np.array(counts, np.int64)
        raw = katz._packed(c)
        assert katz._pair_counts(raw, katz._short(np.arange(len(c)).astype(np.uint64) << np.uint64(16))).tolist() == counts
        assert len(raw) == len(c) * (8 if len(c) and c.max() >= 1 << 32 else 4)
