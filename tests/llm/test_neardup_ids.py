"""Near duplicates of documents that have several texts."""

from haulwise.llm import neardup

A, B = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")


def test_texts_of_one_document_are_tied(spark):
    rows = [(1, A), (1, B), (2, A + " x"), (3, B + " y"), (4, "zz q"), (4, ""), (4, "zz q"), (5, None), (None, A), (7, "zz q"), (8, "other words here")]
    got = neardup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2).collect()
    have = {(r.doc_id, r.component_id, r.kept) for r in got}
    assert have == {(1, 1, True), (2, 1, False), (3, 1, False), (4, 4, True), (5, 5, True), (None, None, True), (7, 4, False), (8, 8, True)}
    assert len(got) == len(rows)
