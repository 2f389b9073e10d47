"""Near duplicates: every plan starts from written tables, so what the driver plans at once stays small."""

from haulwise.llm import graph, neardup


def _text(n: int, changed: int = 0) -> str:
    return " ".join(f"w{n}x{i + (1000 if i < changed else 0)}" for i in range(80))


def test_plans_are_small_and_results_whole(spark, monkeypatch):
    """20 groups of a text, its copy and a near copy; 20 texts alone; a text of one document ties another."""
    rows = [(10 * n + i, _text(n, i // 2)) for n in range(20) for i in range(3)]
    rows += [(1000 + n, _text(100 + n)) for n in range(20)] + [(1000, _text(101)), (2000, None), (2001, "")]
    plans, kept = [], graph.staged

    def seen(df, name):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return kept(df, name)
    for module in (graph, neardup):
        monkeypatch.setattr(module, "staged", seen)
    result = neardup.duplicate_groups(spark.createDataFrame(rows, "doc_id long, text string"), k=2)
    plans.append(result._jdf.queryExecution().executedPlan().toString())
    want = {(10 * n + i, 10 * n) for n in range(20) for i in range(3)} | {(1000 + n, 1000 + n) for n in range(2, 20)}
    want |= {(1000, 1000), (1001, 1000), (2000, 2000), (2001, 2001)}
    assert {(r.doc_id, r.component_id) for r in result.collect()} == want
    moves = [p.count("Exchange ") - p.count("ReusedExchange ") for p in plans]
    assert max(moves) <= 8, moves
    assert sum(moves) <= 60, moves
