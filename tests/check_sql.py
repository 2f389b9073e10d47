"""Run registered queries against DuckDB: python tests/check_sql.py <folder> [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
          "labels conversations").split()


def connect(folder: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def canon(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if hasattr(v, "isoformat"):
        s = v.isoformat()
        return s[:10] if s.endswith("T00:00:00") else s
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if hasattr(v, "as_integer_ratio"):
        return float(v)
    return v


def rows_of(cols, data):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted((tuple(canon(r[i]) for i in order) for r in data), key=repr)


def compare(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    rel = con.execute(sql)
    cols = [d[0] for d in rel.description]
    want = rows_of(cols, rel.fetchall())
    got = rows_of(spark_df.columns, [tuple(r) for r in spark_df.collect()])
    if sorted(cols) != sorted(spark_df.columns):
        return f"columns differ: spark {sorted(spark_df.columns)} sql {sorted(cols)}"
    if len(got) != len(want):
        return f"rows differ: spark {len(got)} sql {len(want)}; e.g. {list(set(got) ^ set(want))[:2]}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    if bad:
        return f"{len(bad)} of {len(got)} rows differ, first (spark, sql): {bad[0]}"
    return None


def main() -> None:
    from haulwise.catalog import all_queries, all_sql
    from haulwise.session import build_session
    folder, names = sys.argv[1], sys.argv[2:]
    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                                  "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls = connect(folder), all_sql()
    fails = 0
    for name, run in all_queries().items():
        if names and not any(name == n or (n.endswith("*") and name.startswith(n[:-1])) for n in names):
            continue
        t0 = time.time()
        try:
            df = run(spark, folder)
            if name in sqls:
                msg = compare(df, con, sqls[name])
                n = ""
            else:
                n, msg = f"rows={df.count()}", None
        except Exception as e:  # report and go on
            msg, n = f"{type(e).__name__}: {str(e)[:700]}", ""
        fails += msg is not None
        print(f"{'FAIL' if msg else 'ok  '} {time.time() - t0:6.2f}s {name} {'' if name in sqls else '[rows only]'} {n} {msg or ''}", flush=True)
    print("failures:", fails)
    spark.stop()


if __name__ == "__main__":
    main()
