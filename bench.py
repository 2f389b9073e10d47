"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from haulwise.catalog import all_queries
from haulwise.session import build_session

HEADLINE = [
    "suppliers_at_risk", "dedup_by_key", "quality_warnings", "reliability_history", "as_of_features", "demand_spike",
    "build_nodes", "build_edges", "node_id_map", "degree", "blast_radius", "orders_affected_by", "propagate_risk",
    "enrich", "attribution", "latest_score", "severity_tiles", "worsening", "threshold_crossings", "lockouts",
    "assemble_constraints", "allocate", "po_split", "safety_stock", "rescore", "top_k_similar", "chunk",
    "keyword_search", "retrieve", "roc_auc", "tumbling_rates", "stateful_crossings",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.haulwise.spread": cpus, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.log.level": "ERROR"})
    runs, queries = {}, all_queries()
    names = HEADLINE if not only else (list(queries) if only == ["all"] else only)
    # one untimed query starts the JVM's code paths and the Python workers
    queries["dedup_by_key"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        runs[name] = round(time.perf_counter() - start, 3)
        if only:
            print(f"{runs[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(runs.values()), 3), "unit": "sec",
                      "queries": runs, "sf": folder.rstrip("/").rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
