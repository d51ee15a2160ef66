"""Benchmark the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_WARMUP_DIR (default: the sibling sf0.001 folder, used only to warm up).
Each query runs to completion into Spark's ``noop`` sink (full execution, nothing
collected). ``extract_only`` times the rule extractor alone on statements already
written to the shared folder, separating it from statement rendering.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["extract_bills", "validate_response", "store_all", "line_items", "label_candidates",
            "html_to_markdown", "assemble_parts", "first_valid_attempt", "workflow_output"]


def run(df) -> float:
    t = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - t


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from stmtflow.operators.extract import extract_bills
    from stmtflow.plans import fixtures as fx
    from stmtflow.plans.catalog import QUERIES
    from stmtflow.session import get_spark, materialize, shared_path

    spark = get_spark(f"local[{cpus}]", shuffle_partitions=int(cpus) * 2)
    spark.range(1000).selectExpr("sum(id)").collect()  # JVM warm-up
    # Warm the code paths (regex, JSON, validation) on the smallest dataset, if present,
    # so one-time JIT cost does not land on whichever query happens to run first.
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", os.path.join(os.path.dirname(sf_dir), "sf0.001"))
    if os.path.isdir(warm_dir) and os.path.abspath(warm_dir) != os.path.abspath(sf_dir):
        for name in ("extract_bills", "validate_response", "line_items"):
            run(QUERIES[name](spark, warm_dir))

    times: dict[str, float] = {}
    for name in HEADLINE:
        t = time.time()
        df = QUERIES[name](spark, sf_dir)  # includes any staging the query does eagerly
        setup = time.time() - t
        times[name] = round(setup + run(df), 3)

    statements = materialize(fx.statements(spark, sf_dir), shared_path(spark, "bench", unique=True))
    n_docs = statements.count()
    run(extract_bills(statements))  # warm
    times["extract_only"] = round(run(extract_bills(statements)), 3)

    total = round(sum(v for k, v in times.items() if k != "extract_only"), 3)
    out = {
        "metric": "headline_queries_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir).replace("sf", ""),
        "documents": n_docs,
        "docs_per_sec": {
            "extract_only": round(n_docs / times["extract_only"], 1),
            "extract_bills": round(n_docs / times["extract_bills"], 1),
            "validate_response": round(n_docs / times["validate_response"], 1),
            "store_all": round(n_docs / times["store_all"], 1),
        },
        "cpus": int(cpus),
    }
    print(json.dumps(out))


if __name__ == "__main__":
    main()
