"""Print the formatted physical plan of registered queries, with a short summary of
exchanges, joins and scans (``python tools/explain_plans.py [sf_dir] [query ...]``)."""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

SUMMARY = re.compile(r"(BroadcastExchange|Exchange|\w+Join|Scan parquet|WindowGroupLimit|Window |"
                     r"ObjectHashAggregate|HashAggregate|SortAggregate|CollectMetrics|MapInPandas)")


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    from stmtflow.plans.catalog import QUERIES
    from stmtflow.session import get_spark

    spark = get_spark(shuffle_partitions=8)
    for name in argv[2:] or ["extract_bills", "validate_response", "first_valid_attempt", "apply_corrections"]:
        df = QUERIES[name](spark, sf_dir)
        plan = spark._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
        counts: dict[str, int] = {}
        for m in SUMMARY.findall(plan.split("\n\n")[0]):
            counts[m] = counts.get(m, 0) + 1
        print(f"== {name}: {counts}")
        print(plan)


if __name__ == "__main__":
    main(sys.argv)
