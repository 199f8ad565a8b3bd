"""Plan features of every registered query: python tests/plan_report.py [key ...]"""

from __future__ import annotations

import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def features(df) -> dict[str, int]:
    plan = df._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("== Initial Plan ==")[-1] if "== Initial Plan ==" in plan else plan
    return {
        "exchanges": len(re.findall(r"Exchange (?:hash|range|round|Single|REBAL)|Exchange hashpartitioning", initial)),
        "single": initial.count("Exchange SinglePartition"),
        "nested_loop": initial.count("BroadcastNestedLoopJoin"),
        "cartesian": initial.count("CartesianProduct"),
        "window": len(re.findall(r"Window \[", initial)),
        "scans": initial.count("FileScan parquet"),
    }


if __name__ == "__main__":
    from tallybook.plans import catalogue
    from tallybook.session import local_session

    spark = local_session(8)
    for key in sys.argv[1:] or catalogue.QUERIES:
        print(key, features(catalogue.QUERIES[key](spark, "/root/testdata/sf0.001")), flush=True)
