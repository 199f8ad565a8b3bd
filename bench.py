"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallybook.plans import catalogue  # noqa: E402
from tallybook.session import local_session  # noqa: E402

HEADLINE = [
    "best_attempt", "drop_ambiguous_keys", "backfill_across_years", "nearest_distance", "spread_subjects", "ntile_bands",
    "provision_by_criteria", "subject_access_all", "subject_combinations", "representation_cube", "average_by_subject",
    "pass_rate_by_subject", "provider_differential", "subject_gap_table", "anonymise_table", "league_table", "ols_by_subject",
    "logit_uptake_flag", "logit_uptake", "qualification_counts", "reach_trend", "write_clean", "single_qualification",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, "bench", os.environ.get("BENCH_MEMORY", "16g"), tempfile.mkdtemp(prefix="bench-"))
    catalogue.QUERIES["dataset_totals"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # warm up the JVM
    seconds = {}
    for key in HEADLINE:
        start = time.perf_counter()
        catalogue.QUERIES[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": float(found.group(1)) if found else None, "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
