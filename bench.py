"""Benchmark: headline queries, seconds each, one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the cores.  Every query is planned and run to the end with its
result counted by a no-op sink; the first, untimed query only warms the session up.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tablewarden.plans import catalogue  # noqa: E402
from tablewarden.session import local_session  # noqa: E402

HEADLINES = [
    "flagship_contaminate_detect_score", "suite_findings", "duplicate_row", "duplicate_key", "chronological", "sequential_id",
    "column_compare", "aggregate_match", "referential_integrity", "outlier_zscore", "outlier_iqr", "outlier_mad", "misspelling_vocabulary",
    "language_mismatch", "pii_counts", "duplicate_text", "near_duplicate_text", "near_duplicate_lsh", "semantic_duplicate", "record_suite",
    "apply_fixes", "fix_impute_median", "plant_in_order", "parse_issue_reports", "identify_score", "fix_grading", "combined_reward",
    "rule_quality", "review_missed_hard",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    queries = catalogue.queries()
    names = sys.argv[1:] or HEADLINES
    queries["missing_value"](spark, folder).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "seconds for all headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()
