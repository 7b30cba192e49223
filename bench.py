"""Headline queries, timed once each after a warm-up; prints one JSON line.

BENCH_SF_DIR names the data (default sf0.1), BENCH_CPUS the local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = (
    "registry_violations", "registry_lookup", "replacement_verdict", "replacement_chain", "promote",
    "discover_new", "doc_drift", "spec_diff", "affected_sites", "usage_summary",
    "occ_tiers", "tier_rollup", "tier_unique", "multi_tier_notes", "review_top", "file_rollup",
    "param_sites", "prefilter", "coverage", "extract_native", "changed_lines", "combined_fix",
    "gate_tier", "diagnostics_new",
)


def main() -> None:
    from tidemark.session import build_session
    from tidemark.workload.queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "tidemark-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        # noop runs the whole plan and every output column without collecting.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale) if scale.replace(".", "", 1).isdigit() else scale,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
