"""Headline queries, timed; prints one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores.
Each query runs to completion into Spark's ``noop`` sink, so all rows and columns are
computed and nothing is collected; the best of two runs counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from linewright.session import build_session  # noqa: E402
from workloads import copies, counting, inspecting, reading, repairing  # noqa: E402, F401
from workloads.registry import REGISTRY  # noqa: E402

HEADLINE = [
    "read_jsonl",
    "read_parquet_documents",
    "read_csv_lines",
    "search",
    "search_with_context",
    "lint",
    "lint_counts",
    "fix",
    "fix_chat",
    "fnv1a64",
    "extract_content",
    "simhash64",
    "simhash_json_lines",
    "near_duplicate_pairs",
    "dedup_exact",
    "dedup_simhash",
    "dedup_simhash_k5",
    "dedup_simhash_k8",
    "dedup_simhash_k10",
    "copy_pairs_k6",
    "dedup_json_lines",
    "export_unique",
    "write_fixed",
    "search_all_with_context",
    "manifest_get_lines",
    "count_tokens",
    "token_budget",
    "stream_fix",
    "annotate",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        shuffle_partitions=int(cpus) if cpus.isdigit() else 8,
        driver_memory=os.environ.get("BENCH_DRIVER_MEMORY", "8g"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        function, _ = REGISTRY[name]
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            function(spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(min(runs), 3)
    result = {
        "metric": "total_query_time",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
