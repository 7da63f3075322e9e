"""Times the headline workloads and prints one JSON line.

BENCH_SF_DIR: folder of tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_RUNS: timed runs after one warm-up, of which the median counts (default 2).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

from pyspark.sql import SparkSession

sys.path.insert(0, str(Path(__file__).resolve().parent))

from workloads import QUERIES  # noqa: E402

HEADLINE = (
    "column_profiles",
    "detect_kinds",
    "sanitize_lines",
    "sanitize_report",
    "impute_mode",
    "outlier_filter",
    "describe_lines",
    "pearson_long",
    "spearman_long",
    "pca_scores",
    "pca_reconstruction",
    "fa_adequacy",
    "fa_varimax",
    "burt_lines",
    "mca_four_rows",
    "famd_mixed_rows",
    "csv_roundtrip",
    "sql_passthrough",
    "audit_steps",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tablescope-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    timings = {}
    chosen = sys.argv[1:] or HEADLINE
    for name in chosen:
        taken = []
        for _ in range(runs + 1):
            started = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - started)
        timings[name] = round(statistics.median(taken[1:]), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
