"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8) and BENCH_RUNS (default 3, after one warm-up).
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "change_summary",
    "classify_entries",
    "cosmetic_counts",
    "diff_lines",
    "split_rows",
    "visible_lines",
    "nearest_navigable",
    "changed_constructs",
    "file_summary",
    "session_totals",
    "staged_semi",
    "partial_patch",
    "src_diff_json",
    "src_event_log",
    "sink_markdown",
    "find_regions",
    "highlight_spans",
    "rename_map",
    "normalized_files",
    "moved_constructs",
    "viewports",
    "collapsed_info",
    "lcs_length",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("changelens-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from changelens.plans.catalog import QUERIES

    def timed(name: str) -> float:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name)
        seconds[name] = round(statistics.median(timed(name) for _ in range(runs)), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
