"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) set the
data and the cores. Every query is written to the no-op sink, so all its rows
are computed and none are collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from gleanspark.catalog import QUERIES, load_all  # noqa: E402

HEADLINE = [
    "p1_windows",
    "p2_chunk_paragraphs",
    "b1_index_postings",
    "b3_bm25_topk",
    "b4_saved_index",
    "b5_attach_context",
    "b7_per_option_search",
    "b8_phrase_rerank",
    "b9_dual_index_fusion",
    "b15_first_hit_ranks",
    "b16_evaluate_with_intervals",
    "j2_pool_minus_dev",
    "j5_near_duplicates",
    "j10_nearest_global",
    "b11_two_stage_dense",
    "r4_disjoint_split",
    "m5_paired_bootstrap",
    "m11_comparison_report",
    "e7_arm_table",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cores = os.environ.get("BENCH_CPUS", "8")
    wanted = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gleanspark-bench")
        .config("spark.sql.shuffle.partitions", str(max(8, int(cores))))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    # One untimed round on the smallest tables compiles the code and starts the workers.
    small = os.path.join(os.path.dirname(sf_dir), "sf0.001")
    if os.path.isdir(small) and os.environ.get("BENCH_WARM", "1") == "1":
        for name in wanted:
            QUERIES[name](spark, small).write.format("noop").mode("overwrite").save()
    times = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
