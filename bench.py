"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the cores. All queries run twice to warm up, so that none
pays for compiling what they share, and then three times each; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from tessera import queries as relational

HEADLINE = (
    "tpch_q1 tpch_q3 tpch_q4 tpch_q5 tpch_q6 tpch_q7 tpch_q8 tpch_q10 tpch_q13 tpch_q14 tpch_q15 tpch_q17 tpch_q18 tpch_q19 tpch_q21 tpch_q22 "
    "scan_pk_range topk agg_group agg_distinct_multi join_multiway join_star join_left filter_not_exists set_except vec_topk"
).split()

WARM_UPS, TIMED = 2, 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    every = relational.queries()
    runs: dict[str, list[float]] = {name: [] for name in HEADLINE}
    for _ in range(WARM_UPS + TIMED):
        for name in HEADLINE:
            began = time.perf_counter()
            every[name](spark, folder).write.format("noop").mode("overwrite").save()
            runs[name].append(time.perf_counter() - began)
    took = {name: round(statistics.median(times[WARM_UPS:]), 4) for name, times in runs.items()}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
