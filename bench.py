"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))
#: A query is not run again once its runs took so long.
MOST_SECONDS = 60
HEADLINE = ("q02_command_counts", "q07_busy_periods", "q12_io_usage", "q15_locks_contention_summary", "q20_worst_offenders", "x11_blocked_and_blocking", "l06_intervals", "m13_totals", "g05_topk_rate", "c01_process", "y04_proxy_totals")


def main() -> None:
    from pyspark.sql import SparkSession

    from timberline.plans.registry import QUERIES

    builder = SparkSession.builder.master(f"local[{CPUS}]").config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
    spark = builder.config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        runs: list[float] = []
        while len(runs) <= RUNS and (len(runs) < 2 or sum(runs) < MOST_SECONDS):  # the first compiles
            began = time.perf_counter()
            QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "headline queries, total of medians", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
