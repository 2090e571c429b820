"""Times the headline queries and prints one JSON line.  BENCH_SF_DIR: input; BENCH_CPUS: cores."""

from __future__ import annotations

import json
import os
import re
import sys
import time

from pyspark.sql import SparkSession

#: Dashboards, scans, ASOF, high-cardinality groups, LATEST, corrections, windows.
HEADLINE = ("recent_window", "scan_wide", "filter_time_range", "asof_left", "asof_two_steps", "aggregate_high_cardinality", "aggregate_grouped", "aggregate_global", "bucket_hour", "latest_user", "latest_purchase", "order_nulls_limit", "history_as_of", "view_tumbling", "view_sliding", "ohlc_bars", "vwap")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from tidemark.queries import QUERIES

    took = {}
    for name in HEADLINE:
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()  # compiles and warms the files
        best = 1e9
        for _ in range(2):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    sf = re.search(r"sf([\d.]+)", sf_dir)
    print(json.dumps({"metric": "total_seconds_of_headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else None}))


if __name__ == "__main__":
    main()
