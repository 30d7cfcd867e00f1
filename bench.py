"""Times headline queries; prints one JSON line.

Each query is run to completion (every output row is produced and discarded).
The figure is the better of two runs, so class loading is not counted.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from catalog import QUERIES

HEADLINE = [
    "s1_csv_scan",
    "c1_dedupe_counted",
    "c2_infer_numeric",
    "c6_fill_auto",
    "c11_ffill",
    "c16_iqr_clip",
    "c17_iqr_remove",
    "e4_label",
    "e4_label_wide",
    "e5_frequency_wide",
    "j1_lookup",
    "f2_hour",
    "f4_identifiers",
    "a8_quantiles_by_counting",
    "a9_correlation",
    "p7_numeric",
    "p9_top5",
    "v3_histogram",
    "x0c_clean",
    "x1_prepare_orders",
]


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("millrace-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )


if __name__ == "__main__":
    main()
