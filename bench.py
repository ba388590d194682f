"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: tables (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8);
BENCH_REPEAT: runs of each query, of which the fastest counts (default 2)."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import DataFrame, SparkSession

from treeline import queries as own

HEADLINE = (
    "j1_need_copy", "j4_extra_files", "j7_verify", "h1_file_digest", "a2_class_counts", "r1_split_ranges", "g1_assign_bundles",
    "p5_ancestors", "u1_union", "h5_block_signatures",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(df: DataFrame) -> None:
        df.write.format("noop").mode("overwrite").save()

    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(max(1, int(os.environ.get("BENCH_REPEAT", "2")))):
            began = time.perf_counter()
            run(own.QUERIES[name](spark, sf_dir))
            best = min(best, time.perf_counter() - began)
        took[name] = round(best, 3)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    rates = {n: round(docs / took[n]) for n in ("j1_need_copy", "j4_extra_files", "j7_verify", "h1_file_digest")}
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "rows_per_sec": rates, "sf": os.path.basename(sf_dir)}))
    spark.stop()


if __name__ == "__main__":
    main()
