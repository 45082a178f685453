"""Times the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from terrarow.plans.registry import QUERIES

#: One query of each kind of work: windows, grouping sets, spatial joins, graph rounds, kernels, cells, tables.
HEADLINE = ("gap_report", "gap_targets", "gap_clusters", "row_numbering", "proportional_allocation", "weighted_vote", "percentiles", "robust_line", "orientation_histogram", "linked_segments", "distance_join", "box_overlaps", "nearest_cascade", "strip_pairs", "cell_pyramid", "filled_cells", "box_suppression", "simplified_rows", "latest_raster", "ring_measures", "walk_visits")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["gap_report"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the JVM's compiler
    times = {}
    for name in HEADLINE:
        began = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - began, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf_dir.rstrip("/").rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
