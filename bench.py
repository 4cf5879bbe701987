"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR and BENCH_CPUS choose the data and the number of local cores.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from emberfield.catalog import QUERIES

HEADLINE = [
    "a1_cell_aggregate",
    "p14_multiclass_label",
    "p5_normalize_live",
    "p8_clip_to_boundary",
    "j1_radius_context",
    "j2_nearest_context",
    "j3_assemble_context",
    "j11_nearby_events",
    "k2_snapshot_replace",
    "a3_event_statistics",
    "a6_top_cell_persistence",
    "a10_exact_percentiles",
    "a11_quality_report",
    "a12_counts_per_day_month_hour",
    "a15_distinct_counts",
    "a18_macro_scores",
    "a20_area_under_curves",
    "w3_drop_repeats",
    "w4_tile_sample",
    "m2_split_audit",
    "m9_softprob_boosting",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # Run folders go below it; the session deletes its own when it ends.
    scratch = os.environ.get("BENCH_SCRATCH", f"/tmp/emberfield-bench-{os.getpid()}")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("emberfield-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", f"file://{scratch}")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One warm-up query, so that the first number is not the JVM start.
    QUERIES["a22_geographic_extent"](spark, folder).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        started = time.time()
        # The no-op sink runs the whole plan without moving rows to the driver.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - started, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_wall_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
