"""The live feed: request plan and drained ingest."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.catalog.registry import query, rounded
from emberfield.catalog.sources import EVENT_SQL, _ROUND
from emberfield.session import scratch_path
from emberfield.sources import views
from emberfield.streaming import live


@query(
    "st1_date_chunks",
    """SELECT source_dataset AS source, CAST(lo + CAST(5*i AS INT) AS DATE) AS chunk_start,
         CAST(least(5, date_diff('day', lo + CAST(5*i AS INT), hi) + 1) AS INT) AS day_range
       FROM (SELECT source_dataset, min(acq_date) AS lo, max(acq_date) AS hi FROM {live_raw} GROUP BY 1), range(100000) t(i)
       WHERE lo + CAST(5*i AS INT) <= hi""",
)
def st1(spark, folder):
    windows = views.live_detections(spark, folder).groupBy(F.col("source_dataset").alias("source")).agg(
        F.min("acq_date").alias("start"), F.max("acq_date").alias("end")
    )
    return live.date_chunks(windows)


@query("st2_live_ingest", f"SELECT {EVENT_SQL} FROM {{live_events}}")
def st2(spark, folder):
    root = scratch_path(spark, "feed")
    raw = views.live_detections(spark, folder, repeats=True)
    # Two deliveries that overlap, so the second one touches cells of the first.
    for part in (raw.where("acq_time < 1300"), raw.where("acq_time >= 1200")):
        part.write.mode("append").parquet(f"{root}/landing")
        running = live.ingest(
            spark, f"{root}/landing", raw.schema, f"{root}/store", f"{root}/events",
            f"{root}/offsets", views.boundary(spark),
        )
        running.awaitTermination()
    return rounded(live.ingested_events(spark, f"{root}/events"), *_ROUND)
