"""Live feed: request plan, and incremental ingest of landing files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.streaming.query import StreamingQuery

from emberfield.constants import LIVE_DEDUPE_KEY, MAX_DAYS_PER_REQUEST
from emberfield.functions import grid
from emberfield.operators import cells, events, normalize, spatial
from emberfield.schemas import EVENTS
from emberfield.session import materialize
from emberfield.sinks import store as places


def date_chunks(windows: DataFrame, days: int = MAX_DAYS_PER_REQUEST) -> DataFrame:
    """Split ``(source, start, end)`` windows into requests of at most ``days``."""
    begins = F.sequence("start", "end", F.expr(f"interval {int(days)} day"))
    usable = windows.where(F.col("start") <= F.col("end"))
    return usable.select("source", "end", F.explode(begins).alias("chunk_start")).select(
        "source",
        "chunk_start",
        F.least(F.lit(int(days)), F.datediff("end", "chunk_start") + F.lit(1)).alias("day_range"),
    )


def snapshot_of(detections: DataFrame, shapes: DataFrame | None = None) -> DataFrame:
    """Normalised live detections to event records (the batch form)."""
    clean = normalize.normalize_live(detections)
    if shapes is not None:
        clean = spatial.clip_to_polygons(clean, shapes)
    return events.live_event_records(cells.aggregate_live(clean))


def ingest(
    spark: SparkSession,
    landing: str,
    schema: T.StructType,
    store: str,
    events_root: str,
    checkpoint: str,
    shapes: DataFrame | None = None,
) -> StreamingQuery:
    """Drain the landing folder into clean detections and live events.

    Each micro-batch is cleaned, clipped and appended to the store as a version under its name; the name joins the
    checkpoint's id with the batch number, so a new or lost checkpoint folder, which counts from 0 again, meets no
    stored batch. Then the cells it touched, and only those, are recomputed from their stored detections, and merged
    into the live events: only the rows of tiles that the batch touched are written again. A batch that is replayed
    after a failure appends and merges at most once, so the result is exactly-once. No streaming state
    is kept: repeats across batches meet in the history of their cell. Tile rows of many small files are compacted,
    and versions beyond the last few are deleted.
    """
    raw = spark.readStream.schema(schema).parquet(landing)

    def write(batch: DataFrame, number: int) -> None:
        name = f"{_checkpoint_id(spark, checkpoint)}-{number:09d}"
        clean = normalize.drop_repeats(normalize.drop_incomplete(normalize.coerce_live(batch)))
        if shapes is not None:
            clean = spatial.clip_to_polygons(clean, shapes)
        keyed = _with_place(clean).withColumn("batch", F.lit(name))
        if not places.has_version(spark, store, name):
            places.append(keyed, store, name)
        if places.has_version(spark, events_root, name):
            return
        fresh = live_events_of(touched_history(spark, store, keyed.schema, name))
        places.merge(materialize(fresh, "fresh-events"), events_root, name, "grid_id")
        places.compact(spark, store, keyed.schema, f"compact-{name}")
        for root in (store, events_root):
            places.expire(spark, root)

    return (
        raw.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _checkpoint_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a checkpoint folder when a query first starts in it."""
    return json.loads(spark.read.text(f"{checkpoint}/metadata").first()["value"])["id"]


def _with_place(clean: DataFrame) -> DataFrame:
    """Cell indices, by which the history of a cell is found."""
    return clean.withColumns(
        {"cell_row": grid.cell_index(F.col("latitude")), "cell_col": grid.cell_index(F.col("longitude"))}
    )


def touched_history(spark: SparkSession, store: str, schema: T.StructType, name: str) -> DataFrame:
    """All stored detections of the cells that the named batch touched.

    Only files of the tile rows that the batch touched are read.
    """
    rows = places.versions(spark, store).where((F.col("name") == name) & F.col("file").isNotNull())
    before = places.versions(spark, store).where(F.col("number") < rows.agg(F.max("number")).first()[0]) if not rows.isEmpty() else rows
    own = rows.join(before.select("file").distinct(), "file", "left_anti")
    touched_rows = [r[0] for r in own.select("tile_row").distinct().collect()]
    stored = places.read(spark, store, schema, tile_rows=touched_rows)
    keys = ["cell_row", "cell_col"]
    touched = stored.where(F.col("batch") == name).select(*keys).distinct()
    return stored.join(touched, keys, "left_semi")


def live_events_of(stored: DataFrame) -> DataFrame:
    """Event records of stored clean detections."""
    rows = stored.drop("batch", "cell_row", "cell_col")
    folded = normalize.drop_repeats(rows).withColumns(
        {"brightness": F.col("bright_ti4"), "bright_t31": F.col("bright_ti5")}
    )
    return events.live_event_records(cells.aggregate_live(folded))


def ingested_events(spark: SparkSession, events_root: str) -> DataFrame:
    """The newest published live events; merge them with `replace_snapshot`."""
    return places.read(spark, events_root, EVENTS)


def deduplicated_stream(stream: DataFrame, time_column: str, delay: str = "1 day") -> DataFrame:
    """Drop repeats of a detection key inside the watermark, for push sources."""
    return stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(LIVE_DEDUPE_KEY)
