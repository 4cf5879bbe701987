"""End-to-end flows over stored tables: build, extract context, go live, enrich."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberfield import schemas
from emberfield.constants import RADIUS_M
from emberfield.operators import cells, context, events, normalize, spatial
from emberfield.session import materialize
from emberfield.sinks import store, tables as sinks
from emberfield.sources import files


def build_cell_table(spark: SparkSession, archive: str, root: str, version: str) -> DataFrame:
    """Archive CSV files to a published table of labelled cells."""
    built = cells.build_cells(files.archive_detections(spark, archive))
    columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in schemas.CELLS.fields]
    sinks.publish_snapshot(built.select(*columns), root, version)
    return stored_cells(spark, root)


def stored_cells(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(schemas.CELLS).parquet(sinks.newest_snapshot(spark, root))


def extract_context(
    cell_table: DataFrame,
    objects: DataFrame,
    tiles_root: str,
    manifest_path: str,
    min_observations: int,
    max_tiles: int | None = None,
    sample_size: int | None = None,
    radius_m: float = RADIUS_M,
) -> int:
    """Context of all active tiles that are not done yet; returns their number.

    A tile is done when its latest manifest status is success and its context
    is stored, so an interrupted run continues where it stopped. All pending
    tiles are computed by one distributed join instead of a loop over tiles.
    """
    spark = cell_table.sparkSession
    tiles = spatial.active_tiles(cell_table, min_observations)
    if sample_size is not None:
        tiles = spatial.sample_tiles(tiles, sample_size)
    elif max_tiles is not None:
        tiles = spatial.first_tiles(tiles, max_tiles)
    manifest = files.tile_manifest(spark, manifest_path)
    stored = sinks.stored_tile_ids(spark, tiles_root)
    todo = materialize(context.tiles_to_do(tiles, manifest, stored), "todo")
    count = todo.count()
    if count == 0:
        return 0

    pending = cell_table.select("grid_id", "lat_grid", "lon_grid")
    pending = materialize(spatial.cells_in_tiles(pending, todo), "pending")
    wanted = spatial.relevant_objects(objects)
    sinks.write_context_tiles(
        spatial.radius_context(pending, wanted, radius_m), tiles_root
    )

    found = spatial.objects_per_tile(wanted, radius_m).withColumnRenamed("n", "feature_count")
    held = pending.groupBy("tile_id").agg(F.count(F.lit(1)).alias("firms_cell_count"))
    rows = todo.join(found, "tile_id", "left").join(held, "tile_id", "left").select(
        "tile_id",
        F.col("tile_south").alias("south"),
        F.col("tile_west").alias("west"),
        F.col("tile_north").alias("north"),
        F.col("tile_east").alias("east"),
        F.lit("success").alias("status"),
        F.coalesce("feature_count", F.lit(0)).alias("feature_count"),
        F.coalesce("firms_cell_count", F.lit(0)).alias("firms_cell_count"),
        F.lit("map_objects").alias("endpoint"),
        F.current_timestamp().alias("timestamp"),
        F.lit("").alias("error"),
    )
    sinks.append_manifest(rows, manifest_path)
    return count


def assemble_context(cell_table: DataFrame, tiles_root: str) -> DataFrame:
    """Complete grid with stored context; cells of other tiles stay unknown."""
    stored = sinks.stored_tiles(cell_table.sparkSession, tiles_root)
    return context.assemble(cell_table, stored)


def refresh_live_events(
    raw: DataFrame, shapes: DataFrame, events_root: str, version: str
) -> DataFrame:
    """Replace the live part of the event table by a fresh download."""
    spark = raw.sparkSession
    clean = spatial.clip_to_polygons(normalize.normalize_live(raw), shapes)
    fresh = events.live_event_records(cells.aggregate_live(clean))
    if store.has_version(spark, events_root):
        fresh = events.replace_snapshot(_events(spark, events_root), fresh)
    sinks.write_event_table(fresh, events_root, version)
    return _events(spark, events_root)


def enrich_events(spark: SparkSession, events_root: str, tiles_root: str, version: str) -> DataFrame:
    """Set the context of live events from stored tiles, then audit the result."""
    updated = context.update_context(_events(spark, events_root), sinks.stored_tiles(spark, tiles_root))
    sinks.write_event_table(updated, events_root, version)
    table = _events(spark, events_root)
    audit = context.provenance_audit(table).first()
    if audit["invalid_unknown_values"]:
        raise RuntimeError("events without context carry context values")
    return table


def _events(spark: SparkSession, events_root: str) -> DataFrame:
    return store.read(spark, events_root, schemas.EVENTS)
