"""Registration of queries, and the shared input tables they start from."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from emberfield.catalog.check_sql import with_tables
from emberfield.constants import CONTEXT_FEATURES
from emberfield.functions import grid
from emberfield.operators import cells, context, events, normalize, spatial
from emberfield.session import materialize, scratch_path
from emberfield.sinks import store
from emberfield.sources import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` may refer to the tables of ``check_sql``."""

    def register(function):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            # Clock fields are read from timestamps without a zone.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return function(spark, folder)

        QUERIES[name] = run
        if sql is not None:
            CHECKS[name] = with_tables(sql)
        return function

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Round results of order-dependent floating point work for comparison."""
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --- shared inputs --------------------------------------------------------


def archive(spark: SparkSession, folder: str) -> DataFrame:
    return normalize.prepare_archive(views.detections(spark, folder))


def labelled_cells(spark: SparkSession, folder: str) -> DataFrame:
    return cells.build_cells(archive(spark, folder))


def live_clean(spark: SparkSession, folder: str, repeats: bool = True) -> DataFrame:
    return normalize.normalize_live(views.live_detections(spark, folder, repeats))


def live_cells(spark: SparkSession, folder: str) -> DataFrame:
    clipped = spatial.clip_to_polygons(live_clean(spark, folder), views.boundary(spark))
    return cells.aggregate_live(clipped)


def stored_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled cells written once, for queries that need them several times.

    Everything around the map context starts from the cell table; without this
    each use would go back to the detections.
    """
    return materialize(labelled_cells(spark, folder), "cells")


def grid_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Key columns of the archive cells."""
    rows = cells.aggregate_archive(archive(spark, folder))
    return rows.select("grid_id", "lat_grid", "lon_grid", "observation_count", "active_days")


def tiles(cell_table: DataFrame) -> DataFrame:
    return spatial.active_tiles(cell_table, 1)


def manifest(tile_table: DataFrame) -> DataFrame:
    """Outcomes of two extraction runs.

    Even tiles fail first and are tried again a day later; in the end every
    third tile has failed.
    """
    key = (F.floor(F.col("tile_south") / 0.25) + F.floor(F.col("tile_west") / 0.25)).cast("int")
    base = tile_table.withColumn("_key", key)
    final = F.when(F.pmod("_key", F.lit(3)) != 0, "success").otherwise("failed")
    first = F.when(F.pmod("_key", F.lit(2)) == 0, "failed").otherwise(final)

    def rows(df: DataFrame, status, day: str) -> DataFrame:
        return df.select(
            "tile_id",
            F.col("tile_south").alias("south"),
            F.col("tile_west").alias("west"),
            F.col("tile_north").alias("north"),
            F.col("tile_east").alias("east"),
            status.alias("status"),
            F.lit(0).alias("feature_count"),
            F.lit(0).alias("firms_cell_count"),
            F.lit("cache").alias("endpoint"),
            F.lit(day).cast("timestamp").alias("timestamp"),
            F.lit("").alias("error"),
        )

    again = base.where(F.pmod("_key", F.lit(2)) == 0)
    return rows(base, first, "2024-01-01").unionByName(rows(again, final, "2024-01-02"))


def queried(cell_table: DataFrame) -> DataFrame:
    """Archive cells whose tile was extracted."""
    tile_table = tiles(cell_table)
    return context.queried_cells(cell_table, tile_table, manifest(tile_table))


def context_table(cell_table: DataFrame, folder: str) -> DataFrame:
    objects = views.map_objects(cell_table.sparkSession, folder)
    return spatial.radius_context(queried(cell_table), objects)


def assembled(cell_table: DataFrame, folder: str) -> DataFrame:
    return context.assemble(cell_table, context_table(cell_table, folder))


def cells_with_context(cell_table: DataFrame, folder: str) -> DataFrame:
    joined = assembled(cell_table, folder).drop("lat_grid", "lon_grid")
    return cell_table.join(joined, "grid_id")


def event_table(spark: SparkSession, folder: str) -> DataFrame:
    """Archive events with context; every third one poses as a live event."""
    return events_of(stored_cells(spark, folder), folder)


def event_store(spark: SparkSession, folder: str) -> str:
    """The event table, stored by place."""
    root = scratch_path(spark, "event-store")
    store.rewrite(event_table(spark, folder), root, "1")
    return root


def events_of(cell_table: DataFrame, folder: str) -> DataFrame:
    rows = cells_with_context(cell_table, folder)
    place = grid.cell_index(F.col("lat_grid")) + grid.cell_index(F.col("lon_grid"))
    prefix = F.when(F.pmod(place, F.lit(3)) == 0, "firms-").otherwise("hist-")
    return events.archive_event_records(rows, prefix)


def matched(spark: SparkSession, folder: str) -> DataFrame:
    """Labelled cells that have context, for the experiments."""
    table = stored_cells(spark, folder)
    return context.matched_population(
        table, context_table(table, folder).select("grid_id", *CONTEXT_FEATURES)
    )


def rule_predictions(spark: SparkSession, folder: str) -> DataFrame:
    """A fixed rule in the place of a model, so metrics have an exact check."""
    return with_rule(labelled_cells(spark, folder))


def with_rule(cell_table: DataFrame) -> DataFrame:
    days = F.col("active_days")
    guess = F.when(days >= 10, 2).when(days >= 4, 1).when(days <= 2, 0).otherwise(3)
    return cell_table.withColumns(
        {
            "label": F.col("target_multiclass"),
            "prediction": guess,
            "score": days / (days + F.lit(1.0)),
        }
    )
