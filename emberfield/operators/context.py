"""Map context of cells: joining, updating, auditing, tile bookkeeping.

Unknown is not zero. A cell whose tile was never queried keeps NULL context
and ``osm_context_available = false``; a queried cell with nothing around has
counts of 0 and the radius as distance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from emberfield.constants import CONTEXT_COUNTS, CONTEXT_FEATURES, LIVE_EVENT_PREFIX
from emberfield.functions.ordered import keep_one
from emberfield.operators.spatial import cells_in_tiles


def unique_by(df: DataFrame, keys: list[str]) -> DataFrame:
    """The same rows, failing at run time when a key occurs twice.

    The check is an aggregate on the key, so a join on that key that follows
    reuses its partitioning; there is no extra pass over the data.
    """
    rest = [c for c in df.columns if c not in keys]
    counted = df.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in rest], F.count(F.lit(1)).alias("_copies")
    )
    message = F.concat(F.lit("duplicate key: "), F.concat_ws(",", *[F.col(k).cast("string") for k in keys]))
    checked = F.when(F.col("_copies") == 1, F.lit(True)).otherwise(
        F.raise_error(message).cast("boolean")
    )
    return counted.where(checked).select(*df.columns)


def assemble(cells: DataFrame, context: DataFrame) -> DataFrame:
    """Complete grid, context where it was queried, NULL elsewhere."""
    left = unique_by(cells.select("grid_id", "lat_grid", "lon_grid"), ["grid_id"])
    right = unique_by(context.select("grid_id", *CONTEXT_FEATURES), ["grid_id"])
    return left.join(right.withColumn("_found", F.lit(True)), "grid_id", "left").select(
        "grid_id",
        "lat_grid",
        "lon_grid",
        *[F.col(c).cast("int").alias(c) for c in CONTEXT_COUNTS],
        F.col("osm_min_distance_m").cast("double").alias("osm_min_distance_m"),
        F.coalesce("_found", F.lit(False)).alias("osm_context_available"),
    )


def matched_population(cells: DataFrame, context: DataFrame) -> DataFrame:
    """Inner one-to-one join of feature rows and context rows."""
    right = unique_by(context.select("grid_id", *CONTEXT_FEATURES), ["grid_id"])
    return unique_by(cells, ["grid_id"]).join(right, "grid_id")


def key_difference(left: DataFrame, right: DataFrame, key: str = "grid_id") -> DataFrame:
    """One row: how many keys are only on one side; equal sets give 0 and 0."""
    sides = (
        left.select(key).distinct().withColumn("_side", F.lit(1))
        .unionByName(right.select(key).distinct().withColumn("_side", F.lit(2)))
        .groupBy(key)
        .agg(F.sum("_side").alias("_seen"))
    )
    return sides.agg(
        F.count_if(F.col("_seen") == 1).alias("only_left"),
        F.count_if(F.col("_seen") == 2).alias("only_right"),
        (F.count_if(F.col("_seen") != 3) == 0).alias("same_keys"),
    )


def is_live_event() -> Column:
    return F.col("event_id").startswith(LIVE_EVENT_PREFIX)


def update_context(events: DataFrame, verified: DataFrame) -> DataFrame:
    """Reset the context of live events, then set it from verified rows.

    Events that did not come from the live feed keep their context.
    """
    fresh = unique_by(verified.select("grid_id", *CONTEXT_FEATURES), ["grid_id"])
    renamed = fresh.select("grid_id", *[F.col(c).alias(f"_new_{c}") for c in CONTEXT_FEATURES])
    joined = events.join(renamed.withColumn("_hit", F.lit(True)), "grid_id", "left")
    changes = {
        c: F.when(is_live_event(), F.col(f"_new_{c}").cast(events.schema[c].dataType)).otherwise(F.col(c))
        for c in CONTEXT_FEATURES
    }
    changes["osm_context_available"] = F.when(
        is_live_event(), F.coalesce("_hit", F.lit(False))
    ).otherwise(F.col("osm_context_available"))
    return joined.withColumns(changes).select(*events.columns)


def _any_context() -> Column:
    out = F.lit(False)
    for c in CONTEXT_FEATURES:
        out = out | F.col(c).isNotNull()
    return out


def _all_context() -> Column:
    out = F.lit(True)
    for c in CONTEXT_FEATURES:
        out = out & F.col(c).isNotNull()
    return out


def provenance_audit(events: DataFrame) -> DataFrame:
    """Live events with verified, without, and with impossible context."""
    live, available = is_live_event(), F.col("osm_context_available")
    return events.agg(
        F.count_if(live).alias("live_total"),
        F.count_if(live & available).alias("verified_osm"),
        F.count_if(live & ~available).alias("osm_unavailable"),
        F.count_if(live & ~available & _any_context()).alias("invalid_unknown_values"),
    )


def integrity_report(assembled: DataFrame, expected_rows: Column) -> DataFrame:
    """Row count kept, ids unique, available means complete, else all NULL."""
    available = F.col("osm_context_available")
    per_id = assembled.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("copies"),
        F.count_if(available & ~_all_context()).alias("incomplete"),
        F.count_if(~available & _any_context()).alias("fabricated"),
    )
    return per_id.agg(
        F.sum("copies").alias("row_count"),
        (F.sum("copies") == expected_rows).alias("row_count_kept"),
        F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("duplicate_ids"),
        F.coalesce(F.sum("incomplete"), F.lit(0)).alias("available_but_missing"),
        F.coalesce(F.sum("fabricated"), F.lit(0)).alias("unavailable_but_present"),
    )


def coverage_summary(assembled: DataFrame) -> DataFrame:
    available = F.col("osm_context_available")
    return assembled.agg(
        F.count(F.lit(1)).alias("cells"),
        F.count_if(available).alias("queried_cells"),
        F.count_if(~available).alias("unqueried_cells"),
        F.count_if(F.col("osm_industrial_count") > 0).alias("industrial_cells"),
        F.count_if(F.col("osm_power_count") > 0).alias("power_cells"),
        F.count_if(F.col("osm_manmade_count") > 0).alias("manmade_cells"),
        F.round(F.avg(F.when(available, 100.0).otherwise(0.0)), 2).alias("overlap_percent"),
    )


# --- tile bookkeeping -----------------------------------------------------


def strongest_per_cell(context: DataFrame) -> DataFrame:
    """Where tiles overlap, keep the row with the most objects."""
    return keep_one(
        context,
        ["grid_id"],
        [F.col("osm_feature_count"), -F.col("osm_min_distance_m"), *CONTEXT_COUNTS[1:]],
        last=True,
    )


def latest_tile_status(manifest: DataFrame) -> DataFrame:
    """The status each tile reported last."""
    return manifest.groupBy("tile_id").agg(
        F.max_by("status", F.struct("timestamp", "status")).alias("status")
    )


def tiles_to_do(tiles: DataFrame, manifest: DataFrame, stored_tiles: DataFrame) -> DataFrame:
    """Tiles not both reported successful last and stored."""
    done = (
        latest_tile_status(manifest)
        .where(F.col("status") == "success")
        .join(stored_tiles.select("tile_id").distinct(), "tile_id", "left_semi")
    )
    return tiles.join(done, "tile_id", "left_anti")


def queried_cells(cells: DataFrame, tiles: DataFrame, manifest: DataFrame) -> DataFrame:
    """Cells lying in tiles whose latest status is success."""
    done = latest_tile_status(manifest).where(F.col("status") == "success")
    return cells_in_tiles(cells, tiles.join(done, "tile_id", "left_semi"))
