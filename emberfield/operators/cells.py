"""Detections to grid cells, features and heuristic labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from emberfield.constants import (
    BINARY_TARGET,
    CANDIDATE_MIN_ACTIVE_DAYS,
    CANDIDATE_MIN_OBSERVATIONS,
    GRID_SIZE,
    TARGET,
)
from emberfield.functions import grid, values as v


def _measures(std) -> list:
    return [
        F.count("latitude").alias("observation_count"),
        F.min("acq_date").alias("first_seen"),
        F.max("acq_date").alias("last_seen"),
        F.countDistinct("acq_date").alias("active_days"),
        F.sum("is_day").alias("day_observations"),
        F.sum("is_night").alias("night_observations"),
        F.avg("frp").alias("mean_frp"),
        F.max("frp").alias("max_frp"),
        std("frp").alias("std_frp"),
        F.avg("brightness").alias("mean_brightness"),
        F.max("brightness").alias("max_brightness"),
        F.avg("bright_t31").alias("mean_bright_t31"),
        F.max("bright_t31").alias("max_bright_t31"),
        F.avg("confidence_score").alias("mean_confidence_score"),
    ]


def _by_cell(df: DataFrame, size: float, measures: list, digits: int | None) -> DataFrame:
    # The exact distinct-day count makes Catalyst aggregate by (cell, day)
    # first and by cell second. Both steps combine on the map side, so a cell
    # with a third of all detections is spread over its days and then folded.
    keyed = df.where("latitude is not null and longitude is not null").withColumns(
        {
            "_row": grid.cell_index(F.col("latitude"), size),
            "_col": grid.cell_index(F.col("longitude"), size),
        }
    )
    lat, lon = grid.index_to_degrees(F.col("_row"), size), grid.index_to_degrees(F.col("_col"), size)
    if digits is not None:
        lat, lon = F.bround(lat, digits), F.bround(lon, digits)
    return (
        keyed.groupBy("_row", "_col")
        .agg(*measures)
        .withColumns({"lat_grid": lat, "lon_grid": lon})
        .withColumn("grid_id", grid.grid_key(F.col("lat_grid"), F.col("lon_grid")))
        .drop("_row", "_col")
    )


def aggregate_archive(df: DataFrame, size: float = GRID_SIZE) -> DataFrame:
    """Archive cell table: sample deviation, type-2 count kept."""
    extra = [F.sum("is_type2").alias("type_2_count")]
    return _by_cell(df, size, _measures(F.stddev_samp) + extra, None)


def _ratios() -> dict:
    span = F.datediff("last_seen", "first_seen") + F.lit(1)
    return {
        "persistence_days": span,
        "recurrence_ratio": F.col("active_days") / span,
        "obs_per_active_day": F.try_divide(F.col("observation_count"), F.col("active_days")),
        "night_ratio": F.try_divide(F.col("night_observations"), F.col("observation_count")),
    }


def derive_archive_features(cells: DataFrame) -> DataFrame:
    """Span, ratios, and zero deviation for single-detection cells."""
    return cells.withColumns(
        {
            "std_frp": F.coalesce(F.col("std_frp"), F.lit(0.0)),
            **_ratios(),
            "type_2_ratio": F.try_divide(F.col("type_2_count"), F.col("observation_count")),
        }
    )


def aggregate_live(df: DataFrame, size: float = GRID_SIZE) -> DataFrame:
    """Live cell table: population deviation, no type field, no labels."""
    cells = _by_cell(df, size, _measures(F.stddev_pop), 4)
    unknown = F.lit(None)
    return cells.withColumns(
        {
            **_ratios(),
            "type_2_count": unknown.cast("bigint"),
            "type_2_ratio": unknown.cast("double"),
            BINARY_TARGET: unknown.cast("int"),
            TARGET: unknown.cast("int"),
        }
    )


def label_cells(cells: DataFrame, rule: v.LabelRule = v.LabelRule()) -> DataFrame:
    """Add the heuristic multiclass label and the binary one derived from it."""
    labelled = cells.withColumn(TARGET, v.multiclass_label(rule))
    return labelled.withColumn(BINARY_TARGET, v.binary_label(F.col(TARGET)))


def build_cells(detections: DataFrame, size: float = GRID_SIZE) -> DataFrame:
    """Prepared archive detections to labelled cells."""
    return label_cells(derive_archive_features(aggregate_archive(detections, size)))


def context_candidates(
    cells: DataFrame,
    min_observations: int = CANDIDATE_MIN_OBSERVATIONS,
    min_active_days: int = CANDIDATE_MIN_ACTIVE_DAYS,
) -> DataFrame:
    """Cells active enough to be worth a map-context lookup."""
    return cells.where(
        (F.col("observation_count") >= min_observations)
        & (F.col("active_days") >= min_active_days)
    )
