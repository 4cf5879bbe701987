"""Data profiling: counts, distributions, top cells, calendar gaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.functions import grid, values as v
from emberfield.functions.ordered import exact_quantiles, with_share

PERCENTILES_FRP = [0, 0.50, 0.75, 0.90, 0.95, 0.99, 0.999, 1.0]
PERCENTILES_BRIGHTNESS = [0, 0.01, 0.05, 0.25, 0.50, 0.75, 0.95, 0.99, 1.0]
OBSERVATION_THRESHOLDS = [5, 10, 25, 50, 100, 500, 1000]


def count_by(df: DataFrame, key: str | Column, name: str = "key") -> DataFrame:
    column = F.col(key) if isinstance(key, str) else key
    return df.groupBy(column.alias(name)).agg(F.count(F.lit(1)).alias("n"))


def value_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Counts and shares of each value (NULL included), for several columns.

    Rows are expanded to (column, value) pairs and combined on the map side,
    so the table is scanned once.
    """
    pairs = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    )
    counts = df.select(F.inline(pairs)).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    rows = df.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return counts.withColumn("share", F.col("n") / rows)


def describe(df: DataFrame, columns: list[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per column; quartiles exact."""
    numbers = {c: v.finite_or_null(F.col(c).cast("double")) for c in columns}
    stats = []
    for c, value in numbers.items():
        stats += [
            F.count(value).alias(f"{c}_n"),
            F.avg(value).alias(f"{c}_mean"),
            F.stddev_samp(value).alias(f"{c}_std"),
            F.min(value).alias(f"{c}_min"),
            F.max(value).alias(f"{c}_max"),
        ]
    rows = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(f"{c}_n").alias("count"),
                F.col(f"{c}_mean").alias("mean"),
                F.col(f"{c}_std").alias("std"),
                F.col(f"{c}_min").alias("min"),
                F.col(f"{c}_max").alias("max"),
            )
            for c in columns
        ]
    )
    basic = df.agg(*stats).select(F.inline(rows))
    quartiles = exact_quantiles(df, {c: [0.25, 0.5, 0.75] for c in columns})
    wide = quartiles.groupBy("column").agg(
        F.max(F.when(F.col("share") == 0.25, F.col("value"))).alias("p25"),
        F.max(F.when(F.col("share") == 0.5, F.col("value"))).alias("p50"),
        F.max(F.when(F.col("share") == 0.75, F.col("value"))).alias("p75"),
    )
    # Both sides have one row per described column.
    return basic.join(F.broadcast(wide), "column")


def quality_report(df: DataFrame, date_column: str = "acq_date") -> DataFrame:
    """Rows, missing cells, exact repeats, bad positions, date range."""
    missing = None
    for f in df.schema.fields:
        empty = F.col(f.name).isNull()
        if f.dataType.typeName() in ("double", "float"):
            empty = empty | F.isnan(F.col(f.name))
        missing = v.flag(empty) if missing is None else missing + v.flag(empty)
    # Folding equal rows first gives the repeats and carries every other
    # number along, so the raw rows are read once.
    folded = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    bad = lambda name, limit: F.coalesce(
        F.sum(F.when((F.col(name) < -limit) | (F.col(name) > limit), F.col("_n"))), F.lit(0)
    )
    return folded.agg(
        F.sum("_n").alias("row_count"),
        F.lit(len(df.columns)).cast("bigint").alias("column_count"),
        F.sum(F.col("_n") - 1).alias("exact_duplicates"),
        F.sum(missing * F.col("_n")).alias("missing_cells"),
        bad("latitude", 90).alias("invalid_latitude"),
        bad("longitude", 180).alias("invalid_longitude"),
        F.min(date_column).alias("min_date"),
        F.max(date_column).alias("max_date"),
        F.countDistinct(date_column).alias("unique_dates"),
    )


def missing_summary(df: DataFrame) -> DataFrame:
    """Missing count and percentage per column."""
    empties = []
    for f in df.schema.fields:
        empty = F.col(f.name).isNull()
        if f.dataType.typeName() in ("double", "float"):
            empty = empty | F.isnan(F.col(f.name))
        empties.append(F.count_if(empty).alias(f.name))
    one = df.agg(F.count(F.lit(1)).alias("_rows"), *empties)
    pairs = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.col(c).alias("missing_count"),
                F.round(F.try_divide(F.col(c) * F.lit(100.0), F.col("_rows")), 2).alias("missing_percent"),
            )
            for c in df.columns
        ]
    )
    return one.select(F.inline(pairs))


def dataset_report(cells: DataFrame, target: str = "target_multiclass") -> DataFrame:
    """Structural report of a feature table: repeats, missing and infinite values."""
    numeric = [f.name for f in cells.schema.fields if f.dataType.typeName() in ("double", "float")]
    infinite = F.lit(0)
    for c in numeric:
        infinite = infinite + v.flag(F.abs(F.col(c)) == F.lit(float("inf")))
    missing = F.lit(0)
    for f in cells.schema.fields:
        empty = F.col(f.name).isNull()
        if f.name in numeric:
            empty = empty | F.isnan(F.col(f.name))
        missing = missing + v.flag(empty)
    folded = cells.groupBy(*cells.columns).agg(F.count(F.lit(1)).alias("_n"))
    per_id = folded.groupBy("grid_id").agg(
        F.sum("_n").alias("rows"),
        F.sum(F.col("_n") - 1).alias("repeats"),
        F.sum(missing * F.col("_n")).alias("missing"),
        F.sum(infinite * F.col("_n")).alias("infinite"),
    )
    return per_id.agg(
        F.sum("rows").alias("row_count"),
        F.lit(len(cells.columns)).cast("bigint").alias("column_count"),
        F.sum("repeats").alias("duplicate_rows"),
        F.sum(F.col("rows") - 1).alias("duplicate_grid_ids"),
        F.sum("missing").alias("missing_values"),
        F.sum("infinite").alias("infinite_values"),
    )


def exploration_cell_counts(detections: DataFrame) -> DataFrame:
    """Counts per two-decimal cell; the text key is built after the fold."""
    row = F.rint(F.col("latitude") * F.lit(100.0)).cast("int")
    col = F.rint(F.col("longitude") * F.lit(100.0)).cast("int")
    folded = detections.groupBy(row.alias("_r"), col.alias("_c")).agg(
        F.count(F.lit(1)).alias("observation_count")
    )
    key = grid.grid_key(F.col("_r") / F.lit(100.0), F.col("_c") / F.lit(100.0))
    return folded.select(key.alias("grid_id"), "observation_count")


def top_cells(counts: DataFrame, limit: int) -> DataFrame:
    return counts.orderBy(F.desc("observation_count"), "grid_id").limit(limit)


def rows_in_cells(clean: DataFrame, chosen: DataFrame) -> DataFrame:
    """Detections of a short list of cells.

    The list ends in a ``limit``, so the planner knows its size and sends it to
    the scan side by itself; the detections are filtered where they are read.
    """
    return clean.join(chosen.select("grid_id"), "grid_id", "left_semi")


def cell_persistence(rows: DataFrame) -> DataFrame:
    """Observations, active days, span and activity ratio per cell."""
    per_cell = rows.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.countDistinct(F.to_date("acq_datetime")).alias("active_days"),
        F.min("acq_datetime").alias("first_detection"),
        F.max("acq_datetime").alias("last_detection"),
    )
    elapsed = F.unix_micros(F.col("last_detection").cast("timestamp")) - F.unix_micros(
        F.col("first_detection").cast("timestamp")
    )
    span = F.floor(elapsed / F.lit(86_400_000_000)).cast("int") + F.lit(1)
    return per_cell.withColumn("active_span_days", span).withColumn(
        "activity_ratio", F.col("active_days") / F.col("active_span_days")
    )


def _percent(condition: Column) -> Column:
    return F.avg(F.when(condition, 100.0).otherwise(0.0))


def cell_profile(rows: DataFrame) -> DataFrame:
    """Thermal profile of cells: mean and peak power, shares in percent."""
    return rows.groupBy("grid_id").agg(
        F.count(F.lit(1)).alias("observations"),
        F.countDistinct(F.to_date("acq_datetime")).alias("active_days"),
        F.avg("frp").alias("mean_frp"),
        F.max("frp").alias("max_frp"),
        F.avg("brightness").alias("mean_brightness"),
        _percent(F.col("confidence") == "h").alias("high_confidence"),
        _percent(F.col("type") == 0).alias("type_0_pct"),
        _percent(F.col("type") == 2).alias("type_2_pct"),
        _percent(F.col("daynight") == "D").alias("day_pct"),
    )


def profile_summary(profile: DataFrame) -> DataFrame:
    """Means, and the exact median of active days, over profiled cells."""
    middle = exact_quantiles(profile, {"active_days": [0.5]}).select("value").scalar()
    return profile.agg(
        F.count(F.lit(1)).alias("cells"),
        F.avg("active_days").alias("mean_active_days"),
        F.avg("mean_frp").alias("mean_frp"),
        F.avg("type_2_pct").alias("mean_type_2_pct"),
        F.avg("high_confidence").alias("mean_high_confidence"),
    ).withColumn("median_active_days", middle)


def persistent_candidates(
    persistence: DataFrame, min_active_days: int = 100, min_activity_ratio: float = 0.10
) -> DataFrame:
    return persistence.where(
        (F.col("active_days") >= min_active_days) & (F.col("activity_ratio") >= min_activity_ratio)
    )


def type_shares(rows: DataFrame) -> DataFrame:
    return with_share(count_by(rows, "type", "type")).withColumn(
        "percent", F.round(F.col("share") * 100, 2)
    ).drop("share")


def threshold_counts(counts: DataFrame, thresholds: list[int] = OBSERVATION_THRESHOLDS) -> DataFrame:
    """How many cells reach each observation threshold."""
    one = counts.agg(
        *[F.count_if(F.col("observation_count") >= t).alias(f"t{t}") for t in thresholds]
    )
    pairs = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("cells")) for t in thresholds]
    )
    return one.select(F.inline(pairs))


def zero_share(df: DataFrame, column: str = "frp") -> DataFrame:
    value = F.col(column)
    return df.agg(
        F.count_if(value == 0).alias("zero_rows"),
        F.count_if(value > 0).alias("positive_rows"),
        F.round(_percent(value == 0), 3).alias("zero_percent"),
    )


def distinct_counts(clean: DataFrame) -> DataFrame:
    """Distinct dates, cells, coordinate pairs and sensors.

    One aggregate per count, joined as scalar subqueries: a single aggregate
    with several distinct counts would multiply every row before its shuffle.
    """
    def n(*columns: str) -> Column:
        return clean.select(*columns).distinct().agg(F.count(F.lit(1)).alias("n")).scalar()

    return clean.agg(F.count(F.lit(1)).alias("row_count")).withColumns(
        {
            "dates": n("acq_date"),
            "cells": n("grid_id"),
            "coordinate_pairs": n("latitude", "longitude"),
            "satellites": n("satellite"),
            "instruments": n("instrument"),
        }
    )


def missing_months(df: DataFrame, date_column: str = "acq_date", by: list[str] | None = None) -> DataFrame:
    """Months between the first and the last one that have no rows, of the table or of each group ``by``.

    Months fold first, so a group sorts its months, not its rows; the gap after a month ends before the next one that is there.
    """
    keys = by or []
    seen = df.select(*keys, F.trunc(F.col(date_column), "month").alias("seen")).where("seen IS NOT NULL").distinct()
    following = F.lead("seen").over(Window.partitionBy(*keys).orderBy("seen"))
    gaps = seen.withColumn("following", following).where(F.col("following") > F.add_months("seen", 1))
    step = F.expr("interval 1 month")
    return gaps.select(*keys, F.explode(F.sequence(F.add_months("seen", 1), F.add_months("following", -1), step)).alias("month"))


def extent(df: DataFrame, lat: str = "lat_grid", lon: str = "lon_grid") -> DataFrame:
    return df.agg(
        F.min(lat).alias("south"), F.max(lat).alias("north"),
        F.min(lon).alias("west"), F.max(lon).alias("east"),
    )


def extreme_groups(counts: DataFrame, key: str, limit: int = 10) -> DataFrame:
    """Busiest and quietest groups as one table with a side column."""
    busy = counts.orderBy(F.desc("n"), key).limit(limit).withColumn("side", F.lit("largest"))
    calm = counts.orderBy("n", key).limit(limit).withColumn("side", F.lit("smallest"))
    return busy.unionByName(calm)


def common_window(availability: DataFrame, sources: list[str]) -> DataFrame:
    """Latest start and earliest end over the sources, and whether they are all there."""
    rows = availability.where(F.col("data_id").isin(sources))
    return rows.agg(
        F.max("min_date").alias("start"),
        F.min("max_date").alias("end"),
        F.countDistinct("data_id").alias("sources"),
    ).withColumn(
        "usable", (F.col("sources") == len(sources)) & (F.col("start") <= F.col("end"))
    )
