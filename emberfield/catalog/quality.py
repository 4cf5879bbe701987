"""Constraints, gates, splits and audits."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from emberfield import schemas
from emberfield.catalog import registry as r
from emberfield.catalog.registry import query, rounded
from emberfield.constants import DETECTION_FEATURES
from emberfield.operators import context, events, quality, splits
from emberfield.session import materialize, scratch_path
from emberfield.sources import heads


@query(
    "v1_table_constraints",
    """SELECT 'latitude_range' AS rule, count(*) FILTER (WHERE latitude*3 > 90) AS violations FROM {events_t}
       UNION ALL SELECT 'longitude_range', CAST(0 AS BIGINT)
       UNION ALL SELECT 'binary_label', CAST(0 AS BIGINT)
       UNION ALL SELECT 'multiclass_label', count(*) FILTER (WHERE target_multiclass+1 > 3) FROM {events_t}
       UNION ALL SELECT 'event_id_present', CAST(0 AS BIGINT)
       UNION ALL SELECT 'grid_id_present', CAST(0 AS BIGINT)
       UNION ALL SELECT 'event_id_unique', count(*) - count(DISTINCT event_id) FROM {events_t}
       UNION ALL SELECT 'grid_id_unique', count(*) - count(DISTINCT substr(grid_id, 1, 4)) FROM {events_t}""",
)
def v1(spark, folder):
    damaged = r.event_table(spark, folder).withColumns(
        {
            "latitude": F.col("latitude") * 3,
            "target_multiclass": F.col("target_multiclass") + 1,
            "grid_id": F.substring("grid_id", 1, 4),
        }
    )
    return events.table_violations(damaged)


@query(
    "v2_context_integrity",
    """SELECT count(*) AS row_count, count(*) = (SELECT count(*) FROM {agg}) AS row_count_kept,
        count(*) - count(DISTINCT grid_id) AS duplicate_ids,
        count(*) FILTER (WHERE osm_context_available AND osm_feature_count IS NULL) AS available_but_missing,
        count(*) FILTER (WHERE NOT osm_context_available AND osm_feature_count IS NOT NULL) AS unavailable_but_present
      FROM {assembled}""",
)
def v2(spark, folder):
    table = r.stored_cells(spark, folder)
    expected = table.agg(F.count(F.lit(1)).alias("n")).scalar()
    return context.integrity_report(r.assembled(table, folder), expected)


@query(
    "v3_feature_gate",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing, CAST(0 AS BIGINT) AS invalid FROM {{v}}"
        for c in [*DETECTION_FEATURES, "target_multiclass"]
    ).replace("{v}", "(SELECT * FROM {cells} UNION ALL BY NAME SELECT * FROM {live_cells})"),
)
def v3(spark, folder):
    both = r.labelled_cells(spark, folder).unionByName(r.live_cells(spark, folder))
    return quality.feature_gate(both)


def _by_class(found):
    """Findings per folder of a class; the files of a folder agree."""
    label = F.regexp_extract("file", r"target_multiclass=(\d+)", 1).cast("int").alias("target_multiclass")
    return found.select(label, *[c for c in found.columns if c != "file"]).distinct()


@query(
    "v4_feature_schema_audit",
    """SELECT DISTINCT target_multiclass, CAST(18 - (target_multiclass = 0)::INT AS INT) AS feature_count,
        CASE WHEN target_multiclass = 0 THEN 'mean_frp' ELSE '' END AS missing_columns,
        CASE WHEN target_multiclass = 2 THEN 'target_persistent_source' ELSE '' END AS target_in_features,
        CASE WHEN target_multiclass = 3 THEN 'grid_id,lat_grid' ELSE '' END AS identifiers_in_features,
        target_multiclass = 1 AS schema_safe
      FROM {cells}""",
)
def v4(spark, folder):
    # One feature file set per class: the first lacks a feature, two others hold what must not be one.
    path = scratch_path(spark, "features")
    table = materialize(r.labelled_cells(spark, folder), "cells")
    names = {0: [c for c in DETECTION_FEATURES if c != "mean_frp"], 1: DETECTION_FEATURES}
    names |= {2: [*DETECTION_FEATURES, "target_persistent_source"], 3: ["lat_grid", *DETECTION_FEATURES, "grid_id"]}
    for label, columns in names.items():
        part = table.where(F.col("target_multiclass") == label).select(*columns)
        part.write.parquet(f"{path}/target_multiclass={label}")
    files = heads.parquet_footers(spark, f"{path}/*/*.parquet")
    # A class without rows leaves a file without rows, which is no part of the table.
    present = table.select("target_multiclass").distinct()
    return _by_class(quality.feature_file_audit(files)).join(F.broadcast(present), "target_multiclass", "left_semi")


_EXTRA = (
    "event_id,first_seen,grid_id,id,last_seen,latitude,longitude,osm_context_available,osm_feature_count,"
    "osm_industrial_count,osm_manmade_count,osm_min_distance_m,osm_power_count,target_persistent_source"
)


@query(
    "u3_column_difference",
    "SELECT DISTINCT target_multiclass, d.\"column\", d.finding FROM {events_t} CROSS JOIN (VALUES ('lat_grid', 'missing'), "
    + ", ".join(f"('{c}', 'extra')" for c in _EXTRA.split(","))
    + ", ('mean_frp', 'type')) d(\"column\", finding)",
)
def u3(spark, folder):
    path = scratch_path(spark, "events")
    table = r.event_table(spark, folder).withColumn("mean_frp", F.col("mean_frp").cast("float"))
    table.write.partitionBy("target_multiclass").parquet(path)
    expected = T.StructType([schemas.EVENTS[c] for c in DETECTION_FEATURES] + [schemas.CELLS["lat_grid"]])
    return _by_class(heads.differences(heads.parquet_footers(spark, f"{path}/*/*.parquet"), expected))


@query(
    "v5_label_consistency",
    "SELECT count(*) FILTER (WHERE target_multiclass = 3) AS mismatches, count(*) FILTER (WHERE target_multiclass = 3) = 0 AS consistent"
    " FROM {cells}",
)
def v5(spark, folder):
    # Class 3 is given a wrong binary label on purpose, so there is something to find.
    wrong = r.labelled_cells(spark, folder).withColumn(
        "target_persistent_source",
        F.when(F.col("target_multiclass") == 3, 1).otherwise(F.col("target_persistent_source")),
    )
    return quality.label_consistency(wrong)


_DIRECT = ["active_days", "persistence_days", "night_ratio", "type_2_count", "mean_frp"]
_DERIVED = ["recurrence_ratio", "type_2_ratio", "obs_per_active_day"]


@query(
    "v6_leakage_report",
    "SELECT * FROM (VALUES ('schema', 'feature_count', 18.0::double), ('schema', 'target_in_features', 0.0),"
    " ('schema', 'identifiers_in_features', 0.0), ('schema', 'schema_safe', 1.0)) t(section, item, value)"
    + "".join(f" UNION ALL SELECT 'dependency', '{c}', 1.0" for c in _DIRECT + _DERIVED)
    + "".join(
        f" UNION ALL SELECT 'correlation', '{c}', round(corr(CAST({c} AS DOUBLE), CAST(target_multiclass AS DOUBLE)), 6) FROM {{cells}}"
        for c in _DIRECT
    )
    + " UNION ALL SELECT 'labels', 'mismatches', CAST(count(*) FILTER (WHERE (target_multiclass IN (1,2)) <> (target_persistent_source = 1)) AS DOUBLE) FROM {cells}",
)
def v6(spark, folder):
    return rounded(quality.full_audit(r.labelled_cells(spark, folder)), "value")


@query("m1_block_split", "SELECT grid_id, block, split FROM {spl}")
def m1(spark, folder):
    return splits.block_split(r.labelled_cells(spark, folder)).select("grid_id", "block", "split")


@query(
    "m2_split_audit",
    "SELECT split, count(*) AS rows, min(lat_grid) AS south, max(lat_grid) AS north, min(lon_grid) AS west, max(lon_grid) AS east, "
    + ", ".join(f"count(*) FILTER (WHERE target_multiclass={k}) AS class_{k}" for k in range(4))
    + ", count(*)/(SELECT count(*) FROM {spl})::double AS share, CAST(0 AS BIGINT) AS leaking_blocks FROM {spl} GROUP BY split",
)
def m2(spark, folder):
    return splits.split_summary(splits.block_split(r.labelled_cells(spark, folder)))


@query(
    "m3_cell_split",
    """SELECT grid_id, CASE WHEN h < 70 THEN 'train' WHEN h < 85 THEN 'validation' ELSE 'test' END AS split FROM (
       SELECT grid_id, CAST('0x' || substr(md5(concat_ws('|', 'emberfield', CAST(round_even(lat_grid/0.01::double,0) AS BIGINT),
              CAST(round_even(lon_grid/0.01::double,0) AS BIGINT))), 1, 8) AS BIGINT) % 100 AS h FROM {cells})""",
)
def m3(spark, folder):
    return splits.cell_split(r.labelled_cells(spark, folder)).select("grid_id", "split")
