"""File scans and sinks: each query writes a derived table and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield import schemas
from emberfield.catalog import registry as r
from emberfield.catalog.registry import query, rounded
from emberfield.constants import DETECTION_FEATURES
from emberfield.functions import grid
from emberfield.operators import events, metrics, normalize
from emberfield.session import materialize, scratch_path
from emberfield.sinks import tables as sinks
from emberfield.sources import files, views

_DET = (
    "latitude, longitude, acq_date, daynight, type, confidence, frp, brightness, bright_t31"
)


@query(
    "s1_archive_csv_scan",
    f"SELECT {_DET}, is_day, is_night, is_type2, confidence_score FROM {{prep}}",
)
def s1(spark, folder):
    path = scratch_path(spark, "archive")
    columns = [f.name for f in schemas.ARCHIVE_DETECTIONS.fields]
    sinks.write_csv(views.detections(spark, folder).select(*columns), path)
    flags = ["is_day", "is_night", "is_type2", "confidence_score"]
    return files.archive_detections(spark, path).select(*_DET.split(", "), *flags)


_CELL_COLUMNS = ", ".join(
    f"round({c}, 6) AS {c}" if c == "std_frp" else c for c in DETECTION_FEATURES
)


@query(
    "s2_cell_table_scan",
    f"SELECT grid_id, lat_grid, lon_grid, {_CELL_COLUMNS}, target_multiclass,"
    " target_persistent_source FROM {cells}",
)
def s2(spark, folder):
    path = scratch_path(spark, "cells")
    columns = [f.name for f in schemas.CELLS.fields]
    sinks.write_csv(r.labelled_cells(spark, folder).select(*columns), path)
    rows = files.cell_table(spark, path)
    keep = ["grid_id", "lat_grid", "lon_grid", *DETECTION_FEATURES, "target_multiclass", "target_persistent_source"]
    return rounded(rows.select(*keep), "std_frp")


_CTX = (
    "grid_id, osm_feature_count, osm_industrial_count, osm_power_count,"
    " osm_manmade_count, round(osm_min_distance_m, 6) AS osm_min_distance_m"
)
_CTX_NAMES = [
    "grid_id", "osm_feature_count", "osm_industrial_count", "osm_power_count",
    "osm_manmade_count", "osm_min_distance_m",
]


def _write_tile_files(rows, path):
    """Context as CSV files, one folder per row of tiles."""
    south = grid.tile_edge(F.col("lat_grid")).alias("south")
    (
        rows.select("*", south)
        .repartition("south")
        .write.mode("append")
        .partitionBy("south")
        .option("header", True)
        .csv(path)
    )


@query("s3a_context_tiles_strict", f"SELECT {_CTX} FROM {{ctx}}")
def s3a(spark, folder):
    path = scratch_path(spark, "tiles")
    _write_tile_files(r.context_table(r.stored_cells(spark, folder), folder), path)
    return rounded(files.context_tiles(spark, f"{path}/*/*.csv").select(*_CTX_NAMES), "osm_min_distance_m")


@query("s3b_context_tiles_per_file", f"SELECT {_CTX} FROM {{ctx}}")
def s3b(spark, folder):
    path = scratch_path(spark, "tiles")
    _write_tile_files(r.context_table(r.stored_cells(spark, folder), folder), path)
    rows = files.context_tiles(spark, f"{path}/*/*.csv", per_file=True)
    return rounded(rows.select(*_CTX_NAMES), "osm_min_distance_m")


@query(
    "s3c_context_tiles_lenient",
    f"SELECT {_CTX.replace('osm_feature_count', 'osm_feature_count + 1 AS osm_feature_count', 1)} FROM {{ctx}}"
    " WHERE grid_id IN (SELECT grid_id FROM {cells} WHERE active_days >= 2)",
)
def s3c(spark, folder):
    path = scratch_path(spark, "tiles")
    table = r.stored_cells(spark, folder)
    rows = materialize(r.context_table(table, folder), "context")
    _write_tile_files(rows, f"{path}/a")
    newer = rows.withColumn("osm_feature_count", F.col("osm_feature_count") + F.lit(1))
    _write_tile_files(newer, f"{path}/b")
    # A file that lacks the context columns must be skipped, not fail the scan.
    sinks.write_csv(table.select("grid_id", "lat_grid"), f"{path}/c/short")
    wanted = table.where("active_days >= 2")
    rows = files.context_tiles_lenient(spark, f"{path}/*/*/*.csv", wanted)
    return rounded(rows.select(*_CTX_NAMES), "osm_min_distance_m")


@query(
    "s4_grid_scan",
    "SELECT grid_id, lat_grid, lon_grid, CAST(observation_count AS DOUBLE) AS observation_count FROM {agg}",
)
def s4(spark, folder):
    path = scratch_path(spark, "grid")
    columns = ["grid_id", "lat_grid", "lon_grid", "observation_count"]
    sinks.write_csv(r.grid_cells(spark, folder).select(*columns), path)
    return files.grid_scan(spark.read.csv(path, header=True))


_OSM_KIND = "CASE WHEN p_partkey % 3 = 0 THEN 'node' WHEN p_partkey % 3 = 1 THEN 'way' ELSE 'relation' END"


@query(
    "s5_map_elements_json",
    f"SELECT concat({_OSM_KIND}, ':', p_partkey) AS osm_id, latitude, longitude, industrial, power, manmade"
    " FROM {objects} o JOIN part p ON o.osm_id = concat('node:', p.p_partkey)"
    " WHERE p_partkey % 3 = 0 OR p_partkey % 11 <> 0",
)
def s5(spark, folder):
    path = scratch_path(spark, "elements")
    objects = views.map_objects(spark, folder).withColumn(
        "k", F.element_at(F.split("osm_id", ":"), 2).cast("bigint")
    )
    kind = F.when(F.col("k") % 3 == 0, "node").when(F.col("k") % 3 == 1, "way").otherwise("relation")
    node = F.col("k") % 3 == 0
    center = F.when(
        ~node & (F.col("k") % 11 != 0),
        F.struct(F.col("latitude").alias("lat"), F.col("longitude").alias("lon")),
    )
    element = F.struct(
        kind.alias("type"), F.col("k").alias("id"),
        F.when(node, F.col("latitude")).alias("lat"), F.when(node, F.col("longitude")).alias("lon"),
        center.alias("center"), F.col("tags"),
    )
    # Each document holds its element twice, as overlapping requests do.
    documents = objects.select(F.to_json(F.struct(F.array(element, element).alias("elements"))))
    documents.write.text(path)
    parsed = files.parse_elements(files.map_elements(spark, path, one_document_per_file=False))
    from emberfield.operators.spatial import with_category_flags

    return with_category_flags(parsed).drop("tags")


@query(
    "s6_boundary_scan",
    """WITH RECURSIVE n AS (SELECT n_nationkey AS k FROM nation WHERE n_name = 'NATION_7' OR n_nationkey = 12),
    ring AS (SELECT k, s.i, k + (CASE WHEN s.i IN (1,2) THEN 2.0::double ELSE 0.0::double END) AS x,
                    k + (CASE WHEN s.i IN (2,3) THEN 1.0::double ELSE 0.0::double END) AS y
             FROM n, (VALUES (0),(1),(2),(3)) s(i))
    SELECT a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2, CAST(0 AS INT) AS ring_no
    FROM ring a JOIN ring b ON a.k = b.k AND b.i = (a.i + 3) % 4""",
)
def s6(spark, folder):
    path = scratch_path(spark, "boundary")
    k = F.col("n_nationkey").cast("double")
    corners = [(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)]
    ring = F.array(*[F.array(k + F.lit(dx), k + F.lit(dy)) for dx, dy in corners])
    odd = F.col("n_nationkey") % 2 == 1
    kind = F.when(odd, "Polygon").otherwise("MultiPolygon")
    head = F.format_string(
        '{"type":"Feature","properties":{"ISO_A3":"n%02d","name":" %s "},"geometry":{"type":"%s","coordinates":',
        F.col("n_nationkey"), F.initcap("n_name"), kind,
    )
    one, many = F.to_json(F.array(ring)), F.to_json(F.array(F.array(ring)))
    feature = F.concat(head, F.when(odd, one).otherwise(many), F.lit("}}"))
    nations = spark.read.parquet(f"{folder}/nation.parquet")
    nations.select(F.concat(F.lit('{"features":['), feature, F.lit("]}"))).write.text(path)
    from emberfield.operators.spatial import polygon_edges

    shapes = files.boundary_shapes(spark, path, "N12", "nation_7", one_document_per_file=False)
    return polygon_edges(shapes).select("x1", "y1", "x2", "y2", F.col("ring_no").cast("int").alias("ring_no"))


@query(
    "s7_landing_csv",
    "SELECT latitude, longitude, bright_ti4, bright_ti5, acq_date, acq_time, satellite, frp, daynight,"
    " confidence_score, is_day, is_night FROM {live_coerced}",
)
def s7(spark, folder):
    path = scratch_path(spark, "landing")
    raw = views.live_detections(spark, folder, repeats=True).drop("source_dataset")
    sinks.write_csv(raw, path)
    landed = files.landing_csv(spark, path).withColumn("source_dataset", F.lit("landing"))
    return normalize.coerce_live(landed).select(
        "latitude", "longitude", "bright_ti4", "bright_ti5", "acq_date",
        F.col("acq_time").cast("int").alias("acq_time"), "satellite", "frp", "daynight",
        "confidence_score", "is_day", "is_night",
    )


@query(
    "s8_newest_snapshot",
    "SELECT grid_id, observation_count FROM {live_cells}",
)
def s8(spark, folder):
    path = scratch_path(spark, "snapshots")
    fresh = materialize(events.live_event_records(r.live_cells(spark, folder)), "live")
    sinks.publish_snapshot(fresh.where("observation_count > 1"), path, "2024-01-15")
    sinks.publish_snapshot(fresh, path, "2024-01-30")
    rows = spark.read.schema(schemas.EVENTS).parquet(sinks.newest_snapshot(spark, path))
    return rows.select("grid_id", F.col("observation_count").cast("bigint").alias("observation_count"))


_EVENT_COLUMNS = [f.name for f in schemas.EVENTS.fields]
_ROUND = {"std_frp", "osm_min_distance_m"}
EVENT_SQL = ", ".join(f"round({c}, 6) AS {c}" if c in _ROUND else c for c in _EVENT_COLUMNS)


@query(
    "s9_event_table_scan",
    f"SELECT {EVENT_SQL}, mean_brightness AS brightness, mean_confidence_score AS confidence FROM {{events_t}}",
)
def s9(spark, folder):
    path = scratch_path(spark, "events")
    sinks.write_event_table(r.event_table(spark, folder), path, "1")
    return rounded(files.event_table(spark, path), *_ROUND)


@query(
    "s10_manifest_scan",
    "SELECT tile_id, south, west, north, east, status FROM {manifest}",
)
def s10(spark, folder):
    path = scratch_path(spark, "manifest")
    # Nothing has been written yet: the scan gives an empty table.
    rows = files.tile_manifest(spark, path).unionByName(r.manifest(r.tiles(r.grid_cells(spark, folder))))
    sinks.append_manifest(rows, path)
    return files.tile_manifest(spark, path).select("tile_id", "south", "west", "north", "east", "status")


# --- sinks ----------------------------------------------------------------


@query(
    "k1_atomic_tile_write",
    f"SELECT {_CTX}, printf('%.6f_%.6f', floor(lat_grid/0.25::double)*0.25::double,"
    " floor(lon_grid/0.25::double)*0.25::double) AS tile_id FROM {ctx}",
)
def k1(spark, folder):
    path = scratch_path(spark, "context")
    rows = materialize(r.context_table(r.stored_cells(spark, folder), folder), "context")
    sinks.write_context_tiles(rows, path)
    # Writing some tiles again replaces those tiles and keeps their neighbours.
    sinks.write_context_tiles(rows.where("lat_grid >= 20 and lon_grid < 85"), path)
    return rounded(sinks.stored_tiles(spark, path).select(*_CTX_NAMES, "tile_id"), "osm_min_distance_m")


@query(
    "k2_snapshot_replace",
    f"""SELECT {EVENT_SQL} FROM (
    SELECT * FROM {{events_t}} WHERE event_id NOT LIKE 'firms-%'
       AND grid_id NOT IN (SELECT grid_id FROM {{live_events}})
    UNION ALL BY NAME SELECT * FROM {{live_events}})""",
)
def k2(spark, folder):
    path = scratch_path(spark, "events")
    sinks.publish_snapshot(r.event_table(spark, folder), path, "1")
    current = spark.read.schema(schemas.EVENTS).parquet(sinks.newest_snapshot(spark, path))
    fresh = events.live_event_records(r.live_cells(spark, folder))
    sinks.publish_snapshot(events.replace_snapshot(current, fresh), path, "2")
    done = spark.read.schema(schemas.EVENTS).parquet(sinks.newest_snapshot(spark, path))
    return rounded(done.select(*_EVENT_COLUMNS), *_ROUND)


@query(
    "k3_manifest_append",
    "SELECT status, CAST(count(*) AS BIGINT) AS n, min(south) AS south, max(east) AS east FROM {manifest} GROUP BY status",
)
def k3(spark, folder):
    path = scratch_path(spark, "manifest")
    rows = r.manifest(r.tiles(r.grid_cells(spark, folder)))
    for day in ("2024-01-01", "2024-01-02"):
        sinks.append_manifest(rows.where(F.col("timestamp") == F.lit(day).cast("timestamp")), path)
    return (
        files.tile_manifest(spark, path)
        .groupBy("status")
        .agg(F.count(F.lit(1)).alias("n"), F.min("south").alias("south"), F.max("east").alias("east"))
    )


@query(
    "k4_report_json",
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM {per_class}",
)
def k4(spark, folder):
    path = scratch_path(spark, "report")
    report = metrics.class_report(r.rule_predictions(spark, folder))
    sinks.write_report(report, path)
    return rounded(spark.read.schema(report.schema).json(path), "precision", "recall", "f1")


@query(
    "k6_live_event_records",
    f"SELECT {EVENT_SQL} FROM {{live_events}}",
)
def k6(spark, folder):
    return rounded(events.live_event_records(r.live_cells(spark, folder)), *_ROUND)


@query("k7_clean_detections", "SELECT * FROM {clean}")
def k7(spark, folder):
    return normalize.clean_detections(views.detections(spark, folder))
