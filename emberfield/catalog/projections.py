"""Projections, filters, predicates, sorts and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.catalog import registry as r
from emberfield.catalog.registry import query, rounded
from emberfield.catalog.sources import EVENT_SQL, _ROUND
from emberfield.constants import DISPLAY_CLASS_LABELS, FEATURE_SETS
from emberfield.functions import grid, values as v
from emberfield.operators import cells, events, normalize, quality, spatial, splits
from emberfield.schemas import EVENTS
from emberfield.session import scratch_path
from emberfield.sinks import store
from emberfield.sources import views


@query(
    "p1_coercion",
    "SELECT latitude, longitude, frp, TRY_CAST(confidence AS DOUBLE) AS confidence_number, acq_date FROM {live_rep}",
)
def p1(spark, folder):
    raw = views.live_detections(spark, folder, repeats=True)
    as_text = raw.select(*[F.col(c).cast("string").alias(c) for c in raw.columns])
    return normalize.coerce_live(as_text).select(
        "latitude", "longitude", "frp", v.to_number(F.col("confidence")).alias("confidence_number"), "acq_date"
    )


@query("p2a_confidence_archive", "SELECT confidence, confidence_score FROM {prep}")
def p2a(spark, folder):
    return r.archive(spark, folder).select("confidence", "confidence_score")


@query("p2b_confidence_live", "SELECT confidence, confidence_score FROM {live_coerced}")
def p2b(spark, folder):
    raw = views.live_detections(spark, folder, repeats=True)
    return normalize.coerce_live(raw).select("confidence", "confidence_score")


@query(
    "p3_day_night_type_flags",
    "SELECT 'archive' AS feed, daynight, is_day, is_night, is_type2 FROM {prep}"
    " UNION ALL SELECT 'live', daynight, is_day, is_night, NULL FROM {live_coerced}",
)
def p3(spark, folder):
    old = r.archive(spark, folder).select(
        F.lit("archive").alias("feed"), "daynight", "is_day", "is_night", "is_type2"
    )
    live = normalize.coerce_live(views.live_detections(spark, folder, repeats=True))
    return old.unionByName(
        live.select(
            F.lit("live").alias("feed"), "daynight", "is_day", "is_night",
            F.lit(None).cast("int").alias("is_type2"),
        )
    )


@query(
    "p4_drop_incomplete",
    "SELECT latitude, longitude, acq_date, acq_time, confidence_score FROM {live_coerced}"
    " WHERE confidence_score IS NOT NULL AND frp IS NOT NULL",
)
def p4(spark, folder):
    raw = views.live_detections(spark, folder, repeats=True)
    return normalize.drop_incomplete(normalize.coerce_live(raw)).select(
        "latitude", "longitude", "acq_date", "acq_time", "confidence_score"
    )


@query(
    "p5_normalize_live",
    "SELECT latitude, longitude, acq_date, acq_time, satellite, frp, source_dataset, brightness, bright_t31,"
    " confidence_score, is_day, is_night FROM {live_norm}",
)
def p5(spark, folder):
    return r.live_clean(spark, folder).select(
        "latitude", "longitude", "acq_date", "acq_time", "satellite", "frp", "source_dataset",
        "brightness", "bright_t31", "confidence_score", "is_day", "is_night",
    )


@query(
    "p6a_grid_snap",
    "SELECT latitude, longitude, lat_grid, lon_grid, round_even(lat_grid, 4) AS lat_grid4,"
    " round_even(lon_grid, 4) AS lon_grid4 FROM {prep}",
)
def p6a(spark, folder):
    lat, lon = grid.snap(F.col("latitude")), grid.snap(F.col("longitude"))
    return views.detections(spark, folder).select(
        "latitude", "longitude", lat.alias("lat_grid"), lon.alias("lon_grid"),
        F.bround(lat, 4).alias("lat_grid4"), F.bround(lon, 4).alias("lon_grid4"),
    )


@query("p6b_grid_snap_two_decimals", "SELECT latitude, longitude, lat_grid, lon_grid FROM {clean}")
def p6b(spark, folder):
    return views.detections(spark, folder).select(
        "latitude", "longitude",
        grid.snap_by_decimals(F.col("latitude")).alias("lat_grid"),
        grid.snap_by_decimals(F.col("longitude")).alias("lon_grid"),
    )


@query("p7_grid_key", "SELECT grid_id, CAST(sum(observation_count) AS BIGINT) AS n FROM {agg} GROUP BY grid_id")
def p7(spark, folder):
    key = grid.grid_key(grid.snap(F.col("latitude")), grid.snap(F.col("longitude")))
    return views.detections(spark, folder).groupBy(key.alias("grid_id")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "p8_clip_to_boundary",
    "SELECT latitude, longitude, acq_date, acq_time, satellite, frp FROM {live_clip}",
)
def p8(spark, folder):
    clipped = spatial.clip_to_polygons(r.live_clean(spark, folder), views.boundary(spark))
    return clipped.select("latitude", "longitude", "acq_date", "acq_time", "satellite", "frp")




@query(
    "p9_tile_key_and_bounds",
    """SELECT grid_id, printf('%.6f_%.6f', tr*0.25::double, tc*0.25::double) AS tile_id,
       tr*0.25::double AS south, tc*0.25::double AS west, (tr+1)*0.25::double AS north, (tc+1)*0.25::double AS east,
       round(tr*0.25::double - 2000.0::double/111320.0::double, 6) AS grown_south,
       round(tc*0.25::double - 2000.0::double/(111320.0::double*cos(radians(tr*0.25::double+0.125::double))), 6) AS grown_west,
       round((tr+1)*0.25::double + 2000.0::double/111320.0::double, 6) AS grown_north,
       round((tc+1)*0.25::double + 2000.0::double/(111320.0::double*cos(radians(tr*0.25::double+0.125::double))), 6) AS grown_east
    FROM {tile_of}""",
)
def p9(spark, folder):
    lat, lon = F.col("lat_grid"), F.col("lon_grid")
    bounds = grid.tile_bounds(lat, lon)
    grown = grid.grow_bounds(bounds, 2000.0)
    return r.grid_cells(spark, folder).select(
        "grid_id", grid.tile_key(lat, lon).alias("tile_id"),
        *[c.alias(n) for n, c in bounds.items()],
        *[F.round(c, 6).alias(f"grown_{n}") for n, c in grown.items()],
    )


@query(
    "p10_cells_in_tiles",
    "SELECT grid_id, printf('%.6f_%.6f', tr*0.25::double, tc*0.25::double) AS tile_id FROM {tile_of}",
)
def p10(spark, folder):
    table = r.stored_cells(spark, folder)
    rows = spatial.cells_in_tiles(table, r.tiles(table))
    return rows.select("grid_id", "tile_id")


@query(
    "p11_active_tiles",
    "SELECT DISTINCT tile_id, tile_south, tile_west, tile_north, tile_east FROM {tiles}"
    " WHERE (tr, tc) IN (SELECT (tr, tc) FROM {tile_of} WHERE observation_count >= 5)",
)
def p11(spark, folder):
    return spatial.active_tiles(r.grid_cells(spark, folder), 5)


@query("p12_block_key", "SELECT grid_id, block FROM {spl}")
def p12(spark, folder):
    return r.grid_cells(spark, folder).select(
        "grid_id", grid.block_key(F.col("lat_grid"), F.col("lon_grid")).alias("block")
    )


@query(
    "p13_derived_ratios",
    "SELECT grid_id, persistence_days, recurrence_ratio, obs_per_active_day, night_ratio, type_2_ratio,"
    " round(std_frp, 6) AS std_frp FROM {derived}",
)
def p13(spark, folder):
    rows = cells.derive_archive_features(cells.aggregate_archive(r.archive(spark, folder)))
    return rounded(
        rows.select(
            "grid_id", "persistence_days", "recurrence_ratio", "obs_per_active_day", "night_ratio",
            "type_2_ratio", "std_frp",
        ),
        "std_frp",
    )


@query("p14_multiclass_label", "SELECT grid_id, target_multiclass FROM {cells}")
def p14(spark, folder):
    return r.labelled_cells(spark, folder).select("grid_id", "target_multiclass")


@query(
    "p15_binary_label",
    "SELECT grid_id, target_persistent_source, CAST(type_2_count > 0 OR (active_days >= 5 AND persistence_days >= 30"
    " AND night_ratio >= 0.3::double) AS INT) AS documented_rule FROM {cells}",
)
def p15(spark, folder):
    return r.labelled_cells(spark, folder).select(
        "grid_id", "target_persistent_source", v.documented_binary_label().alias("documented_rule")
    )


@query("p16a_map_category_flags", "SELECT osm_id, industrial, power, manmade FROM {objects}")
def p16a(spark, folder):
    rows = spatial.with_category_flags(views.map_objects(spark, folder))
    return rows.select("osm_id", "industrial", "power", "manmade")


@query(
    "p16b_map_single_category",
    "SELECT osm_id, CASE WHEN power THEN 'power' WHEN industrial THEN 'industrial' WHEN manmade THEN 'man_made'"
    " ELSE 'other' END AS category FROM {objects}",
)
def p16b(spark, folder):
    return spatial.with_single_category(views.map_objects(spark, folder)).select("osm_id", "category")


# Coordinates reach ten million metres: compared to the millimetre, because the
# engines' own rounding differs in the last digits of a double.
@query(
    "p17_web_mercator",
    "SELECT osm_id, round(6378137.0::double*radians(longitude), 3) AS x,"
    " round(6378137.0::double*ln(tan(pi()/4+radians(latitude)/2)), 3) AS y FROM {objects}",
)
def p17(spark, folder):
    rows = spatial.with_projection(views.map_objects(spark, folder))
    return rounded(rows.select("osm_id", "x", "y"), "x", "y", digits=3)


@query(
    "p18_relevant_objects",
    "SELECT osm_id, latitude, longitude FROM {objects} WHERE (industrial OR power OR manmade)"
    " AND latitude BETWEEN 10.0 AND 30.0 AND longitude BETWEEN 70.0 AND 90.0",
)
def p18(spark, folder):
    box = {"south": 10.0, "north": 30.0, "west": 70.0, "east": 90.0}
    return spatial.relevant_objects(views.map_objects(spark, folder), box).select("osm_id", "latitude", "longitude")


@query(
    "p19_hotspot_list_filter",
    "SELECT event_id, grid_id, active_days, target_persistent_source FROM {events_t}"
    " WHERE active_days >= 3 AND target_persistent_source = 1"
    " ORDER BY active_days DESC, observation_count DESC, grid_id LIMIT 10000",
)
def p19(spark, folder):
    rows = events.list_hotspots(r.event_table(spark, folder), 3, True, 10_000)
    return rows.select("event_id", "grid_id", "active_days", "target_persistent_source")


@query(
    "p20_lookup_by_id",
    f"SELECT {EVENT_SQL} FROM {{events_t}} WHERE id = (SELECT max(id) FROM {{events_t}})",
)
def p20(spark, folder):
    cell_table = r.stored_cells(spark, folder)
    root = scratch_path(spark, "event-store")
    store.rewrite(r.events_of(cell_table, folder), root, "1")
    key = cell_table.agg(
        F.max(grid.lattice_id(F.col("lat_grid"), F.col("lon_grid"))).alias("id")
    ).first()["id"]
    table = store.read(spark, root, EVENTS, events.key_box(key))
    return rounded(events.find_hotspot(table, key), *_ROUND)


@query(
    "p21_text_and_class_search",
    "SELECT event_id, grid_id, target_multiclass FROM {events_t}"
    " WHERE contains(lower(event_id), 'hist-2') AND target_multiclass = 3",
)
def p21(spark, folder):
    rows = events.search_events(r.event_table(spark, folder), " HIST-2 ", "3")
    return rows.select("event_id", "grid_id", "target_multiclass")


@query(
    "p22_map_selection",
    "SELECT grid_id, active_days, target_persistent_source FROM {cells}"
    " WHERE active_days >= 2 AND target_persistent_source = 1 ORDER BY grid_id LIMIT 500",
)
def p22(spark, folder):
    rows = events.map_selection(r.labelled_cells(spark, folder), 2, True)
    return rows.select("grid_id", "active_days", "target_persistent_source")


_FEATURE_SETS_SQL = " UNION ALL ".join(
    "SELECT '{0}' AS feature_set, CAST({1} AS INT) AS features, CAST(count(*) AS BIGINT) AS complete_rows,"
    " round(sum({2}), 4) AS total FROM {{cells}} c LEFT JOIN (SELECT * EXCLUDE (lat_grid, lon_grid) FROM {{ctx}}) x"
    " USING (grid_id) WHERE {3}".format(
        name, len(names),
        " + ".join(f"CAST({n} AS DOUBLE)" for n in names if n not in ("std_frp", "osm_min_distance_m")),
        " AND ".join(f"{n} IS NOT NULL" for n in names),
    )
    for name, names in FEATURE_SETS.items()
)


@query("p23_feature_sets", _FEATURE_SETS_SQL)
def p23(spark, folder):
    table = r.cells_with_context(r.stored_cells(spark, folder), folder)
    out = None
    for name, names in FEATURE_SETS.items():
        rows = quality.feature_matrix(table, name).na.drop(subset=names)
        summed = [F.col(n) for n in names if n not in ("std_frp", "osm_min_distance_m")]
        total = summed[0]
        for c in summed[1:]:
            total = total + c
        one = rows.agg(F.count(F.lit(1)).alias("complete_rows"), F.round(F.sum(total), 4).alias("total")).select(
            F.lit(name).alias("feature_set"), F.lit(len(names)).alias("features"), "complete_rows", "total"
        )
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "p24_range_rules",
    """SELECT grid_id, CASE WHEN shifted > 90 THEN 'latitude' ELSE '' END
         || CASE WHEN shifted > 90 AND night > 1 THEN ',' ELSE '' END
         || CASE WHEN night > 1 THEN 'night_ratio' ELSE '' END AS broken
       FROM (SELECT grid_id, round_even(lat_grid,4)*3 AS shifted, night_ratio*2 AS night FROM {cells})""",
)
def p24(spark, folder):
    rows = r.labelled_cells(spark, folder).select(
        "grid_id", (F.bround("lat_grid", 4) * 3).alias("latitude"), F.col("lon_grid").alias("longitude"),
        "observation_count", "active_days", "persistence_days", (F.col("night_ratio") * 2).alias("night_ratio"),
        "mean_frp", "max_frp",
    )
    return events.with_violations(rows).select("grid_id", F.array_join("violations", ",").alias("broken"))


@query(
    "p25_request_merge",
    """SELECT CASE WHEN lat_i % 3 = 0 THEN grid_id WHEN lat_i % 3 = 1 THEN concat('ev-', grid_id) ELSE grid_id END AS event_id,
         grid_id, round_even(lat_grid,4) AS lat_grid, round_even(lon_grid,4) AS lon_grid,
         CASE WHEN lat_i % 2 = 0 THEN mean_frp + 1 ELSE mean_frp END AS mean_frp,
         CAST(active_days AS DOUBLE) AS active_days
       FROM (SELECT *, CAST(round_even(lat_grid/0.01::double,0) AS BIGINT) AS lat_i FROM {cells})""",
)
def p25(spark, folder):
    row = grid.cell_index(F.col("lat_grid"))
    rows = r.labelled_cells(spark, folder)
    nested = F.when(
        row % 2 == 0, F.create_map(F.lit("mean_frp"), F.col("mean_frp") + F.lit(1.0))
    )
    requests = rows.select(
        F.when(row % 3 == 1, F.concat(F.lit("ev-"), "grid_id")).alias("event_id"),
        F.when(row % 3 == 0, F.col("grid_id")).alias("grid_id"),
        F.bround("lat_grid", 4).alias("latitude"),
        F.bround("lon_grid", 4).alias("longitude"),
        "mean_frp", "active_days",
        nested.alias("features"),
    )
    names = ["latitude", "longitude", "mean_frp", "active_days"]
    return events.merge_request_features(requests, names).drop("latitude", "longitude")


@query(
    "p26_context_candidates",
    "SELECT grid_id, observation_count, active_days FROM {cells} WHERE observation_count >= 3 AND active_days >= 2",
)
def p26(spark, folder):
    return cells.context_candidates(r.labelled_cells(spark, folder)).select(
        "grid_id", "observation_count", "active_days"
    )


_TEXT = " ".join(f"WHEN {k} THEN '{t}'" for k, t in DISPLAY_CLASS_LABELS.items())


@query(
    "p27_class_text_and_identity",
    f"""SELECT event_id AS identity, CASE target_multiclass {_TEXT} ELSE 'Not classified' END AS classification_text
        FROM (SELECT event_id, target_multiclass FROM {{events_t}}
              UNION ALL SELECT event_id, target_multiclass FROM {{live_events}})""",
)
def p27(spark, folder):
    live = events.live_event_records(r.live_cells(spark, folder))
    rows = r.event_table(spark, folder).unionByName(live)
    return events.with_display_text(rows).select("identity", "classification_text")


@query(
    "p28_acquisition_time",
    "SELECT acq_date, acq_time, CAST(acq_time//100 AS INT) AS acq_hour, CAST(acq_time%100 AS INT) AS acq_minute,"
    " acq_time//100 BETWEEN 0 AND 23 AND acq_time%100 BETWEEN 0 AND 59 AS valid_time, acq_datetime FROM {clean}",
)
def p28(spark, folder):
    return normalize.with_clock(views.detections(spark, folder)).select(
        "acq_date", "acq_time", "acq_hour", "acq_minute", "valid_time", "acq_datetime"
    )


# --- sorts, limits, top lists ---------------------------------------------


@query(
    "t1_hotspot_order",
    "SELECT grid_id, active_days, observation_count FROM {events_t}"
    " ORDER BY coalesce(target_persistent_source,0) DESC, active_days DESC, observation_count DESC, grid_id LIMIT 1500",
)
def t1(spark, folder):
    rows = events.list_hotspots(r.event_table(spark, folder))
    return rows.select("grid_id", "active_days", "observation_count")


@query(
    "t3_extreme_detections",
    "SELECT latitude, longitude, brightness, bright_t31, frp, confidence, daynight, acq_date, acq_time, type FROM {det}"
    " ORDER BY frp DESC, acq_date, acq_time, latitude, longitude, brightness, bright_t31 LIMIT 20",
)
def t3(spark, folder):
    return (
        views.detections(spark, folder)
        .select("latitude", "longitude", "brightness", "bright_t31", "frp", "confidence", "daynight",
                "acq_date", "acq_time", "type")
        .orderBy(F.desc("frp"), "acq_date", "acq_time", "latitude", "longitude", "brightness", "bright_t31")
        .limit(20)
    )


@query(
    "t4_top_cells",
    "SELECT grid_id, observation_count FROM {top50}",
)
def t4(spark, folder):
    from emberfield.operators import profile

    return profile.top_cells(profile.exploration_cell_counts(views.detections(spark, folder)), 50)


@query(
    "t6_first_tiles",
    "SELECT tile_id, tile_south, tile_west FROM {tiles} ORDER BY tile_south, tile_west LIMIT 25",
)
def t6(spark, folder):
    return spatial.first_tiles(r.tiles(r.grid_cells(spark, folder)), 25).select("tile_id", "tile_south", "tile_west")


@query(
    "t7_pick_list",
    "SELECT grid_id, target_persistent_source, active_days FROM {cells}"
    " ORDER BY target_persistent_source DESC, active_days DESC, grid_id LIMIT 100",
)
def t7(spark, folder):
    return events.pick_list(r.labelled_cells(spark, folder))


# --- set operations -------------------------------------------------------


@query(
    "u1_union_sources",
    "SELECT source_dataset, satellite, latitude, longitude, acq_date, acq_time FROM {live_raw}",
)
def u1(spark, folder):
    rows = views.live_detections(spark, folder)
    frames = {
        s: rows.where(F.col("source_dataset") == s).drop("source_dataset") for s in ("VIIRS_A", "VIIRS_B")
    }
    return normalize.union_sources(frames).select(
        "source_dataset", "satellite", "latitude", "longitude", "acq_date", "acq_time"
    )


@query(
    "u2_split_overlap",
    "SELECT CAST((SELECT count(*) FROM (SELECT block FROM {spl} WHERE split='train' INTERSECT"
    " SELECT block FROM {spl} WHERE split='validation')) AS BIGINT) AS shared_by_block,"
    " CAST((SELECT count(*) FROM (SELECT block FROM {spl} GROUP BY block"
    " HAVING count(DISTINCT CAST(round_even(lat_grid/0.01::double,0) AS BIGINT) % 3) > 1)) AS BIGINT) AS shared_by_row",
)
def u2(spark, folder):
    table = splits.block_split(r.labelled_cells(spark, folder))
    # A split by row instead of by place: the audit must see shared blocks.
    by_row = table.withColumn("split", F.pmod(grid.cell_index(F.col("lat_grid")), F.lit(3)))
    n = lambda df, name: splits.shared_blocks(df).agg(F.count(F.lit(1)).alias(name))
    return n(table, "shared_by_block").withColumn("shared_by_row", n(by_row, "x").scalar())


@query(
    "u4_development_rows",
    "SELECT grid_id, split FROM {spl} WHERE split IN ('train', 'validation')",
)
def u4(spark, folder):
    table = splits.block_split(r.labelled_cells(spark, folder))
    return splits.development(table).select("grid_id", "split")


@query("u5_distinct_pairs", "SELECT DISTINCT latitude, longitude FROM {det}")
def u5(spark, folder):
    return views.detections(spark, folder).select("latitude", "longitude").distinct()
