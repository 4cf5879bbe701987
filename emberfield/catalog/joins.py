"""Joins and window-type operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from emberfield.catalog import registry as r
from emberfield.catalog.registry import query, rounded
from emberfield.functions import grid
from emberfield.functions.ordered import keep_one
from emberfield.operators import context, events, metrics, profile, spatial
from emberfield.schemas import EVENTS
from emberfield.sinks import store
from emberfield.sources import views

_CTX_ALL = (
    "grid_id, lat_grid, lon_grid, osm_feature_count, osm_industrial_count, osm_power_count,"
    " osm_manmade_count, round(osm_min_distance_m, 6) AS osm_min_distance_m"
)


@query("j1_radius_context", f"SELECT {_CTX_ALL} FROM {{ctx}}")
def j1(spark, folder):
    return rounded(r.context_table(r.stored_cells(spark, folder), folder), "osm_min_distance_m")


@query(
    "j2_nearest_context",
    """SELECT q.grid_id, CAST(count(DISTINCT n.osm_id) AS INT) AS osm_feature_count,
         CAST(count(*) FILTER (WHERE n.cat='industrial') AS INT) AS osm_industrial_count,
         CAST(count(*) FILTER (WHERE n.cat='power') AS INT) AS osm_power_count,
         CAST(count(*) FILTER (WHERE n.cat='man_made') AS INT) AS osm_manmade_count,
         round(coalesce(min(n.dist), 2000.0::double), 6) AS osm_min_distance_m
       FROM {queried} q LEFT JOIN (
         SELECT *, CASE WHEN power THEN 'power' WHEN industrial THEN 'industrial' WHEN manmade THEN 'man_made' ELSE 'other' END AS cat
         FROM (SELECT *, rank() OVER (PARTITION BY grid_id ORDER BY dist) AS rk FROM {pairs}) WHERE rk = 1) n USING (grid_id)
       GROUP BY q.grid_id""",
)
def j2(spark, folder):
    table = r.stored_cells(spark, folder)
    rows = spatial.nearest_context(r.queried(table), views.map_objects(spark, folder))
    return rounded(rows.drop("lat_grid", "lon_grid"), "osm_min_distance_m")


@query("j3_assemble_context", f"SELECT {_CTX_ALL}, osm_context_available FROM {{assembled}}")
def j3(spark, folder):
    return rounded(r.assembled(r.stored_cells(spark, folder), folder), "osm_min_distance_m")


@query(
    "j4_matched_population",
    "SELECT c.grid_id, target_multiclass, active_days, osm_feature_count FROM {cells} c JOIN {ctx} x USING (grid_id)",
)
def j4(spark, folder):
    return r.matched(spark, folder).select("grid_id", "target_multiclass", "active_days", "osm_feature_count")


@query(
    "j5_semi_join_ids",
    "SELECT grid_id, observation_count FROM {live_cells} WHERE grid_id IN (SELECT grid_id FROM {cells})",
)
def j5(spark, folder):
    live = r.live_cells(spark, folder).select("grid_id", "observation_count")
    return live.join(r.grid_cells(spark, folder).select("grid_id"), "grid_id", "left_semi")


@query(
    "j6_key_set_equality",
    "SELECT CAST((SELECT count(*) FROM (SELECT grid_id FROM {cells} EXCEPT SELECT grid_id FROM {ctx})) AS BIGINT) AS only_left,"
    " CAST((SELECT count(*) FROM (SELECT grid_id FROM {ctx} EXCEPT SELECT grid_id FROM {cells})) AS BIGINT) AS only_right,"
    " (SELECT count(*) FROM {cells}) = (SELECT count(*) FROM {ctx}) AS same_keys",
)
def j6(spark, folder):
    table = r.stored_cells(spark, folder)
    return context.key_difference(table, r.context_table(table, folder))


@query(
    "j7_points_in_polygons",
    "SELECT grid_id, observation_count FROM {inside_cells}",
)
def j7(spark, folder):
    inside = spatial.clip_to_polygons(
        r.grid_cells(spark, folder), views.boundary(spark), "lat_grid", "lon_grid"
    )
    return inside.select("grid_id", "observation_count")


@query(
    "j8_align_context_by_key",
    "SELECT c.grid_id, observation_count, round(std_frp, 6) AS std_frp, osm_feature_count,"
    " round(osm_min_distance_m, 6) AS osm_min_distance_m FROM {cells} c JOIN {ctx} x USING (grid_id)"
    " WHERE osm_industrial_count + osm_power_count + osm_manmade_count >= 0",
)
def j8(spark, folder):
    rows = r.matched(spark, folder).select(
        "grid_id", "observation_count", "std_frp", "osm_feature_count", "osm_min_distance_m"
    )
    return rounded(rows, "std_frp", "osm_min_distance_m")


def _rule_results(spark, folder):
    """Three rules of one input, scored like three experiments."""
    table = r.labelled_cells(spark, folder)
    days = F.col("active_days")
    out = None
    for experiment, cut in (("full", 4), ("reduced", 5), ("reduced_context", 7)):
        guess = F.when(days >= 10, 2).when(days >= cut, 1).when(days <= 2, 0).otherwise(3)
        rows = table.select(F.col("target_multiclass").alias("label"), guess.alias("prediction"))
        one = metrics.summary_metrics(rows).select(
            F.lit(experiment).alias("experiment"), F.lit("rule").alias("model"), "macro_f1",
            "balanced_accuracy", F.lit(float(cut)).alias("training_seconds"),
        )
        out = one if out is None else out.unionByName(one)
    return out


def rule_result_sql(experiment: str, cut: int) -> str:
    per_class = " UNION ALL ".join(
        f"SELECT count(*) FILTER (WHERE label={k}) AS n, count(*) FILTER (WHERE guess={k}) AS g,"
        f" count(*) FILTER (WHERE label={k} AND guess={k}) AS h FROM r{cut}"
        for k in range(4)
    )
    return (
        f"SELECT '{experiment}' AS experiment, 'rule' AS model,"
        " avg(CASE WHEN n+g > 0 THEN 2*h/(n+g)::double END) AS macro_f1,"
        " avg(CASE WHEN n > 0 THEN h/n::double END) AS balanced_accuracy,"
        f" {cut}.0::double AS training_seconds FROM (WITH r{cut} AS (SELECT target_multiclass AS label,"
        f" CASE WHEN active_days>=10 THEN 2 WHEN active_days>={cut} THEN 1 WHEN active_days<=2 THEN 0 ELSE 3 END AS guess"
        f" FROM {{cells}}) {per_class})"
    )


RESULTS_SQL = " UNION ALL ".join(
    rule_result_sql(e, c) for e, c in (("full", 4), ("reduced", 5), ("reduced_context", 7))
)


@query(
    "j9_experiment_comparison",
    f"""SELECT f.model, round(f.macro_f1,6) AS full_macro_f1, round(f.balanced_accuracy,6) AS full_balanced_accuracy,
        round(x.macro_f1,6) AS reduced_macro_f1, round(x.balanced_accuracy,6) AS reduced_balanced_accuracy,
        round(o.macro_f1,6) AS reduced_osm_macro_f1, round(o.balanced_accuracy,6) AS reduced_osm_balanced_accuracy,
        round(x.macro_f1-f.macro_f1,6) AS macro_f1_change_after_leakage_reduction,
        round(x.balanced_accuracy-f.balanced_accuracy,6) AS balanced_accuracy_change_after_leakage_reduction,
        round(o.macro_f1-x.macro_f1,6) AS macro_f1_osm_delta,
        round(o.balanced_accuracy-x.balanced_accuracy,6) AS balanced_accuracy_osm_delta
    FROM ({rule_result_sql('full', 4)}) f JOIN ({rule_result_sql('reduced', 5)}) x USING (model)
    JOIN ({rule_result_sql('reduced_context', 7)}) o USING (model)""",
)
def j9(spark, folder):
    rows = metrics.compare_experiments(_rule_results(spark, folder))
    return rounded(rows, *[c for c in rows.columns if c != "model"])


@query(
    "j10_update_context",
    """SELECT e.event_id, e.grid_id,
        CASE WHEN e.event_id LIKE 'firms-%' THEN v.grid_id IS NOT NULL ELSE e.osm_context_available END AS osm_context_available,
        CASE WHEN e.event_id LIKE 'firms-%' THEN v.osm_feature_count ELSE e.osm_feature_count END AS osm_feature_count,
        CASE WHEN e.event_id LIKE 'firms-%' THEN v.osm_power_count ELSE e.osm_power_count END AS osm_power_count,
        round(CASE WHEN e.event_id LIKE 'firms-%' THEN v.osm_min_distance_m ELSE e.osm_min_distance_m END, 6) AS osm_min_distance_m
      FROM {events_t} e LEFT JOIN (SELECT * FROM {ctx} WHERE osm_feature_count > 0 OR lat_grid < 20) v USING (grid_id)""",
)
def j10(spark, folder):
    table = r.stored_cells(spark, folder)
    verified = r.context_table(table, folder).where("osm_feature_count > 0 or lat_grid < 20")
    rows = context.update_context(r.events_of(table, folder), verified)
    return rounded(
        rows.select("event_id", "grid_id", "osm_context_available", "osm_feature_count", "osm_power_count",
                    "osm_min_distance_m"),
        "osm_min_distance_m",
    )


# A dense place of the derived tables, and the widest radius that is allowed.
_LAT, _LON, _RADIUS = 29.19, 89.79, 100_000.0


def _geodesic_sql(lat: str, lon: str) -> str:
    f = "(1/298.257223563::double)"
    b1, b2 = f"atan((1-{f})*tan(radians({lat})))", f"atan((1-{f})*tan(radians({_LAT}::double)))"
    return f"""SELECT *, CASE WHEN s=0 THEN 0.0::double ELSE 6378137.0::double*(s-{f}/2*(
        (s-sin(s))*pow(sin(p),2)*pow(cos(q),2)/pow(cos(s/2),2) + (s+sin(s))*pow(cos(p),2)*pow(sin(q),2)/pow(sin(s/2),2))) END AS distance_m
      FROM (SELECT *, (b1+b2)/2 AS p, (b2-b1)/2 AS q,
              2*asin(sqrt(pow(sin((b2-b1)/2),2)+cos(b1)*cos(b2)*pow(sin(dl/2),2))) AS s
            FROM (SELECT *, {b1} AS b1, {b2} AS b2, radians({_LON}::double)-radians({lon}) AS dl FROM {{events_t}}))"""


_NEARBY_SQL = (
    f"SELECT grid_id, latitude, longitude, round(distance_m, 4) AS distance_m FROM ({_geodesic_sql('latitude', 'longitude')})"
    f" WHERE distance_m <= {_RADIUS} ORDER BY distance_m, grid_id LIMIT "
)


def _nearby(spark, folder, limit):
    events.check_search(_LAT, _LON, _RADIUS)
    table = store.read(spark, r.event_store(spark, folder), EVENTS, grid.search_box(_LAT, _LON, _RADIUS))
    rows = spatial.nearby(table, _LAT, _LON, _RADIUS, limit)
    return rounded(rows.select("grid_id", "latitude", "longitude", "distance_m"), "distance_m", digits=4)


@query("j11_nearby_events", _NEARBY_SQL + "10000")
def j11(spark, folder):
    return _nearby(spark, folder, 10_000)


@query("t2_nearest_first", _NEARBY_SQL + "500")
def t2(spark, folder):
    return _nearby(spark, folder, 500)


@query(
    "j12_missing_months",
    """WITH m AS (SELECT DISTINCT CAST(round_even(latitude/0.01::double, 0) AS INT) AS cell_row,
              CAST(round_even(longitude/0.01::double, 0) AS INT) AS cell_col, CAST(date_trunc('month', acq_date) AS DATE) AS month
            FROM {det} WHERE acq_date IS NOT NULL AND latitude IS NOT NULL AND longitude IS NOT NULL),
          n AS (SELECT *, lead(month) OVER (PARTITION BY cell_row, cell_col ORDER BY month) AS following FROM m)
       SELECT cell_row, cell_col, CAST(x AS DATE) AS month FROM (
          SELECT cell_row, cell_col, unnest(generate_series(month + INTERVAL 1 MONTH, following - INTERVAL 1 MONTH, INTERVAL 1 MONTH)) AS x
          FROM n WHERE following > month + INTERVAL 1 MONTH)""",
)
def j12(spark, folder):
    rows = views.detections(spark, folder).select(
        grid.cell_index(F.col("latitude")).alias("cell_row"), grid.cell_index(F.col("longitude")).alias("cell_col"), "acq_date"
    )
    return profile.missing_months(rows.na.drop(), by=["cell_row", "cell_col"])


@query(
    "j13_tiles_to_do",
    "SELECT tile_id, tile_south, tile_west FROM {tiles} WHERE NOT ((tr+tc)%3 <> 0 AND (tr+tc)%5 <> 0)",
)
def j13(spark, folder):
    tile_table = r.tiles(r.stored_cells(spark, folder))
    key = (F.floor(F.col("tile_south") / 0.25) + F.floor(F.col("tile_west") / 0.25)).cast("int")
    stored = tile_table.where(F.pmod(key, F.lit(5)) != 0)
    todo = context.tiles_to_do(tile_table, r.manifest(tile_table), stored)
    return todo.select("tile_id", "tile_south", "tile_west")


@query(
    "j14_event_report",
    "SELECT event_id, target_multiclass, CASE WHEN active_days >= 2 THEN 'Class ' || active_days END AS classification,"
    " CASE WHEN active_days >= 2 THEN active_days/(active_days+1.0::double) END AS model_score FROM {events_t}",
)
def j14(spark, folder):
    table = r.event_table(spark, folder)
    scored = table.where("active_days >= 2").select(
        "event_id",
        F.concat(F.lit("Class "), F.col("active_days").cast("string")).alias("classification"),
        (F.col("active_days") / (F.col("active_days") + F.lit(1.0))).alias("model_score"),
        F.lit("rule").alias("model_version"),
    )
    report = events.event_reports(table, scored)
    return report.select("event_id", "target_multiclass", "classification", "model_score")


# --- window-type operators ------------------------------------------------


@query(
    "w1_strongest_per_cell",
    """SELECT grid_id, osm_feature_count, round(osm_min_distance_m, 6) AS osm_min_distance_m FROM (
         SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY osm_feature_count DESC, osm_min_distance_m) AS rn FROM (
           SELECT grid_id, osm_feature_count, osm_min_distance_m FROM {ctx}
           UNION ALL
           SELECT q.grid_id, CAST(count(p.osm_id) AS INT), coalesce(min(p.dist), 1500.0::double)
           FROM {queried} q LEFT JOIN (SELECT * FROM {pairs} WHERE dist <= 1500.0::double) p USING (grid_id) GROUP BY 1))
       WHERE rn = 1""",
)
def w1(spark, folder):
    table = r.stored_cells(spark, folder)
    near = spatial.radius_context(r.queried(table), views.map_objects(spark, folder), 1500.0)
    both = r.context_table(table, folder).unionByName(near)
    rows = context.strongest_per_cell(both).select("grid_id", "osm_feature_count", "osm_min_distance_m")
    return rounded(rows, "osm_min_distance_m")


@query(
    "w2_latest_tile_status",
    "SELECT tile_id, status FROM (SELECT *, max(timestamp) OVER (PARTITION BY tile_id) AS last FROM {manifest})"
    " WHERE timestamp = last",
)
def w2(spark, folder):
    return context.latest_tile_status(r.manifest(r.tiles(r.stored_cells(spark, folder))))


@query(
    "w3_drop_repeats",
    """SELECT 'first' AS kept, concat_ws('|', latitude, longitude, acq_time, satellite) AS k, bright_ti4 FROM {live_norm}
       UNION ALL
       SELECT 'last', CAST(user_id AS VARCHAR), CAST(value AS DOUBLE) FROM (
         SELECT user_id, value, lead(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events)
       WHERE nxt IS NULL""",
)
def w3(spark, folder):
    first = r.live_clean(spark, folder).select(
        F.lit("first").alias("kept"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in ("latitude", "longitude", "acq_time", "satellite")]).alias("k"),
        "bright_ti4",
    )
    stream = spark.read.parquet(f"{folder}/events.parquet").select("user_id", "event_id", "value")
    last = keep_one(stream, ["user_id"], ["event_id"], last=True).select(
        F.lit("last").alias("kept"), F.col("user_id").cast("string").alias("k"), F.col("value").alias("bright_ti4")
    )
    return first.unionByName(last)


@query(
    "w4_tile_sample",
    """SELECT tile_id, tile_south, tile_west FROM (
         SELECT *, row_number() OVER (ORDER BY tile_south, tile_west) - 1 AS pos, count(*) OVER () AS n FROM {tiles})
       WHERE n <= 40 OR pos IN (SELECT CAST(round_even(i*((SELECT count(*) FROM {tiles})-1)::double/39, 0) AS BIGINT)
                                FROM range(40) t(i))""",
)
def w4(spark, folder):
    return spatial.sample_tiles(r.tiles(r.grid_cells(spark, folder)), 40).select("tile_id", "tile_south", "tile_west")


@query(
    "w5_share_of_total",
    "SELECT target_multiclass, count(*) AS n, count(*) / (SELECT count(*) FROM {cells})::double AS share"
    " FROM {cells} GROUP BY target_multiclass",
)
def w5(spark, folder):
    from emberfield.functions.ordered import with_share

    return with_share(profile.count_by(r.labelled_cells(spark, folder), "target_multiclass", "target_multiclass"))
