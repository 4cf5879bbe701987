"""Check tables as DuckDB SQL, written apart from the Spark code.

``{name}`` references are resolved into a WITH chain by ``with_tables``.
Joins are brute force and ranks are row numbers here on purpose: a different
form than the one under test.
"""

from __future__ import annotations

import re

TABLES: dict[str, str] = {}

TABLES["det"] = """
SELECT 8.0::double + ((c*7919)%2900)/100.0::double + ((l_partkey%9)-4)/1000.0::double AS latitude,
       68.5::double + ((c*104729)%2850)/100.0::double + ((l_orderkey%9)-4)/1000.0::double AS longitude,
       300.0::double+(l_partkey%256)/4.0::double AS brightness, 0.5::double AS scan, 0.25::double AS track,
       CAST('2023-09-15' AS DATE) + CAST(CASE WHEN c < 1000000 THEN (l_partkey*13+l_orderkey)%1000
             ELSE (c*37)%950 + (l_linenumber-3)*(c%7) END AS INT) AS acq_date,
       CAST((l_orderkey%24)*100 + l_partkey%60 AS INT) AS acq_time,
       'N' AS satellite, 'VIIRS' AS instrument,
       CASE l_returnflag WHEN 'A' THEN 'l' WHEN 'N' THEN 'n' ELSE 'h' END AS confidence, '2' AS version,
       280.0::double+(l_orderkey%128)/4.0::double AS bright_t31, l_quantity/4.0::double AS frp,
       CASE WHEN (l_orderkey+l_linenumber*3)%10 < c%8 THEN 'N' ELSE 'D' END AS daynight,
       CAST(CASE WHEN c%5=0 AND l_partkey%3=0 THEN 2 ELSE 0 END AS INT) AS type
FROM (SELECT *, CASE WHEN l_linenumber<=2 THEN l_suppkey ELSE 1000000+l_orderkey END AS c FROM lineitem)
"""

TABLES["prep"] = """
SELECT *, CAST(daynight='D' AS INT) AS is_day, CAST(daynight='N' AS INT) AS is_night,
       CAST(type=2 AS INT) AS is_type2,
       CASE confidence WHEN 'l' THEN 30.0::double WHEN 'n' THEN 50.0::double WHEN 'h' THEN 80.0::double
            ELSE 50.0::double END AS confidence_score,
       round_even(latitude/0.01::double,0)*0.01::double AS lat_grid,
       round_even(longitude/0.01::double,0)*0.01::double AS lon_grid
FROM {det}
"""

_AGG = """
       count(*) AS observation_count, min(acq_date) AS first_seen, max(acq_date) AS last_seen,
       count(DISTINCT acq_date) AS active_days,
       CAST(sum(is_day) AS BIGINT) AS day_observations, CAST(sum(is_night) AS BIGINT) AS night_observations,
       avg(frp) AS mean_frp, max(frp) AS max_frp, {std}(frp) AS std_frp,
       avg(brightness) AS mean_brightness, max(brightness) AS max_brightness,
       avg(bright_t31) AS mean_bright_t31, max(bright_t31) AS max_bright_t31,
       avg(confidence_score) AS mean_confidence_score"""

_KEY = "concat(CAST(round_even(lat_grid,4) AS VARCHAR), '_', CAST(round_even(lon_grid,4) AS VARCHAR))"

TABLES["agg"] = (
    f"SELECT {_KEY} AS grid_id, lat_grid, lon_grid,"
    + _AGG.replace("{std}", "stddev_samp")
    + ", CAST(sum(is_type2) AS BIGINT) AS type_2_count FROM {prep} GROUP BY lat_grid, lon_grid"
)

TABLES["derived"] = """
SELECT * EXCLUDE (std_frp), coalesce(std_frp, 0.0::double) AS std_frp,
       CAST(date_diff('day', first_seen, last_seen) + 1 AS INT) AS persistence_days,
       active_days / (date_diff('day', first_seen, last_seen) + 1)::double AS recurrence_ratio,
       observation_count / active_days::double AS obs_per_active_day,
       night_observations / observation_count::double AS night_ratio,
       type_2_count / observation_count::double AS type_2_ratio
FROM {agg}
"""

TABLES["cells"] = """
SELECT *, CAST(CASE WHEN target_multiclass IN (1,2) THEN 1 ELSE 0 END AS INT) AS target_persistent_source FROM (
SELECT *, CAST(CASE
    WHEN active_days>=10 AND persistence_days>=60 AND night_ratio>=0.2::double THEN 2
    WHEN active_days>=4 AND night_ratio>=0.25::double
         AND (type_2_count>0 OR mean_frp>=4.0::double OR active_days>=7) THEN 1
    WHEN active_days<=3 AND persistence_days<=14 AND night_ratio<0.15::double AND type_2_count=0 THEN 0
    ELSE 3 END AS INT) AS target_multiclass
FROM {derived})
"""

TABLES["live_raw"] = """
SELECT event_id AS eid,
       8.0::double+((user_id*7919)%2900)/100.0::double+((event_id%9)-4)/1000.0::double AS latitude,
       68.5::double+((user_id*104729)%2850)/100.0::double+((event_id%7)-3)/1000.0::double AS longitude,
       300.0::double+(event_id%256)/4.0::double AS bright_ti4, 280.0::double+(event_id%128)/4.0::double AS bright_ti5,
       CAST(ts AS DATE) AS acq_date, CAST(hour(ts)*100+minute(ts) AS INT) AS acq_time,
       CASE WHEN event_id%2=0 THEN 'N20' ELSE 'N21' END AS satellite,
       CASE event_type WHEN 'error' THEN ' L' WHEN 'click' THEN 'n' WHEN 'view' THEN 'h'
                       WHEN 'signup' THEN '75' ELSE 'x' END AS confidence,
       floor(value*4)/4.0::double AS frp,
       CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'd' ELSE 'N' END AS daynight,
       CASE WHEN event_id%2=0 THEN 'VIIRS_A' ELSE 'VIIRS_B' END AS source_dataset
FROM events
"""

TABLES["live_rep"] = "SELECT * FROM {live_raw} UNION ALL SELECT * FROM {live_raw} WHERE eid%50=0"

TABLES["live_coerced"] = """
SELECT *, coalesce(CASE trim(lower(confidence)) WHEN 'l' THEN 30.0::double WHEN 'n' THEN 50.0::double
                        WHEN 'h' THEN 80.0::double END, TRY_CAST(confidence AS DOUBLE)) AS confidence_score,
       CAST(upper(daynight)='D' AS INT) AS is_day, CAST(upper(daynight)='N' AS INT) AS is_night
FROM {live_rep}
"""

TABLES["live_norm"] = """
SELECT * EXCLUDE (rn), bright_ti4 AS brightness, bright_ti5 AS bright_t31 FROM (
SELECT *, row_number() OVER (
         PARTITION BY latitude, longitude, acq_date, acq_time, satellite, frp, source_dataset
         ORDER BY bright_ti4, bright_ti5, confidence, confidence_score, daynight, is_day, is_night) AS rn
FROM {live_coerced}
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND bright_ti4 IS NOT NULL AND bright_ti5 IS NOT NULL
  AND frp IS NOT NULL AND acq_date IS NOT NULL AND confidence_score IS NOT NULL) WHERE rn = 1
"""

TABLES["edges"] = """
SELECT * FROM (VALUES
 (0,0,70.0::double,10.0::double,70.0::double,35.0::double),(0,0,95.0,10.0,70.0,10.0),(0,0,95.0,35.0,95.0,10.0),(0,0,70.0,35.0,95.0,35.0),
 (0,1,80.0,20.0,80.0,25.0),(0,1,85.0,20.0,80.0,20.0),(0,1,85.0,25.0,85.0,20.0),(0,1,80.0,25.0,85.0,25.0),
 (1,0,68.0,8.0,68.0,12.0),(1,0,70.0,8.0,68.0,8.0),(1,0,68.0,12.0,70.0,8.0)) t(poly,ring,x1,y1,x2,y2)
"""


def inside_sql(x: str, y: str) -> str:
    """True when a point is in polygon 0 but not its hole, or in polygon 1."""
    def odd(poly: int, ring: int) -> str:
        return (
            f"(SELECT count(*) % 2 = 1 FROM edges_t e WHERE e.poly={poly} AND e.ring={ring}"
            f" AND (e.y1 > {y}) <> (e.y2 > {y})"
            f" AND {x} < (e.x2-e.x1)*({y}-e.y1)/(e.y2-e.y1)+e.x1)"
        ).replace("edges_t", "{edges}")

    return f"(({odd(0, 0)} AND NOT {odd(0, 1)}) OR {odd(1, 0)})"


TABLES["live_clip"] = "SELECT * FROM {live_norm} p WHERE " + inside_sql("p.longitude", "p.latitude")

TABLES["inside_cells"] = "SELECT * FROM {agg} p WHERE " + inside_sql("p.lon_grid", "p.lat_grid")

TABLES["live_cells"] = (
    f"""SELECT *, CAST(date_diff('day', first_seen, last_seen) + 1 AS INT) AS persistence_days,
       active_days / (date_diff('day', first_seen, last_seen) + 1)::double AS recurrence_ratio,
       observation_count / active_days::double AS obs_per_active_day,
       night_observations / observation_count::double AS night_ratio FROM (
SELECT {_KEY} AS grid_id, lat_grid, lon_grid,"""
    + _AGG.replace("{std}", "stddev_pop")
    + """ FROM (SELECT *, round_even(round_even(latitude/0.01::double,0)*0.01::double,4) AS lat_grid,
                       round_even(round_even(longitude/0.01::double,0)*0.01::double,4) AS lon_grid FROM {live_clip})
GROUP BY lat_grid, lon_grid)"""
)

TABLES["objects"] = """
SELECT concat('node:', p_partkey) AS osm_id,
       8.0::double+((p_partkey%100*7919)%2900)/100.0::double+((p_partkey*31)%61-30)/1000.0::double AS latitude,
       68.5::double+((p_partkey%100*104729)%2850)/100.0::double+((p_partkey*17)%61-30)/1000.0::double AS longitude,
       p_size%3=0 AS industrial, p_size%5=0 AS power, p_size%7=0 AS manmade
FROM part
"""

_X = "6378137.0::double*radians({0})"
_Y = "6378137.0::double*ln(tan(pi()/4+radians({0})/2))"

TABLES["tile_of"] = """
SELECT *, CAST(floor(lat_grid/0.25::double) AS INT) AS tr, CAST(floor(lon_grid/0.25::double) AS INT) AS tc FROM {agg}
"""

TABLES["queried"] = "SELECT * FROM {tile_of} WHERE (tr+tc)%3 <> 0"

TABLES["pairs"] = (
    "SELECT c.grid_id, o.osm_id, o.industrial, o.power, o.manmade,"
    " sqrt((o.x-c.x)*(o.x-c.x)+(o.y-c.y)*(o.y-c.y)) AS dist"
    " FROM (SELECT grid_id, " + _X.format("lon_grid") + " AS x, " + _Y.format("lat_grid") + " AS y FROM {queried}) c,"
    " (SELECT *, " + _X.format("longitude") + " AS x, " + _Y.format("latitude") + " AS y FROM {objects}) o"
    " WHERE sqrt((o.x-c.x)*(o.x-c.x)+(o.y-c.y)*(o.y-c.y)) <= 2000.0::double"
)

TABLES["ctx"] = """
SELECT q.grid_id, q.lat_grid, q.lon_grid, CAST(count(p.osm_id) AS INT) AS osm_feature_count,
       CAST(count(*) FILTER (WHERE p.industrial) AS INT) AS osm_industrial_count,
       CAST(count(*) FILTER (WHERE p.power) AS INT) AS osm_power_count,
       CAST(count(*) FILTER (WHERE p.manmade) AS INT) AS osm_manmade_count,
       coalesce(min(p.dist), 2000.0::double) AS osm_min_distance_m
FROM {queried} q LEFT JOIN {pairs} p USING (grid_id) GROUP BY ALL
"""

TABLES["assembled"] = """
SELECT a.grid_id, a.lat_grid, a.lon_grid, c.osm_feature_count, c.osm_industrial_count, c.osm_power_count,
       c.osm_manmade_count, c.osm_min_distance_m, c.grid_id IS NOT NULL AS osm_context_available
FROM {agg} a LEFT JOIN {ctx} c USING (grid_id)
"""

TABLES["tiles"] = """
SELECT DISTINCT printf('%.6f_%.6f', tr*0.25::double, tc*0.25::double) AS tile_id, tr*0.25::double AS tile_south,
       tc*0.25::double AS tile_west, tr*0.25::double+0.25::double AS tile_north,
       tc*0.25::double+0.25::double AS tile_east, tr, tc
FROM {tile_of}
"""

TABLES["manifest"] = """
SELECT tile_id, tile_south AS south, tile_west AS west, tile_north AS north, tile_east AS east,
       CASE WHEN (tr+tc)%2=0 THEN 'failed' WHEN (tr+tc)%3<>0 THEN 'success' ELSE 'failed' END AS status,
       TIMESTAMP '2024-01-01' AS timestamp, tr, tc FROM {tiles}
UNION ALL
SELECT tile_id, tile_south, tile_west, tile_north, tile_east,
       CASE WHEN (tr+tc)%3<>0 THEN 'success' ELSE 'failed' END, TIMESTAMP '2024-01-02', tr, tc
FROM {tiles} WHERE (tr+tc)%2=0
"""

TABLES["events_t"] = """
SELECT (CAST(round_even(c.lat_grid/0.01::double,0) AS BIGINT)+9000)*36001
        + CAST(round_even(c.lon_grid/0.01::double,0) AS BIGINT)+18000 AS id,
       concat(CASE WHEN (CAST(round_even(c.lat_grid/0.01::double,0) AS BIGINT)
                       + CAST(round_even(c.lon_grid/0.01::double,0) AS BIGINT))%3=0 THEN 'firms-' ELSE 'hist-' END,
              c.grid_id) AS event_id,
       c.grid_id, round_even(c.lat_grid,4) AS latitude, round_even(c.lon_grid,4) AS longitude,
       CAST(observation_count AS INT) AS observation_count, CAST(active_days AS INT) AS active_days,
       first_seen, last_seen, persistence_days, recurrence_ratio, obs_per_active_day,
       CAST(day_observations AS INT) AS day_observations, CAST(night_observations AS INT) AS night_observations,
       night_ratio, mean_frp, max_frp, std_frp, mean_brightness, max_brightness, mean_bright_t31, max_bright_t31,
       mean_confidence_score, CAST(type_2_count AS INT) AS type_2_count, type_2_ratio,
       target_persistent_source, target_multiclass, osm_context_available, osm_feature_count,
       osm_industrial_count, osm_power_count, osm_manmade_count, osm_min_distance_m
FROM {cells} c JOIN (SELECT * EXCLUDE (lat_grid, lon_grid) FROM {assembled}) a USING (grid_id)
"""

TABLES["live_events"] = """
SELECT (CAST(round_even(lat_grid/0.01::double,0) AS BIGINT)+9000)*36001
        + CAST(round_even(lon_grid/0.01::double,0) AS BIGINT)+18000 AS id,
       concat('firms-', grid_id) AS event_id, grid_id, lat_grid AS latitude, lon_grid AS longitude,
       CAST(observation_count AS INT) AS observation_count, CAST(active_days AS INT) AS active_days,
       first_seen, last_seen, persistence_days, recurrence_ratio, obs_per_active_day,
       CAST(day_observations AS INT) AS day_observations, CAST(night_observations AS INT) AS night_observations,
       night_ratio, mean_frp, max_frp, std_frp, mean_brightness, max_brightness, mean_bright_t31, max_bright_t31,
       mean_confidence_score, CAST(NULL AS INT) AS type_2_count, CAST(NULL AS DOUBLE) AS type_2_ratio,
       CAST(NULL AS INT) AS target_persistent_source, CAST(NULL AS INT) AS target_multiclass,
       false AS osm_context_available, CAST(NULL AS INT) AS osm_feature_count,
       CAST(NULL AS INT) AS osm_industrial_count, CAST(NULL AS INT) AS osm_power_count,
       CAST(NULL AS INT) AS osm_manmade_count, CAST(NULL AS DOUBLE) AS osm_min_distance_m
FROM {live_cells}
"""

TABLES["clean"] = """
SELECT latitude, longitude, brightness, scan, track, acq_date, acq_time,
       CAST(acq_date AS TIMESTAMP) + to_hours(acq_time//100) + to_minutes(acq_time%100) AS acq_datetime,
       satellite, instrument, confidence, version, bright_t31, frp, daynight, type,
       round_even(latitude*100.0::double,0)/100.0::double AS lat_grid,
       round_even(longitude*100.0::double,0)/100.0::double AS lon_grid,
       concat(CAST(round_even(latitude*100.0::double,0)/100.0::double AS VARCHAR), '_',
              CAST(round_even(longitude*100.0::double,0)/100.0::double AS VARCHAR)) AS grid_id
FROM {det}
"""

TABLES["counts"] = "SELECT grid_id, count(*) AS observation_count FROM {clean} GROUP BY grid_id"

TABLES["top50"] = "SELECT * FROM {counts} ORDER BY observation_count DESC, grid_id LIMIT 50"

TABLES["top_rows"] = "SELECT * FROM {clean} WHERE grid_id IN (SELECT grid_id FROM {top50})"

TABLES["persistence"] = """
SELECT *, active_days / active_span_days::double AS activity_ratio FROM (
SELECT grid_id, count(*) AS observations, count(DISTINCT CAST(acq_datetime AS DATE)) AS active_days,
       min(acq_datetime) AS first_detection, max(acq_datetime) AS last_detection,
       CAST(floor(epoch(max(acq_datetime)-min(acq_datetime))/86400) AS INT)+1 AS active_span_days
FROM {top_rows} GROUP BY grid_id)
"""

TABLES["profile"] = """
SELECT grid_id, count(*) AS observations, count(DISTINCT CAST(acq_datetime AS DATE)) AS active_days,
       avg(frp) AS mean_frp, max(frp) AS max_frp, avg(brightness) AS mean_brightness,
       avg(CASE WHEN confidence='h' THEN 100.0::double ELSE 0.0::double END) AS high_confidence,
       avg(CASE WHEN type=0 THEN 100.0::double ELSE 0.0::double END) AS type_0_pct,
       avg(CASE WHEN type=2 THEN 100.0::double ELSE 0.0::double END) AS type_2_pct,
       avg(CASE WHEN daynight='D' THEN 100.0::double ELSE 0.0::double END) AS day_pct
FROM {top_rows} GROUP BY grid_id
"""

TABLES["pred"] = """
SELECT *, target_multiclass AS label,
       CASE WHEN active_days>=10 THEN 2 WHEN active_days>=4 THEN 1 WHEN active_days<=2 THEN 0 ELSE 3 END AS prediction,
       active_days/(active_days+1.0::double) AS score
FROM {cells}
"""

TABLES["spl"] = """
SELECT *, concat(CAST(lb AS VARCHAR), '_', CAST(ob AS VARCHAR)) AS block,
       CASE WHEN h < 60 THEN 'train' WHEN h < 80 THEN 'validation' ELSE 'test' END AS split FROM (
SELECT *, CAST('0x' || substr(md5(concat_ws('|', 'emberfield', lb, ob)), 1, 8) AS BIGINT) % 100 AS h FROM (
SELECT *, CAST(floor(lat_grid/0.1::double) AS BIGINT) AS lb, CAST(floor(lon_grid/0.1::double) AS BIGINT) AS ob FROM {cells}))
"""

TABLES["per_class"] = """
SELECT k AS label, n AS support, hit, guessed,
       CASE WHEN guessed=0 THEN 0.0::double ELSE hit/guessed::double END AS precision,
       CASE WHEN n=0 THEN 0.0::double ELSE hit/n::double END AS recall,
       CASE WHEN n+guessed=0 THEN 0.0::double ELSE 2*hit/(n+guessed)::double END AS f1
FROM (SELECT k, (SELECT count(*) FROM {pred} WHERE label=k) AS n,
             (SELECT count(*) FROM {pred} WHERE prediction=k) AS guessed,
             (SELECT count(*) FROM {pred} WHERE prediction=k AND label=k) AS hit
      FROM (VALUES (0),(1),(2),(3)) v(k))
"""

_REF = re.compile(r"\{(\w+)\}")


def with_tables(sql: str) -> str:
    """Prefix the SQL with the check tables it needs, in dependency order."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in _REF.findall(text):
            if name not in order:
                visit(TABLES[name])
                if name not in order:
                    order.append(name)

    visit(sql)
    plain = lambda text: _REF.sub(lambda m: f"t_{m.group(1)}", text).strip()
    if not order:
        return plain(sql)
    chain = ",\n".join(f"t_{n} AS MATERIALIZED (\n{plain(TABLES[n])}\n)" for n in order)
    body = plain(sql)
    if body.startswith("WITH "):
        return f"WITH {chain},\n{body.removeprefix('WITH ')}"
    return f"WITH {chain}\n{body}"
