"""Domain tables derived from the generic star-schema tables.

The driver's tables know nothing about fires; these projections turn them into
detections, map objects and so on. Everything that gets summed is a multiple
of 1/4, so sums do not depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def detections(spark: SparkSession, folder: str) -> DataFrame:
    """Archive detections from ``lineitem``: dense sites and sparse sites."""
    site = "CASE WHEN l_linenumber <= 2 THEN l_suppkey ELSE 1000000 + l_orderkey END"
    rows = _table(spark, folder, "lineitem").selectExpr("*", f"{site} AS c")
    return rows.selectExpr(
        "8.0D + pmod(c * 7919, 2900) / 100.0D + ((l_partkey % 9) - 4) / 1000.0D AS latitude",
        "68.5D + pmod(c * 104729, 2850) / 100.0D + ((l_orderkey % 9) - 4) / 1000.0D AS longitude",
        "300.0D + (l_partkey % 256) / 4.0D AS brightness",
        "0.5D AS scan",
        "0.25D AS track",
        "date_add(DATE'2023-09-15', CAST(CASE WHEN c < 1000000"
        " THEN (l_partkey * 13 + l_orderkey) % 1000"
        " ELSE (c * 37) % 950 + (l_linenumber - 3) * (c % 7) END AS INT)) AS acq_date",
        "CAST((l_orderkey % 24) * 100 + l_partkey % 60 AS INT) AS acq_time",
        "'N' AS satellite",
        "'VIIRS' AS instrument",
        "CASE l_returnflag WHEN 'A' THEN 'l' WHEN 'N' THEN 'n' ELSE 'h' END AS confidence",
        "'2' AS version",
        "280.0D + (l_orderkey % 128) / 4.0D AS bright_t31",
        "l_quantity / 4.0D AS frp",
        "CASE WHEN (l_orderkey + l_linenumber * 3) % 10 < c % 8 THEN 'N' ELSE 'D' END AS daynight",
        "CASE WHEN c % 5 = 0 AND l_partkey % 3 = 0 THEN 2 ELSE 0 END AS type",
    )


def live_detections(spark: SparkSession, folder: str, repeats: bool = False) -> DataFrame:
    """Live detections from ``events``; with ``repeats``, every 50th row twice."""
    rows = _table(spark, folder, "events")
    if repeats:
        rows = rows.unionByName(rows.where("event_id % 50 = 0"))
    return rows.selectExpr(
        "8.0D + pmod(user_id * 7919, 2900) / 100.0D + ((event_id % 9) - 4) / 1000.0D AS latitude",
        "68.5D + pmod(user_id * 104729, 2850) / 100.0D + ((event_id % 7) - 3) / 1000.0D AS longitude",
        "300.0D + (event_id % 256) / 4.0D AS bright_ti4",
        "280.0D + (event_id % 128) / 4.0D AS bright_ti5",
        "CAST(ts AS DATE) AS acq_date",
        "hour(ts) * 100 + minute(ts) AS acq_time",
        "CASE WHEN event_id % 2 = 0 THEN 'N20' ELSE 'N21' END AS satellite",
        "CASE event_type WHEN 'error' THEN ' L' WHEN 'click' THEN 'n' WHEN 'view' THEN 'h'"
        " WHEN 'signup' THEN '75' ELSE 'x' END AS confidence",
        "floor(value * 4) / 4.0D AS frp",
        "CASE WHEN hour(ts) BETWEEN 6 AND 17 THEN 'd' ELSE 'N' END AS daynight",
        "CASE WHEN event_id % 2 = 0 THEN 'VIIRS_A' ELSE 'VIIRS_B' END AS source_dataset",
    )


def map_objects(spark: SparkSession, folder: str) -> DataFrame:
    """Map objects from ``part``; some carry several tags, some none."""
    tags = F.expr(
        "map_from_entries(filter(array("
        "IF(p_size % 3 = 0, struct('landuse' AS key, 'industrial' AS value), NULL),"
        "IF(p_size % 5 = 0, struct('power' AS key, 'tower' AS value), NULL),"
        "IF(p_size % 7 = 0, struct('man_made' AS key, 'works' AS value), NULL)),"
        " e -> e IS NOT NULL))"
    )
    lat = "8.0D + ((p_partkey % 100 * 7919) % 2900) / 100.0D + ((p_partkey * 31) % 61 - 30) / 1000.0D"
    lon = "68.5D + ((p_partkey % 100 * 104729) % 2850) / 100.0D + ((p_partkey * 17) % 61 - 30) / 1000.0D"
    return _table(spark, folder, "part").select(
        F.expr("concat('node:', p_partkey)").alias("osm_id"),
        F.expr(lat).alias("latitude"),
        F.expr(lon).alias("longitude"),
        tags.alias("tags"),
    )


# Fixed vertices of the test boundary: two polygons, the first with a hole.
BOUNDARY = [
    [
        [[70.0, 10.0], [95.0, 10.0], [95.0, 35.0], [70.0, 35.0]],
        [[80.0, 20.0], [85.0, 20.0], [85.0, 25.0], [80.0, 25.0]],
    ],
    [[[68.0, 8.0], [70.0, 8.0], [68.0, 12.0]]],
]


def boundary(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(BOUNDARY,)], "polygons array<array<array<array<double>>>>"
    )
