"""Scalar rules: grid, confidence, labels, clock."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import distance, grid, values as v
from emberfield.operators import cells, normalize


def test_grid_ties_go_to_the_even_neighbour(spark):
    points = [x / 1000.0 for x in range(-1000, 1000, 5)] + [0.125, 8.125, 0.375]
    rows = spark.createDataFrame([(p,) for p in points], "x double")
    got = [r["g"] for r in rows.select("x", grid.snap(F.col("x")).alias("g")).collect()]
    want = [np.round(p / 0.01) * 0.01 + 0.0 for p in points]
    assert got == [float(w) for w in want]


def test_grid_key_has_no_padding_and_no_minus_zero(spark):
    rows = spark.createDataFrame([(31.22, 75.77), (10.0, 80.5), (-0.001, 0.001)], "a double, b double")
    key = grid.grid_key(grid.snap(F.col("a")), grid.snap(F.col("b")))
    assert [r[0] for r in rows.select(key).collect()] == ["31.22_75.77", "10.0_80.5", "0.0_0.0"]


def test_confidence_archive_and_live(spark):
    given = ["h", " H ", "75", "x", None, "nan", "7d", "1e2"]
    rows = spark.createDataFrame([(g,) for g in given], "c string")
    got = rows.select(v.archive_confidence(F.col("c")), v.live_confidence(F.col("c"))).collect()
    assert [r[0] for r in got] == [80, 50, 50, 50, 50, 50, 50, 50]
    assert [r[1] for r in got] == [80, 80, 75, None, None, None, None, 100]


def test_numeric_confidence_is_kept(spark):
    rows = spark.createDataFrame([("2024-01-01", "D", 0, 66)], "acq_date string, daynight string, type int, confidence int")
    assert normalize.prepare_archive(rows).first()["confidence_score"] == 66.0


LABELS = [
    # active, span, night, type2, frp -> class
    (10, 60, 0.20, 0, 0.0, 2),
    (9, 60, 0.20, 0, 0.0, 3),
    (10, 59, 0.25, 0, 0.0, 1),
    (4, 10, 0.25, 1, 0.0, 1),
    (4, 10, 0.25, 0, 4.0, 1),
    (4, 10, 0.24, 0, 4.0, 3),
    (7, 10, 0.25, 0, 0.0, 1),
    (3, 14, 0.149, 0, 9.0, 0),
    (3, 14, 0.15, 0, 9.0, 3),
    (3, 15, 0.0, 0, 9.0, 3),
    (3, 14, 0.0, 1, 9.0, 3),
    (12, 90, 0.9, 5, 9.0, 2),
]


def test_label_edges_and_priority(spark):
    rows = spark.createDataFrame(
        LABELS,
        "active_days int, persistence_days int, night_ratio double, type_2_count int, mean_frp double, want int",
    )
    got = cells.label_cells(rows).collect()
    assert [r["target_multiclass"] for r in got] == [r["want"] for r in got]
    assert all(r["target_persistent_source"] == int(r["want"] in (1, 2)) for r in got)


def test_clock_fields(spark):
    rows = spark.createDataFrame([("2024-01-02", t) for t in (5, 930, 2359, 2400, 1260)], "d string, acq_time int")
    out = normalize.with_clock(rows.select(F.col("d").cast("date").alias("acq_date"), "acq_time")).collect()
    assert [(r["acq_hour"], r["acq_minute"]) for r in out] == [(0, 5), (9, 30), (23, 59), (24, 0), (12, 60)]
    assert [r["valid_time"] for r in out] == [True, True, True, False, False]
    assert [None if r["acq_datetime"] is None else r["acq_datetime"].minute for r in out] == [5, 30, 59, None, None]


def _vincenty(lat1, lon1, lat2, lon2):
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = math.atan((1 - f) * math.tan(math.radians(lat1))), math.atan((1 - f) * math.tan(math.radians(lat2)))
    big_l = math.radians(lon2 - lon1)
    lam = big_l
    for _ in range(200):
        s = math.hypot(
            math.cos(u2) * math.sin(lam),
            math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam),
        )
        if s == 0:
            return 0.0
        c = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        sig = math.atan2(s, c)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / s
        cos2a = 1 - sin_a**2
        cm = c - 2 * math.sin(u1) * math.sin(u2) / cos2a if cos2a else 0.0
        k = f / 16 * cos2a * (4 + f * (4 - 3 * cos2a))
        new = big_l + (1 - k) * f * sin_a * (sig + k * s * (cm + k * c * (2 * cm * cm - 1)))
        if abs(new - lam) < 1e-13:
            break
        lam = new
    usq = cos2a * (a * a - b * b) / (b * b)
    aa = 1 + usq / 16384 * (4096 + usq * (-768 + usq * (320 - 175 * usq)))
    bb = usq / 1024 * (256 + usq * (-128 + usq * (74 - 47 * usq)))
    ds = bb * s * (cm + bb / 4 * (c * (2 * cm * cm - 1) - bb / 6 * cm * (4 * s * s - 3) * (4 * cm * cm - 3)))
    return b * aa * (sig - ds)


def test_geodesic_close_to_iterative_solution(spark):
    pairs = [(22.5, 79.5, 22.51, 79.52), (10.0, 70.0, 10.9, 70.0), (31.0, 75.0, 31.0, 75.9), (5.0, 5.0, 5.0, 5.0)]
    rows = spark.createDataFrame(pairs, "a double, b double, c double, d double")
    got = [r[0] for r in rows.select(distance.geodesic_distance(*[F.col(c) for c in "abcd"])).collect()]
    for found, pair in zip(got, pairs):
        assert found == pytest.approx(_vincenty(*pair), rel=1e-5, abs=0.01)


def test_search_box_wraps_and_covers_poles():
    box = grid.search_box(10.0, 179.9, 50_000)
    assert len(box["lon"]) == 2 and box["lon"][1][0] == -180.0
    assert grid.search_box(89.99, 0.0, 50_000)["lon"] == [(-180.0, 180.0)]
