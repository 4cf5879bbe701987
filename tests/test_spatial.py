"""Radius, nearest, polygon and tile operators against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import grid
from emberfield.operators import spatial

R = 6378137.0


def _xy(lat, lon):
    return R * math.radians(lon), R * math.log(math.tan(math.pi / 4 + math.radians(lat) / 2))


def _cells(spark, points):
    rows = [(f"{a}_{b}", round(a / 0.01) * 0.01, round(b / 0.01) * 0.01) for a, b in points]
    return spark.createDataFrame(rows, "grid_id string, lat_grid double, lon_grid double")


@pytest.fixture(scope="module")
def crowd(spark):
    """900 objects, a third of them on one spot, and a block of cells around."""
    rng = np.random.default_rng(3)
    kinds = [{}, {"power": "tower"}, {"landuse": "industrial"}, {"man_made": "works", "power": "line"}, {"building": "Warehouse"}]
    objects = []
    for i in range(900):
        lat, lon = (60.003, 20.002) if i < 300 else (60 + rng.uniform(-0.1, 0.1), 20 + rng.uniform(-0.1, 0.1))
        objects.append((f"node:{i}", float(lat), float(lon), kinds[int(rng.integers(0, 5))]))
    points = [(60 + i / 100, 20 + j / 100) for i in range(-8, 9) for j in range(-8, 9)]
    points.append((10.0, 70.0))
    frame = spark.createDataFrame(objects, "osm_id string, latitude double, longitude double, tags map<string,string>")
    return objects, frame, points


def _brute(objects, points, radius, nearest=False):
    out = {}
    for a, b in points:
        cx, cy = _xy(round(a / 0.01) * 0.01, round(b / 0.01) * 0.01)
        near = []
        for _, lat, lon, tags in objects:
            x, y = _xy(lat, lon)
            d = math.hypot(x - cx, y - cy)
            if d <= radius:
                near.append((d, tags))
        if nearest and near:
            low = min(d for d, _ in near)
            near = [n for n in near if n[0] <= low + 1e-9]
        power = [t for _, t in near if "power" in t]
        if nearest:
            industrial = [t for _, t in near if "power" not in t and t.get("landuse") == "industrial"]
            made = [t for _, t in near if "power" not in t and "man_made" in t]
        else:
            industrial = [t for _, t in near if t.get("landuse") == "industrial" or "building" in t]
            made = [t for _, t in near if "man_made" in t]
        out[f"{a}_{b}"] = (len(near), len(industrial), len(power), len(made), min((d for d, _ in near), default=radius))
    return out


@pytest.mark.parametrize("nearest", [False, True])
def test_context_equals_brute_force_with_a_crowded_spot(spark, crowd, nearest):
    objects, frame, points = crowd
    operator = spatial.nearest_context if nearest else spatial.radius_context
    got = operator(_cells(spark, points), frame, 2000.0).collect()
    want = _brute(objects, points, 2000.0, nearest)
    assert len(got) == len(points)
    for r in got:
        w = want[r["grid_id"]]
        assert (r["osm_feature_count"], r["osm_industrial_count"], r["osm_power_count"], r["osm_manmade_count"]) == w[:4]
        assert r["osm_min_distance_m"] == pytest.approx(w[4], abs=1e-6)
    assert max(r["osm_feature_count"] for r in got) >= 300


def test_candidate_rows_per_object_stay_bounded(spark, crowd):
    _, frame, _ = crowd
    per_object = spatial.objects_near_cells(frame, 2000.0).groupBy("osm_id").count()
    # Cells are 0.01 degrees apart: a circle of 2 km covers few, however many objects share it.
    assert per_object.agg(F.max("count")).first()[0] <= 16


def test_radius_is_inclusive(spark):
    lon = 10.0 + math.degrees(1500.0 / R)
    objects = spark.createDataFrame([("node:1", 0.0, lon, {"power": "x"})], "osm_id string, latitude double, longitude double, tags map<string,string>")
    cells = _cells(spark, [(0.0, 10.0)])
    exact = math.hypot(R * math.radians(lon) - R * math.radians(10.0), 0)
    hit = spatial.radius_context(cells, objects, exact).first()
    miss = spatial.radius_context(cells, objects, exact - 0.001).first()
    assert (hit["osm_feature_count"], miss["osm_feature_count"]) == (1, 0)
    assert miss["osm_min_distance_m"] == exact - 0.001


def test_tags_overlap_or_exclude(spark):
    tags = [{"power": "line", "landuse": "industrial"}, {"industrial": "yes"}, {"man_made": "x"}, {}]
    frame = spark.createDataFrame([(f"n:{i}", 0.0, 0.0, t) for i, t in enumerate(tags)], "osm_id string, latitude double, longitude double, tags map<string,string>")
    flags = [(r["industrial"], r["power"], r["manmade"]) for r in spatial.with_category_flags(frame).collect()]
    assert flags == [(True, True, False), (True, False, False), (False, False, True), (False, False, False)]
    assert [r["category"] for r in spatial.with_single_category(frame).collect()] == ["power", "industrial", "man_made", "other"]
    assert spatial.relevant_objects(frame).count() == 3


def _inside(x, y, polygons):
    def ring(points):
        odd = False
        for i in range(len(points)):
            (xi, yi), (xj, yj) = points[i], points[i - 1]
            if (yi > y) != (yj > y) and x < (xj - xi) * (y - yi) / (yj - yi) + xi:
                odd = not odd
        return odd

    return any(ring(p[0]) and not any(ring(h) for h in p[1:]) for p in polygons)


def test_polygon_clip_equals_ray_casting(spark):
    rng = np.random.default_rng(1)
    star = [[10 + (3 + 2 * (i % 2)) * math.cos(i * math.pi / 20), 10 + (3 + 2 * (i % 2)) * math.sin(i * math.pi / 20)] for i in range(40)]
    # Two holes that overlap: parity alone would count their overlap as inside.
    holes = [[[9.0, 9.0], [10.5, 9.0], [10.5, 10.5], [9.0, 10.5]], [[10.0, 10.0], [11.0, 10.0], [11.0, 11.0], [10.0, 11.0]]]
    polygons = [[star, *holes], [[[20.0, 20.0], [21.0, 20.0], [20.0, 21.0]]]]
    shapes = spark.createDataFrame([(polygons,)], "polygons array<array<array<array<double>>>>")
    points = [(i, float(rng.uniform(4, 22)), float(rng.uniform(4, 22))) for i in range(3000)]
    points += [(3000 + i, 10.2, 10.2) for i in range(1500)] + [(9000, 8.5, 10.0)]
    frame = spark.createDataFrame(points, "id int, latitude double, longitude double")
    got = {r["id"] for r in spatial.clip_to_polygons(frame, shapes).collect()}
    assert got == {i for i, lat, lon in points if _inside(lon, lat, polygons)}
    assert 9000 in got and 3000 not in got


def test_polygon_clip_with_rows_of_few_edges(spark, monkeypatch):
    """Tiles with more edges than a row holds: the crossings of a point are added up over the rows."""
    monkeypatch.setattr(spatial, "TILE_EDGES", 2)
    test_polygon_clip_equals_ray_casting(spark)


def test_polygon_clip_on_lattice_lines_and_vertices(spark):
    """Vertices, horizontal edges and points that lie exactly on tile borders."""
    steps = [[0.0, 0.0], [1.0, 0.0], [1.0, 0.25], [0.5, 0.25], [0.5, 0.5], [1.0, 0.5], [1.0, 1.0], [0.25, 1.0], [0.25, 0.75], [0.0, 0.75]]
    polygons = [[steps, [[0.25, 0.25], [0.5, 0.5], [0.25, 0.5]]]]
    shapes = spark.createDataFrame([(polygons,)], "polygons array<array<array<array<double>>>>")
    points = [(100 * i + j, i / 32, j / 32) for i in range(-3, 37) for j in range(-3, 37)]
    frame = spark.createDataFrame(points, "id int, latitude double, longitude double")
    for size in (0.25, 0.05, 2.0):
        got = {r["id"] for r in spatial.clip_to_polygons(frame, shapes, size=size).collect()}
        assert got == {i for i, lat, lon in points if _inside(lon, lat, polygons)}


def test_polygon_clip_with_many_edges(spark):
    """100,000 edges: equal to ray casting, and no index row above its bound."""
    n = 100_000
    angle = np.arange(n) * (2 * math.pi / n)
    far = 1 + 0.2 * np.sin(37 * angle) + np.random.default_rng(3).uniform(0, 0.02, n)
    x, y = 10 + far * np.cos(angle), 20 + far * np.sin(angle)
    shapes = spark.createDataFrame([([[np.c_[x, y].tolist()]],)], "polygons array<array<array<array<double>>>>")
    index = spatial.tile_index(shapes, 0.05).select(F.size("edges").alias("n"), "chunk").collect()
    assert max(r["n"] for r in index) <= spatial.TILE_EDGES and sum(r["n"] == 0 for r in index) > 100
    rng = np.random.default_rng(4)
    px, py = rng.uniform(8.7, 11.3, 3000), rng.uniform(18.7, 21.3, 3000)
    frame = spark.createDataFrame([(i, float(b), float(a)) for i, (a, b) in enumerate(zip(px, py))], "id int, latitude double, longitude double")
    got = {r["id"] for r in spatial.clip_to_polygons(frame, shapes).collect()}
    xj, yj = np.roll(x, 1), np.roll(y, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        want = {i for i in range(3000) if (((y > py[i]) != (yj > py[i])) & (px[i] < (xj - x) * (py[i] - y) / (yj - y) + x)).sum() % 2}
    assert got == want and 500 < len(want) < 2500


def test_tiles_half_open_and_closed(spark):
    cells = _cells(spark, [(10.0, 70.0), (10.25, 70.0), (10.24, 70.24)]).withColumn("observation_count", F.lit(5))
    tiles = spatial.active_tiles(cells, 1)
    assert sorted(r["tile_id"] for r in tiles.collect()) == ["10.000000_70.000000", "10.250000_70.000000"]
    assert spatial.cells_in_tiles(cells, tiles).count() == 3
    assert spatial.cells_in_tiles(cells, tiles, closed=True).count() == 4
    assert spatial.active_tiles(cells, 6).count() == 0


@pytest.mark.parametrize("size,want", [(4, [0, 3, 6, 9]), (1, [0]), (10, list(range(10))), (40, list(range(10)))])
def test_sample_positions(spark, size, want):
    order = [(float(a), float(b)) for a in (0, 1) for b in range(5)]
    rows = [(f"t{i}", *p) for i, p in enumerate(order)]
    tiles = spark.createDataFrame(rows, "tile_id string, tile_south double, tile_west double")
    got = sorted(r["tile_id"] for r in spatial.sample_tiles(tiles, size).collect())
    assert got == sorted(f"t{i}" for i in want)


def test_sample_matches_the_list_rule(spark):
    n = 137
    tiles = spark.createDataFrame([(f"t{i:03d}", float(i // 12), float(i % 12)) for i in range(n)], "tile_id string, tile_south double, tile_west double")
    for size in (2, 3, 7, 50, 136):
        want = {f"t{int(np.round(i * (n - 1) / (size - 1))):03d}" for i in range(size)}
        assert {r["tile_id"] for r in spatial.sample_tiles(tiles, size).collect()} == want
    with pytest.raises(ValueError):
        spatial.sample_tiles(tiles, 0)


def test_nearby_pushes_the_box_to_the_scan(spark, tmp_path):
    rows = [(f"g{i}", 10 + i / 100, 70.0) for i in range(200)]
    spark.createDataFrame(rows, "grid_id string, latitude double, longitude double").write.parquet(str(tmp_path / "e"))
    found = spatial.nearby(spark.read.parquet(str(tmp_path / "e")), 10.5, 70.0, 2500.0)
    assert [r["grid_id"] for r in found.collect()] == ["g50", "g49", "g51", "g48", "g52"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(latitude" in plan and "CartesianProduct" not in plan


def test_grown_bounds(spark):
    bounds = grid.tile_bounds(F.lit(10.1), F.lit(70.1))
    grown = grid.grow_bounds(bounds, 2000.0)
    row = spark.range(1).select(*[c.alias(n) for n, c in grown.items()]).first()
    assert row["south"] == pytest.approx(10.0 - 2000 / 111320)
    assert row["west"] == pytest.approx(70.0 - 2000 / (111320 * math.cos(math.radians(10.125))))
