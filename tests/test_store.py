"""The place store: versions, touched rows of tiles, crashes, pushed ranges."""

import datetime as dt
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from emberfield.functions import grid
from emberfield.operators import events, spatial
from emberfield.schemas import EVENTS
from emberfield.sinks import store, tables as sinks
from emberfield.sources import views
from emberfield.streaming import live

DDL = "grid_id string, latitude double, longitude double, n int"


def _rows(spark, places, n=1):
    return spark.createDataFrame([(f"{a}_{b}", float(a), float(b), n) for a, b in places], DDL)


def _bytes(root, since=()):
    """Sizes of data files that are not among the given ones."""
    found = {os.path.join(d, f): os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(f"{root}/parts") for f in names if f.endswith(".parquet")}
    return {k: v for k, v in found.items() if k not in since}


def test_place_ranges_cover_the_box(spark):
    rng = np.random.default_rng(5)
    points = [(float(a), float(b)) for a, b in zip(rng.uniform(-90, 90, 4000), rng.uniform(-180, 180, 4000))]
    points += [(-90.0, -180.0), (90.0, 180.0), (31.0, 75.0)]
    frame = spark.createDataFrame([(i, *p) for i, p in enumerate(points)], "i int, latitude double, longitude double")
    codes = {r["i"]: r["c"] for r in frame.select("i", grid.place_code(F.col("latitude"), F.col("longitude")).alias("c")).collect()}
    for lat, lon, radius in ((31.0, 75.0, 2000), (31.0, 75.0, 900_000), (89.95, 0.0, 50_000), (0.0, 179.99, 400_000)):
        box = grid.search_box(lat, lon, radius)
        ranges = grid.place_ranges(box)
        assert 1 <= len(ranges) <= 16
        for i, (a, b) in enumerate(points):
            if box["lat"][0] <= a <= box["lat"][1] and any(w <= b <= e for w, e in box["lon"]):
                assert any(low <= codes[i] <= high for low, high in ranges)
    small = grid.place_ranges(grid.search_box(31.0, 75.0, 2000))
    assert sum(b - a + 1 for a, b in small) < 20_000
    none = spark.createDataFrame([(None, 1.0), (float("nan"), 1.0)], "latitude double, longitude double")
    assert {r[0] for r in none.select(grid.place_code(F.col("latitude"), F.col("longitude"))).collect()} == {-1}


def test_merge_writes_touched_tile_rows_only(spark, tmp_path):
    root = str(tmp_path)
    store.rewrite(_rows(spark, [(a, b) for a in range(10, 30) for b in range(70, 80)]), root, "first")
    before = {r["file"]: r["tile_row"] for r in store.current_files(spark, root).collect()}
    store.merge(_rows(spark, [(12, 71), (12, 99)], 5), root, "second", "grid_id")
    after = {r["file"]: r["tile_row"] for r in store.current_files(spark, root).collect()}
    assert {t for f, t in after.items() if f not in before} == {48} == {t for f, t in before.items() if f not in after}
    got = {r["grid_id"]: r["n"] for r in store.read(spark, root, spark.createDataFrame([], DDL).schema).collect()}
    assert len(got) == 201 and got["12_71"] == got["12_99"] == 5 and got["12_72"] == 1
    with pytest.raises(ValueError, match="already published"):
        store.rewrite(_rows(spark, [(1, 1)]), root, "second")


def test_a_write_that_dies_leaves_the_old_tiles(spark, tmp_path, monkeypatch):
    root = str(tmp_path)
    ddl = "grid_id string, lat_grid double, lon_grid double, osm_feature_count int, osm_industrial_count int, osm_power_count int, osm_manmade_count int, osm_min_distance_m double"
    tiles = lambda n: spark.createDataFrame([(f"g{a}", float(a), 70.1, n, 0, 0, 0, 5.0) for a in range(10, 15)], ddl)
    sinks.write_context_tiles(tiles(1), root)
    state = lambda: sorted(r["osm_feature_count"] for r in sinks.stored_tiles(spark, root).collect())

    def dies(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(store, "announce", dies)
        with pytest.raises(RuntimeError):
            sinks.write_context_tiles(tiles(2), root)
    assert state() == [1] * 5
    sinks.write_context_tiles(tiles(3), root)
    assert state() == [3] * 5


def test_expired_versions_and_compaction(spark, tmp_path, monkeypatch):
    root, schema = str(tmp_path), spark.createDataFrame([], DDL).schema
    monkeypatch.setattr(store, "MAX_FILES", 4)
    for i in range(6):
        store.append(_rows(spark, [(10, 70 + i), (50 + i, 70)]), root, f"v{i}")
    assert store.compact(spark, root, schema, "compact") and not store.compact(spark, root, schema, "again")
    files = store.current_files(spark, root)
    assert files.where("tile_row = 40").count() == 1 and store.read(spark, root, schema).count() == 12
    held = files.count()
    # The six small files of the crowded row go, those of the other rows stay.
    assert store.expire(spark, root, keep=1) == 6
    assert store.read(spark, root, schema).count() == 12 and len(_bytes(root)) == held


def test_nearby_and_lookup_open_few_files_and_push_ranges(spark, tmp_path):
    root = str(tmp_path)
    rows = spark.range(40_000).select(
        (F.lit(8.0) + F.floor(F.col("id") / 200) * 0.13).alias("latitude"), (F.lit(68.0) + F.col("id") % 200 * 0.13).alias("longitude")
    )
    table = rows.select(
        *[
            {
                "id": grid.lattice_id(F.col("latitude"), F.col("longitude")),
                "grid_id": grid.grid_key(F.col("latitude"), F.col("longitude")),
                "event_id": F.concat(F.lit("hist-"), grid.grid_key(F.col("latitude"), F.col("longitude"))),
            }.get(f.name, F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in EVENTS.fields
        ]
    )
    store.rewrite(table, root, "1")
    # Plans are printed whole.
    spark.conf.set("spark.sql.maxMetadataStringLength", 20_000)
    whole = store.read(spark, root, EVENTS)
    lat, lon, radius = 20.5, 80.1, 40_000.0
    part = store.read(spark, root, EVENTS, grid.search_box(lat, lon, radius))
    assert len(part.inputFiles()) * 10 < len(whole.inputFiles())
    plan = part._jdf.queryExecution().toString()
    pushed = [line for line in plan.splitlines() if "PushedFilters" in line]
    assert pushed and "GreaterThanOrEqual(place," in pushed[-1] and "LessThanOrEqual(place," in pushed[-1]
    want = [r["grid_id"] for r in spatial.nearby(whole, lat, lon, radius).collect()]
    assert [r["grid_id"] for r in spatial.nearby(part, lat, lon, radius).collect()] == want and len(want) > 20
    row = whole.where("latitude > 20").orderBy("id").first()
    for key in (row["id"], str(row["id"]), row["grid_id"], row["event_id"]):
        near = store.read(spark, root, EVENTS, events.key_box(key))
        assert len(near.inputFiles()) * 10 < len(whole.inputFiles())
        found = events.find_hotspot(near, key)
        assert found.first()["id"] == row["id"]
        text = found._jdf.queryExecution().toString()
        assert "EqualTo(grid_id," in text and "cast(id" not in text
    assert events.key_box("anything") is None and events.key_box("firms--10.5_70.0")["lat"][0] < -10.5 < events.key_box("-10.5_70.0")["lat"][1]
    assert events.find_hotspot(whole, f"0{row['id']}").first() is None


def test_three_batches_with_a_crash_write_what_they_touch(spark, sf_dir, tmp_path, monkeypatch):
    base = views.live_detections(spark, sf_dir.replace("sf0.001", "sf0.01"))
    landing, kept, table, offsets = (str(tmp_path / n) for n in ("landing", "store", "events", "offsets"))
    run = lambda: live.ingest(spark, landing, base.schema, kept, table, offsets).awaitTermination()
    first = base.where("acq_time < 2000")
    # The last batch repeats one place of the first.
    place = base.where("latitude is not null and frp is not null").orderBy("latitude", "longitude").first()
    small = base.where((F.col("latitude") == place["latitude"]) & (F.col("longitude") == place["longitude"]))
    first.write.mode("append").parquet(landing)
    run()
    base.where("acq_time >= 2000").write.mode("append").parquet(landing)
    merge = store.merge

    def dies(*_, **__):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(live.places, "merge", dies)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    before = {**_bytes(kept), **_bytes(table)}
    small.write.mode("append").parquet(landing)
    run()
    new = {**_bytes(kept, before), **_bytes(table, before)}
    assert 0 < sum(new.values()) < sum(before.values()) / 5
    got, want = live.ingested_events(spark, table), live.snapshot_of(base)
    key = ["event_id", "observation_count", "mean_frp"]
    assert got.count() == want.count() > 100
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
