"""File scans and writers on small files."""

import gzip
import json

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberfield import schemas
from emberfield.operators import normalize
from emberfield.sinks import tables as sinks
from emberfield.sources import files, heads

HEAD = "grid_id,lat_grid,lon_grid,osm_feature_count,osm_industrial_count,osm_power_count,osm_manmade_count,osm_min_distance_m"


def _put(folder, name, text):
    (folder / name).write_text(text)
    return str(folder)


def test_strict_tiles(spark, tmp_path):
    _put(tmp_path, "tile_1.csv", f"{HEAD}\na,1.0,2.0,3,1,1,1,10.5\n")
    # Another order of columns is read by name.
    _put(tmp_path, "tile_2.csv", "osm_min_distance_m,grid_id,lat_grid,lon_grid,osm_feature_count,osm_industrial_count,osm_power_count,osm_manmade_count\n2000.0,b,1.0,2.0,0,0,0,0\n")
    got = {r["grid_id"]: r for r in files.context_tiles(spark, f"{tmp_path}/tile_*.csv", per_file=True).collect()}
    assert got["a"]["osm_feature_count"] == 3 and got["b"]["osm_min_distance_m"] == 2000.0
    _put(tmp_path, "tile_3.csv", f"{HEAD}\na,1.0,2.0,9,1,1,1,10.5\n")
    with pytest.raises(PySparkException, match="duplicate key"):
        files.context_tiles(spark, f"{tmp_path}/tile_*.csv").collect()


def test_strict_tiles_refuse_short_and_empty_files(spark, tmp_path):
    _put(tmp_path, "tile_1.csv", f"{HEAD}\na,1.0,2.0,3,1,1,1,10.5\n")
    _put(tmp_path, "tile_2.csv", f"{HEAD}\n")
    assert files.context_tiles(spark, f"{tmp_path}/tile_*.csv").count() == 1
    with pytest.raises(ValueError, match="empty"):
        files.context_tiles(spark, f"{tmp_path}/tile_*.csv", per_file=True)
    _put(tmp_path, "tile_3.csv", "grid_id,lat_grid\nx,1.0\n")
    with pytest.raises(ValueError, match="lacks columns"):
        files.context_tiles(spark, f"{tmp_path}/tile_*.csv")


def test_lenient_tiles_keep_the_last_duplicate(spark, tmp_path):
    _put(tmp_path, "tile_1.csv", f"{HEAD}\na,1.0,2.0,3,1,1,1,10.5\nb,1.0,2.0,1,1,1,1,10.5\n")
    _put(tmp_path, "tile_2.csv", f"{HEAD}\na,1.0,2.0,7,1,1,1,5.5\n")
    _put(tmp_path, "tile_3.csv", "what\nis this\n")
    wanted = spark.createDataFrame([("a",), ("z",)], "grid_id string")
    rows = files.context_tiles_lenient(spark, f"{tmp_path}/tile_*.csv", wanted).collect()
    assert [(r["grid_id"], r["osm_feature_count"]) for r in rows] == [("a", 7)]


def _archive(folder, name, confidences):
    head = ",".join(f.name for f in schemas.ARCHIVE_DETECTIONS.fields)
    rows = [f"1.0,2.0,300.0,0.4,0.4,2024-01-02,130,N,VIIRS,{c},2,290.0,1.5,D,0" for c in confidences]
    (folder / name).mkdir()
    for i, row in enumerate(rows):
        _put(folder / name, f"{i}.csv", f"{head}\n{row}\n")
    return str(folder / name)


@pytest.mark.parametrize(
    "confidences, scores",
    [
        # Numbers throughout are the scores themselves; a missing one stays missing.
        (["85", "7.5", "NA", ""], [None, None, 7.5, 85.0]),
        (["", ""], [None, None]),
        # One letter makes the column text: letters by their score, all else medium.
        (["85", "h", "l", ""], [30.0, 50.0, 50.0, 80.0]),
    ],
)
def test_archive_confidence_of_a_file_set(spark, tmp_path, confidences, scores):
    rows = files.archive_detections(spark, _archive(tmp_path, "a", confidences)).collect()
    assert sorted((r["confidence_score"] for r in rows), key=lambda x: (x is not None, x or 0)) == scores


def test_map_json(spark, tmp_path):
    elements = [
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"power": "x"}},
        {"type": "way", "id": 1, "center": {"lat": 3.0, "lon": 4.0}},
        {"type": "way", "id": 2, "tags": {"a": "b"}},
        {"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"power": "x"}},
        {"id": 5, "lat": 1.0, "lon": 2.0},
    ]
    _put(tmp_path, "tile_a.json", json.dumps({"elements": elements}, indent=1))
    rows = {r["osm_id"]: r for r in files.parse_elements(files.map_elements(spark, str(tmp_path))).collect()}
    assert set(rows) == {"node:1", "way:1"}
    assert rows["way:1"]["latitude"] == 3.0 and rows["way:1"]["tags"] == {}


def test_boundary_by_code_or_name(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1]]
    features = [
        {"properties": {"ISO_A3": "abc"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
        {"properties": {"name": " Some Land "}, "geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring, ring]]}},
        {"properties": {"name": "other"}, "geometry": {"type": "Polygon", "coordinates": [ring]}},
    ]
    _put(tmp_path, "b.json", json.dumps({"features": features}))
    shapes = files.boundary_shapes(spark, str(tmp_path), "ABC", "some land").collect()
    assert sorted(len(s["polygons"]) for s in shapes) == [1, 2]


def test_landing_bodies(spark, tmp_path):
    head = "latitude,longitude,bright_ti4,bright_ti5,acq_date,acq_time,satellite,confidence,frp,daynight"
    _put(tmp_path, "a.csv", "")
    assert files.landing_csv(spark, str(tmp_path)).count() == 0
    _put(tmp_path, "b.csv", f"{head}\n1.0,2.0,bad,280.0,2024-01-02,930,N20, H ,1.5,d\n")
    row = normalize.coerce_live(files.landing_csv(spark, str(tmp_path)).withColumn("source_dataset", F.lit("s"))).first()
    assert row["bright_ti4"] is None and row["confidence_score"] == 80.0 and row["is_day"] == 1
    _put(tmp_path, "c.csv", "Invalid key\n")
    with pytest.raises(ValueError, match="unexpected response"):
        files.landing_csv(spark, str(tmp_path))


def test_required_columns(spark, tmp_path):
    with pytest.raises(ValueError, match="confidence"):
        normalize.coerce_live(spark.createDataFrame([(1.0,)], "latitude double"))
    _put(tmp_path, "cells.csv", "grid_id,lat_grid\na,1.0\n")
    with pytest.raises(ValueError, match="active_days"):
        files.cell_table(spark, str(tmp_path / "cells.csv"))


def test_grid_scan_rejects_bad_keys(spark):
    ddl = "grid_id string, lat_grid string, lon_grid string, observation_count string"
    good = spark.createDataFrame([("a", "1.0", "2.0", "x")], ddl)
    assert tuple(files.grid_scan(good).first()) == ("a", 1.0, 2.0, None)
    with pytest.raises(PySparkException, match="invalid identifiers"):
        files.grid_scan(spark.createDataFrame([("a", "zz", "2.0", "1")], ddl)).collect()
    with pytest.raises(PySparkException, match="duplicate key"):
        files.grid_scan(good.union(good)).collect()


def test_newest_file_and_snapshots(spark, tmp_path):
    for day in ("20240101", "20240203", "20231231"):
        _put(tmp_path, f"live_{day}.csv", "a\n")
    assert files.newest_file(spark, f"{tmp_path}/live_*.csv").endswith("live_20240203.csv")
    root = str(tmp_path / "events")
    one = spark.range(1).toDF("x")
    sinks.publish_snapshot(one, root, "1")
    current = spark.read.parquet(sinks.newest_snapshot(spark, root))
    # The new version may be computed from the current one.
    sinks.publish_snapshot(current.union(one), root, "2")
    assert spark.read.parquet(sinks.newest_snapshot(spark, root)).count() == 2
    with pytest.raises(ValueError, match="already published"):
        sinks.publish_snapshot(one, root, "2")
    # Leftovers of a failed attempt are no obstacle and are never read.
    one.write.parquet(f"{root}/snapshot=3")
    assert sinks.newest_snapshot(spark, root).endswith("snapshot=2")
    sinks.publish_snapshot(one, root, "3")
    assert spark.read.parquet(sinks.newest_snapshot(spark, root)).count() == 1


def test_context_tiles_replace_only_their_tiles(spark, tmp_path):
    root = str(tmp_path / "tiles")
    ddl = schemas.CONTEXT_TILE
    rows = [("a", 10.1, 70.1, 1, 0, 0, 0, 5.0), ("b", 10.1, 70.4, 1, 0, 0, 0, 5.0), ("c", 11.1, 70.1, 1, 0, 0, 0, 5.0)]
    sinks.write_context_tiles(spark.createDataFrame(rows, ddl), root)
    sinks.write_context_tiles(spark.createDataFrame([("a", 10.1, 70.1, 9, 0, 0, 0, 4.0)], ddl), root)
    got = {r["grid_id"]: r["osm_feature_count"] for r in sinks.stored_tiles(spark, root).collect()}
    assert got == {"a": 9, "b": 1, "c": 1}


def test_manifest_created_when_missing(spark, tmp_path):
    path = str(tmp_path / "manifest")
    assert files.tile_manifest(spark, path).count() == 0
    row = spark.createDataFrame([("t", 1.0, 2.0, 3.0, 4.0, "success", 1, 2, "e", None, "")], schemas.TILE_MANIFEST)
    sinks.append_manifest(row, path)
    sinks.append_manifest(row, path)
    assert files.tile_manifest(spark, path).count() == 2


def test_the_newest_version_is_the_last_announced(spark, tmp_path):
    root = str(tmp_path / "numbers")
    for version in ("9", "10", "2026-10-01-fix", "2026-10-02"):
        sinks.publish_snapshot(spark.range(3), root, version)
        assert sinks.newest_snapshot(spark, root).endswith(f"snapshot={version}")


def test_times_with_and_without_leading_zero_are_one(spark):
    from emberfield.operators import normalize

    ddl = "latitude string, longitude string, bright_ti4 string, bright_ti5 string, frp string, acq_date string, acq_time string, satellite string, daynight string, confidence string, source_dataset string"
    rows = [("1", "2", "300", "280", "1", "2024-01-01", time, "N", "D", "h", "s") for time in ("0930", "930")]
    live = normalize.coerce_live(spark.createDataFrame(rows, ddl))
    assert [r.acq_time for r in live.select("acq_time").collect()] == [930, 930]
    assert normalize.drop_repeats(live).count() == 1


def test_fields_by_name_in_any_order_and_from_odd_paths(spark, tmp_path):
    folder = tmp_path / "a b%20c"
    folder.mkdir()
    _put(folder, "tile 1.csv", f"\n{HEAD}\na,1.0,2.0,3.0,NA,1,1,10.5\nb,1.0,2.0\n")
    order = HEAD.split(",")[::-1]
    with gzip.open(folder / "tile+2.csv.gz", "wt") as out:
        out.write("x," + ",".join(f'"{c}"' for c in order) + "\n9,2000.0,0,0,0,4,2.0,1.0,c\n")
    rows = {r["grid_id"]: r for r in files.context_tiles(spark, str(folder)).collect()}
    assert set(rows) == {"a", "b", "c"}
    assert rows["a"]["osm_feature_count"] == 3 and rows["a"]["osm_industrial_count"] is None
    assert rows["b"]["osm_min_distance_m"] is None
    assert rows["c"]["osm_feature_count"] == 4 and rows["c"]["osm_min_distance_m"] == 2000.0


@pytest.mark.parametrize("bad", ["x", "1.5", "99999999999"])
def test_strict_scan_refuses_what_is_no_number(spark, tmp_path, bad):
    _put(tmp_path, "tile_1.csv", f"{HEAD}\na,1.0,2.0,{bad},1,1,1,10.5\n")
    with pytest.raises(PySparkException, match="not a value"):
        files.context_tiles(spark, str(tmp_path)).collect()
    wanted = spark.createDataFrame([("a",)], "grid_id string")
    assert files.context_tiles_lenient(spark, str(tmp_path), wanted).first()["osm_feature_count"] is None


def test_many_headers_are_one_scan(spark, tmp_path):
    for i in range(40):
        names = HEAD.split(",")
        names = names[i % 8 :] + names[: i % 8] + [f"more_{j}" for j in range(i)]
        values = {c: "1" for c in names} | {"grid_id": f"g{i}", "osm_feature_count": str(i)}
        _put(tmp_path, f"{i}.csv", ",".join(names) + "\n" + ",".join(values[c] for c in names) + "\n")
    table = files.context_tiles(spark, str(tmp_path))
    assert table._jdf.queryExecution().executedPlan().toString().count("FileScan csv") == 1
    assert {r["grid_id"]: r["osm_feature_count"] for r in table.collect()} == {f"g{i}": i for i in range(40)}


def test_heads_read_the_first_bytes_only(spark, tmp_path, monkeypatch):
    _put(tmp_path, "big.csv", "a,b\n" + "1,2\n" * 200_000)
    _put(tmp_path, "long.csv", ",".join(f"c{i}" for i in range(30_000)))
    _put(tmp_path, "blank.csv", "\n \n")
    got = {r["file"].rsplit("/", 1)[1]: r["columns"] for r in heads.csv_heads(spark, str(tmp_path)).collect()}
    assert [c["name"] for c in got["big.csv"]] == ["a", "b"] and len(got["long.csv"]) == 30_000
    assert got["blank.csv"] is None
    read = []

    class Counted(pa.PythonFile):
        def read(self, size=None):
            read.append(size)
            return super().read(size)

    class System:
        def open_input_stream(self, place):
            return Counted(open(place, "rb"), mode="r")

    monkeypatch.setattr(heads, "_open", lambda path: (System(), path))
    assert heads._first_line(str(tmp_path / "big.csv")) == "a,b" and sum(read) == heads._PIECE
    # A file system that tasks cannot open by themselves has its text scanned, with the same result.
    monkeypatch.setattr(heads, "_OPENED", ())
    scanned = {r["file"].rsplit("/", 1)[1]: r["columns"] for r in heads.csv_heads(spark, str(tmp_path)).collect()}
    assert {k: v and [c["name"] for c in v] for k, v in scanned.items()} == {k: v and [c["name"] for c in v] for k, v in got.items()}


def test_differences_per_file(spark, tmp_path):
    spark.range(3).selectExpr("id", "cast(id as int) n", "current_date() d").coalesce(1).write.parquet(f"{tmp_path}/p/k=1")
    spark.range(0).selectExpr("cast(id as string) id").coalesce(1).write.parquet(f"{tmp_path}/p/k=2")
    expected = spark.range(0).selectExpr("id", "cast(id as bigint) n").schema
    found = heads.differences(heads.parquet_footers(spark, f"{tmp_path}/p/*/*.parquet"), expected).collect()
    assert sorted((r["file"].rsplit("/", 2)[1], r["column"], r["finding"]) for r in found) == [
        ("k=1", "d", "extra"), ("k=1", "n", "type"), ("k=2", "id", "type"), ("k=2", "n", "missing"),
    ]
    _put(tmp_path, "t.csv", "n,x\n1,2\n")
    _put(tmp_path, "u.csv", "\n")
    found = heads.differences(heads.csv_heads(spark, f"{tmp_path}/*.csv"), expected).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["column"], r["finding"]) for r in found) == [
        ("t.csv", "id", "missing"), ("t.csv", "x", "extra"), ("u.csv", "id", "missing"), ("u.csv", "n", "missing"),
    ]
