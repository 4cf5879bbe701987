"""Event table, context updates, constraints, requests."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from emberfield import schemas
from emberfield.operators import context, events


def _events(spark, rows):
    full = []
    for r in rows:
        base = {f.name: None for f in schemas.EVENTS.fields}
        base.update({"active_days": 1, "observation_count": 1, "latitude": 10.0, "longitude": 70.0, "osm_context_available": False})
        base.update(r)
        full.append(tuple(base[f.name] for f in schemas.EVENTS.fields))
    return spark.createDataFrame(full, schemas.EVENTS)


def test_snapshot_replace(spark):
    old = _events(spark, [
        {"event_id": "firms-a", "grid_id": "a"},
        {"event_id": "manual-b", "grid_id": "b", "active_days": 7},
        {"event_id": "manual-c", "grid_id": "c"},
    ])
    new = _events(spark, [{"event_id": "firms-b", "grid_id": "b"}, {"event_id": "firms-d", "grid_id": "d"}])
    got = {r["grid_id"]: (r["event_id"], r["active_days"]) for r in events.replace_snapshot(old, new).collect()}
    assert got == {"b": ("firms-b", 1), "c": ("manual-c", 1), "d": ("firms-d", 1)}


def test_repeated_grid_id_in_a_snapshot_fails(spark):
    twice = _events(spark, [{"event_id": "firms-b", "grid_id": "b"}] * 2)
    with pytest.raises(PySparkException, match="duplicate key"):
        events.replace_snapshot(twice.limit(0), twice).collect()


def test_context_update_resets_only_live_events(spark):
    table = _events(spark, [
        {"event_id": "firms-a", "grid_id": "a", "osm_context_available": True, "osm_feature_count": 9},
        {"event_id": "firms-b", "grid_id": "b"},
        {"event_id": "manual-c", "grid_id": "c", "osm_context_available": True, "osm_feature_count": 4},
    ])
    fresh = spark.createDataFrame([("b", 0, 0, 0, 0, 2000.0), ("c", 8, 8, 8, 8, 1.0)], "grid_id string, osm_feature_count int, osm_industrial_count int, osm_power_count int, osm_manmade_count int, osm_min_distance_m double")
    got = {r["grid_id"]: r for r in context.update_context(table, fresh).collect()}
    assert (got["a"]["osm_context_available"], got["a"]["osm_feature_count"]) == (False, None)
    assert (got["b"]["osm_context_available"], got["b"]["osm_feature_count"]) == (True, 0)
    assert got["c"]["osm_feature_count"] == 4
    audit = context.provenance_audit(context.update_context(table, fresh)).first()
    assert tuple(audit) == (2, 1, 1, 0)


def test_unknown_stays_unknown(spark):
    cells = spark.createDataFrame([("a", 1.0, 1.0), ("b", 2.0, 2.0)], "grid_id string, lat_grid double, lon_grid double")
    ctx = spark.createDataFrame([("a", 0, 0, 0, 0, 2000.0)], "grid_id string, osm_feature_count int, osm_industrial_count int, osm_power_count int, osm_manmade_count int, osm_min_distance_m double")
    got = {r["grid_id"]: r for r in context.assemble(cells, ctx).collect()}
    assert got["a"]["osm_feature_count"] == 0 and got["a"]["osm_context_available"]
    assert got["b"]["osm_feature_count"] is None and not got["b"]["osm_context_available"]
    report = context.integrity_report(context.assemble(cells, ctx), F.lit(2)).first()
    assert report["row_count_kept"] and report["available_but_missing"] == report["unavailable_but_present"] == 0
    with pytest.raises(PySparkException, match="duplicate key"):
        context.assemble(cells, ctx.union(ctx)).collect()


def test_manifest_last_status_and_resume(spark):
    rows = [("x", "failed", 1), ("x", "success", 2), ("y", "success", 1), ("z", "success", 1), ("z", "failed", 2)]
    manifest = spark.createDataFrame(rows, "tile_id string, status string, t int").withColumn("timestamp", F.timestamp_seconds("t"))
    tiles = spark.createDataFrame([("x",), ("y",), ("z",), ("w",)], "tile_id string")
    stored = spark.createDataFrame([("x",), ("z",)], "tile_id string")
    todo = context.tiles_to_do(tiles, manifest, stored)
    assert sorted(r["tile_id"] for r in todo.collect()) == ["w", "y", "z"]


def test_list_lookup_search(spark):
    table = _events(spark, [
        {"id": 1, "event_id": "e1", "grid_id": "10.0_70.0", "active_days": 3, "target_persistent_source": 1, "target_multiclass": 2},
        {"id": 2, "event_id": "e2", "grid_id": "10.1_70.0", "active_days": 9, "target_persistent_source": 0, "target_multiclass": 3},
        {"id": 3, "event_id": "E3", "grid_id": "10.2_70.0", "active_days": 9, "latitude": float("nan")},
    ])
    assert [r["id"] for r in events.list_hotspots(table).collect()] == [1, 2, 3]
    assert [r["id"] for r in events.list_hotspots(table, 4).collect()] == [2, 3]
    assert [r["id"] for r in events.list_hotspots(table, 1, True).collect()] == [1]
    for key in ("2", 2, "e2", "10.1_70.0"):
        assert events.find_hotspot(table, key).first()["id"] == 2
    assert events.find_hotspot(table, "none").first() is None
    assert events.search_events(table, "e3", need_position=False).count() == 1
    assert events.search_events(table, "e3").count() == 0
    assert events.search_events(table, classification="3").first()["id"] == 2
    texts = {r["id"]: r["classification_text"] for r in events.with_display_text(table).collect()}
    assert texts == {1: "Persistent thermal-source candidate", 2: "Other / ephemeral candidate", 3: "Not classified"}
    with pytest.raises(ValueError):
        events.list_hotspots(table, limit=10_001)


def test_request_ranges():
    events.check_search(31.224, 75.770, 2000)
    for bad in ((31.2, 75.7, 0), (123, 75.7, 2000), (31.2, 75.7, 100_001)):
        with pytest.raises(ValueError):
            events.check_search(*bad)


def test_record_rules_and_constraints(spark):
    rows = spark.createDataFrame(
        [("ok", 10.0, 1, 0.5), ("bad", 91.0, -1, 1.5), ("empty", None, None, None)],
        "k string, latitude double, observation_count int, night_ratio double",
    )
    rules = [("latitude", -90, 90), ("observation_count", 0, None), ("night_ratio", 0, 1)]
    good, bad = events.split_by_rules(rows, rules)
    assert sorted(r["k"] for r in good.collect()) == ["empty", "ok"]
    assert bad.first()["violations"] == ["latitude", "observation_count", "night_ratio"]
    table = _events(spark, [{"event_id": "x", "grid_id": "g", "latitude": 99.0, "target_multiclass": 4}] * 2)
    found = {r["rule"]: r["violations"] for r in events.table_violations(table).collect()}
    assert found["latitude_range"] == 2 and found["multiclass_label"] == 2
    assert found["event_id_unique"] == 1 and found["grid_id_unique"] == 1 and found["binary_label"] == 0


def test_statistics_of_unlabelled_events(spark):
    table = _events(spark, [{"event_id": "a", "grid_id": "a"}, {"event_id": "b", "grid_id": "b"}])
    row = events.event_statistics(table).first()
    assert (row["total_spatial_cells"], row["unclassified_candidate_cells"], row["labelled_candidate_cells"]) == (2, 2, 0)
    empty = events.event_statistics(table.limit(0)).first()
    assert empty["total_raw_observations"] == 0


def test_request_merge(spark):
    rows = spark.createDataFrame(
        [("e", None, 31.224, 75.77, 5.0, {"mean_frp": 9.0}), (None, None, 31.224, 75.77, 5.0, None), ("", None, None, None, None, None)],
        "event_id string, grid_id string, latitude double, longitude double, mean_frp double, features map<string,double>",
    )
    got = events.merge_request_features(rows, ["latitude", "longitude", "mean_frp"]).collect()
    assert [r["event_id"] for r in got] == ["e", "31.22_75.77", "unidentified-event"]
    assert [r["mean_frp"] for r in got] == [9.0, 5.0, None]
    assert got[0]["grid_id"] == "31.22_75.77"
