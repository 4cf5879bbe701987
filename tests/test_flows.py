"""End-to-end flows: build, extract with resume, refresh, enrich."""

from pyspark.sql import functions as F

from emberfield import schemas
from emberfield.operators import context, spatial
from emberfield.plans import flows
from emberfield.sinks import tables as sinks
from emberfield.sources import files, views


def test_build_extract_resume_refresh_enrich(spark, sf_dir, tmp_path):
    paths = {n: str(tmp_path / n) for n in ("archive", "cells", "tiles", "manifest", "events")}
    columns = [f.name for f in schemas.ARCHIVE_DETECTIONS.fields]
    sinks.write_csv(views.detections(spark, sf_dir).select(*columns), paths["archive"])
    table = flows.build_cell_table(spark, paths["archive"], paths["cells"], "1")
    assert table.count() == 1420

    objects = views.map_objects(spark, sf_dir)
    some = flows.extract_context(table, objects, paths["tiles"], paths["manifest"], 2, sample_size=5)
    assert some == 5
    rest = flows.extract_context(table, objects, paths["tiles"], paths["manifest"], 2)
    assert rest == spatial.active_tiles(table, 2).count() - 5
    assert flows.extract_context(table, objects, paths["tiles"], paths["manifest"], 2) == 0
    # A reported success without stored context is done again.
    sinks.append_manifest(
        files.tile_manifest(spark, paths["manifest"]).limit(1).withColumn("tile_id", F.lit("0.000000_0.000000")),
        paths["manifest"],
    )
    assert flows.extract_context(table, objects, paths["tiles"], paths["manifest"], 2) == 0

    whole = flows.assemble_context(table, paths["tiles"])
    summary = context.coverage_summary(whole).first()
    assert summary["cells"] == 1420 and 0 < summary["queried_cells"] < 1420
    want = spatial.radius_context(
        spatial.cells_in_tiles(table, spatial.active_tiles(table, 2)), spatial.relevant_objects(objects)
    )
    stored = sinks.stored_tiles(spark, paths["tiles"]).select(*want.columns)
    assert stored.exceptAll(want).count() == 0 and stored.count() == want.count()

    raw = views.live_detections(spark, sf_dir, repeats=True)
    for version in ("1", "2"):
        live = flows.refresh_live_events(raw, views.boundary(spark), paths["events"], version)
        assert live.count() == 10
    enriched = flows.enrich_events(spark, paths["events"], paths["tiles"], "3")
    audit = context.provenance_audit(enriched).first()
    known = live.join(stored, "grid_id", "left_semi").count()
    assert audit["live_total"] == 10 and audit["verified_osm"] == known


def test_objects_per_tile(spark):
    rows = [("a", 10.1, 70.1), ("b", 10.249, 70.1), ("c", 10.251, 70.249), ("d", 12.0, 70.1)]
    objects = spark.createDataFrame(rows, "osm_id string, latitude double, longitude double")
    got = {r["tile_id"]: r["n"] for r in spatial.objects_per_tile(objects, 2000.0).collect()}
    assert got["10.000000_70.000000"] == 3
    assert got["10.250000_70.000000"] == 2
    assert got["10.000000_70.250000"] == 1 and got["10.250000_70.250000"] == 1
    assert got["12.000000_70.000000"] == 1 and got["11.750000_70.000000"] == 1
