"""Request plan, stream drain equality, replay."""

import datetime as dt

from pyspark.sql import functions as F

from emberfield.sources import views
from emberfield.streaming import live


def test_twelve_days_in_chunks_of_five(spark):
    rows = [("s", dt.date(2024, 1, 1), dt.date(2024, 1, 12)), ("t", dt.date(2024, 1, 3), dt.date(2024, 1, 3)), ("u", dt.date(2024, 1, 3), dt.date(2024, 1, 2))]
    windows = spark.createDataFrame(rows, "source string, start date, end date")
    got = [(r["source"], r["chunk_start"].day, r["day_range"]) for r in live.date_chunks(windows).orderBy("source", "chunk_start").collect()]
    assert got == [("s", 1, 5), ("s", 6, 5), ("s", 11, 2), ("t", 3, 1)]


def test_drained_stream_equals_batch_and_survives_more_files(spark, sf_dir, tmp_path):
    raw = views.live_detections(spark, sf_dir, repeats=True)
    shapes = views.boundary(spark)
    landing, store, table, offsets = (str(tmp_path / n) for n in ("landing", "store", "events", "offsets"))
    for part in (raw.where("acq_time < 1200"), raw.where("acq_time >= 1100")):
        part.write.mode("append").parquet(landing)
        live.ingest(spark, landing, raw.schema, store, table, offsets, shapes).awaitTermination()
    got = live.ingested_events(spark, table)
    want = live.snapshot_of(raw, shapes)
    key = ["event_id", "observation_count", "active_days", "mean_frp", "first_seen"]
    assert got.count() == want.count() > 0
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0


def test_a_replayed_batch_changes_nothing(spark, sf_dir, tmp_path):
    raw = views.live_detections(spark, sf_dir)
    raw.write.parquet(str(tmp_path / "landing"))
    for offsets in ("first", "lost"):
        # Without its offsets the query starts over and delivers batch 0 again.
        live.ingest(
            spark, str(tmp_path / "landing"), raw.schema, str(tmp_path / "store"), str(tmp_path / "events"),
            str(tmp_path / offsets),
        ).awaitTermination()
    got, want = live.ingested_events(spark, str(tmp_path / "events")), live.snapshot_of(raw)
    key = ["event_id", "observation_count", "mean_frp"]
    assert got.count() == want.count()
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0


def test_stream_deduplication_operator(spark, tmp_path):
    rows = [(1.0, 2.0, "2024-01-01", 10, "N", 1.0, "s", 5)] * 3 + [(1.0, 2.0, "2024-01-01", 11, "N", 1.0, "s", 6)]
    ddl = "latitude double, longitude double, acq_date string, acq_time int, satellite string, frp double, source_dataset string, t int"
    df = spark.createDataFrame(rows, ddl).withColumn("at", F.timestamp_seconds("t"))
    df.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    query = (
        live.deduplicated_stream(stream, "at").writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "c")).option("path", str(tmp_path / "out"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_new_files_after_lost_offsets_reach_the_events(spark, sf_dir, tmp_path):
    raw = views.live_detections(spark, sf_dir)
    landing = str(tmp_path / "landing")
    for offsets, part in (("first", raw.where("acq_time < 1200")), ("lost", raw.where("acq_time >= 1200"))):
        part.write.mode("append").parquet(landing)
        live.ingest(
            spark, landing, raw.schema, str(tmp_path / "store"), str(tmp_path / "events"), str(tmp_path / offsets)
        ).awaitTermination()
    got, want = live.ingested_events(spark, str(tmp_path / "events")), live.snapshot_of(raw)
    key = ["event_id", "observation_count", "mean_frp"]
    assert got.count() == want.count()
    assert got.select(*key).exceptAll(want.select(*key)).count() == 0
