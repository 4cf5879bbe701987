"""Writers of snapshots, tiles, manifests, reports and CSV exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from emberfield import schemas
from emberfield.constants import TILE_SIZE
from emberfield.functions import grid
from emberfield.session import exists, materialize
from emberfield.sinks import store


_VERSIONS = T.StructType(
    [T.StructField("version", T.StringType()), T.StructField("path", T.StringType()), T.StructField("number", T.LongType())]
)


def publish_snapshot(df: DataFrame, root: str, version: str) -> str:
    """Write a complete new version beside the old ones, then announce it.

    Readers follow the newest announced version, so they see the old table
    until the write job has committed, and a failed job changes nothing. The
    input may be the current version: nothing announced is overwritten. Files
    left by an attempt that died before its announcement are replaced.
    """
    path = f"{root}/snapshot={version}"
    if has_snapshot(df.sparkSession, root, version):
        raise ValueError(f"version {version} is already published")
    df.write.mode("overwrite").parquet(path)
    row = df.sparkSession.createDataFrame([(version, path, count_snapshots(df.sparkSession, root) + 1)], _VERSIONS)
    row.coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return path


def has_snapshot(spark: SparkSession, root: str, version: str | None = None) -> bool:
    """Whether this version (or any version) has been announced."""
    if not exists(spark, f"{root}/versions"):
        return False
    found = spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    if version is not None:
        found = found.where(F.col("version") == version)
    return not found.isEmpty()


def newest_snapshot(spark: SparkSession, root: str) -> str:
    """Folder of the version that was announced last, whatever its name."""
    versions = spark.read.schema(_VERSIONS).parquet(f"{root}/versions")
    return versions.agg(F.max_by("path", "number").alias("path")).first()["path"]


def count_snapshots(spark: SparkSession, root: str) -> int:
    """Number of announced versions."""
    if not exists(spark, f"{root}/versions"):
        return 0
    return spark.read.schema(_VERSIONS).parquet(f"{root}/versions").count()


def write_event_table(df: DataFrame, root: str, version: str) -> int:
    """Publish the whole event table, clustered by place (see `store`)."""
    return store.rewrite(df, root, version)


def write_context_tiles(context: DataFrame, root: str) -> None:
    """Store context tiles; tiles in the input replace their stored version.

    Rows of tiles that the input touches are written again with their other tiles kept. All tiles of a write become visible
    with one announcement, so a write that dies half-way leaves the old state, and readers never see a mix.
    """
    lat, lon = F.col("lat_grid"), F.col("lon_grid")
    fresh = materialize(context.withColumn("tile_id", grid.tile_key(lat, lon, TILE_SIZE)), "fresh-tiles")
    spark = context.sparkSession
    store.merge(fresh, root, f"tiles-{store.newest(spark, root) + 1}", "tile_id", "lat_grid", "lon_grid")
    store.expire(spark, root)


_TILE_TABLE = T.StructType([*schemas.CONTEXT_TILE.fields, T.StructField("tile_id", T.StringType())])


def stored_tiles(spark: SparkSession, root: str) -> DataFrame:
    """Context rows of all stored tiles (none when nothing was stored yet)."""
    return store.read(spark, root, _TILE_TABLE)


def stored_tile_ids(spark: SparkSession, root: str) -> DataFrame:
    return stored_tiles(spark, root).select("tile_id").distinct()


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").option("header", True).csv(path)


def append_manifest(rows: DataFrame, path: str) -> None:
    """Append tile outcomes; history is kept, the latest row decides."""
    ordered = rows.select(*[F.col(f.name).cast(f.dataType) for f in schemas.TILE_MANIFEST.fields])
    ordered.write.mode("append").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A metric table as JSON lines."""
    df.write.mode("errorifexists").json(path)
