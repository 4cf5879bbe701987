"""Rows stored by place, in versions that name their files.

Data files are never changed. A version is a list of files with the tile row (0.25 degrees of latitude) and the
range of places that each holds; announcing it is one commit of one small file, so readers see a whole old or a
whole new version, of however many tiles. Version numbers rise in the order of announcement, whatever the names.
A write that dies before its announcement leaves files that nobody reads; the next one with its name writes its own.

A place is the cell's position on a space-filling curve, so a search box is a few ranges of places: files outside are not
opened, and in the others the ranges reach Parquet as pushed filters. There must be one writer at a time.
"""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from emberfield.constants import TILE_SIZE
from emberfield.functions import grid
from emberfield.session import exists, remove

#: Versions that stay readable after `expire`, and files of a tile row above which `compact` rewrites it.
KEPT_VERSIONS = 3
MAX_FILES = 32

FILES = T.StructType(
    [
        T.StructField("number", T.LongType()),
        T.StructField("name", T.StringType()),
        T.StructField("file", T.StringType()),
        T.StructField("tile_row", T.IntegerType()),
        T.StructField("low", T.LongType()),
        T.StructField("high", T.LongType()),
        T.StructField("rows", T.LongType()),
    ]
)
_NOWHERE = -1000


def tile_row(lat: Column) -> Column:
    """Number of the row of tiles, at most 721 on the globe; rows without a position share one."""
    usable = lat.isNotNull() & ~F.isnan(lat)
    return F.when(usable, F.floor(grid.snap(lat) / F.lit(TILE_SIZE)).cast("int")).otherwise(F.lit(_NOWHERE))


def _placed(rows: DataFrame, lat: str, lon: str) -> DataFrame:
    return rows.withColumns(
        {"tile_row": tile_row(F.col(lat)), "place": grid.place_code(F.col(lat), F.col(lon))}
    )


def _write(rows: DataFrame, root: str, lat: str, lon: str) -> DataFrame:
    """Write a part; returns its files. Files hold one tile row and a narrow range of places."""
    spark = rows.sparkSession
    part = f"{root}/parts/{uuid.uuid4().hex[:12]}"
    placed = _placed(rows, lat, lon)
    order = ["tile_row", "place"]
    placed.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("tile_row").parquet(part)
    stored = spark.read.schema(placed.schema).parquet(part)
    return stored.groupBy(F.col("_metadata.file_path").alias("file"), "tile_row").agg(
        F.min("place").alias("low"), F.max("place").alias("high"), F.count(F.lit(1)).alias("rows")
    )


def versions(spark: SparkSession, root: str) -> DataFrame:
    """Files of all versions; a row without a file stands for the version itself."""
    if not exists(spark, f"{root}/versions"):
        return spark.createDataFrame([], FILES)
    return spark.read.schema(FILES).parquet(f"{root}/versions")


def has_version(spark: SparkSession, root: str, name: str | None = None) -> bool:
    """Whether this version (or any) has been announced."""
    found = versions(spark, root)
    return not (found if name is None else found.where(F.col("name") == name)).isEmpty()


def newest(spark: SparkSession, root: str) -> int:
    """Number of the newest version, 0 before the first."""
    return versions(spark, root).agg(F.coalesce(F.max("number"), F.lit(0))).first()[0]


def current_files(spark: SparkSession, root: str) -> DataFrame:
    return versions(spark, root).where((F.col("number") == newest(spark, root)) & F.col("file").isNotNull())


def announce(spark: SparkSession, root: str, name: str, files: DataFrame) -> int:
    """Make a list of files the newest version."""
    if has_version(spark, root, name):
        raise ValueError(f"version {name} is already published")
    number = newest(spark, root) + 1
    columns = [f.name for f in FILES.fields]
    mark = spark.createDataFrame([(number, name, None, None, None, None, 0)], FILES)
    rows = files.withColumns({"number": F.lit(number).cast("long"), "name": F.lit(name)}).select(*columns)
    mark.unionByName(rows).coalesce(1).write.mode("append").parquet(f"{root}/versions")
    return number


def rewrite(rows: DataFrame, root: str, name: str, lat: str = "latitude", lon: str = "longitude") -> int:
    """Publish a whole table."""
    return announce(rows.sparkSession, root, name, _write(rows, root, lat, lon))


def append(rows: DataFrame, root: str, name: str, lat: str = "latitude", lon: str = "longitude") -> int:
    """Publish the current rows and these."""
    spark = rows.sparkSession
    return announce(spark, root, name, current_files(spark, root).drop("number", "name").unionByName(_write(rows, root, lat, lon)))


def merge(rows: DataFrame, root: str, name: str, key: str, lat: str = "latitude", lon: str = "longitude") -> int:
    """Publish a version in which these rows replace the stored ones with the same key.

    A key must say the place: only the tile rows of the given rows are read and written again, all other
    files are shared with the version before.
    """
    spark = rows.sparkSession
    files = current_files(spark, root)
    touched = [r[0] for r in rows.select(tile_row(F.col(lat)).alias("t")).distinct().collect()]  # at most 721
    stored = read(spark, root, rows.schema, tile_rows=touched)
    kept = stored.join(rows.select(key).distinct(), key, "left_anti").select(*rows.columns)
    fresh = _write(rows.unionByName(kept), root, lat, lon)
    shared = files.where(~F.col("tile_row").isin(touched)).drop("number", "name")
    return announce(spark, root, name, shared.unionByName(fresh))


def read(
    spark: SparkSession, root: str, schema: T.StructType, box: dict | None = None, tile_rows: list[int] | None = None
) -> DataFrame:
    """Rows of the newest version, of a search box (see `grid.search_box`) or of tile rows only.

    Only files that can hold such rows are opened. A box is a set of cells around the wanted area; the caller
    filters by position.
    """
    files = current_files(spark, root)
    ranges = grid.place_ranges(box) if box is not None else None
    if tile_rows is not None:
        files = files.where(F.col("tile_row").isin(tile_rows))
    if ranges is not None:
        south, north = (math.floor(x / TILE_SIZE) for x in box["lat"])
        files = files.where(
            F.col("tile_row").between(south - 1, north + 1) & _any([(F.col("low") <= b) & (F.col("high") >= a) for a, b in ranges])
        )
    paths = [r["file"] for r in files.select("file").collect()]
    if not paths:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(T.StructType([*schema.fields, T.StructField("place", T.LongType())])).parquet(*paths)
    if ranges is not None:
        rows = rows.where(_any([F.col("place").between(a, b) for a, b in ranges]))
    return rows.drop("place")


def _any(conditions: list[Column]) -> Column:
    out = F.lit(False)
    for one in conditions:
        out = out | one
    return out


def compact(spark: SparkSession, root: str, schema: T.StructType, name: str, lat: str = "latitude", lon: str = "longitude") -> bool:
    """Rewrite tile rows that have more than ``MAX_FILES`` files; whether there were any."""
    files = current_files(spark, root)
    crowded = [r[0] for r in files.groupBy("tile_row").count().where(F.col("count") > MAX_FILES).select("tile_row").collect()]
    if not crowded:
        return False
    fresh = _write(read(spark, root, schema, tile_rows=crowded), root, lat, lon)
    announce(spark, root, name, files.where(~F.col("tile_row").isin(crowded)).drop("number", "name").unionByName(fresh))
    return True


def expire(spark: SparkSession, root: str, keep: int = KEPT_VERSIONS) -> int:
    """Forget all but the newest versions and delete the files that only the others name; returns their number."""
    every = spark.read.schema(FILES).parquet(f"{root}/versions").withColumn("list", F.col("_metadata.file_path"))
    first = newest(spark, root) - keep + 1
    old, new = every.where(F.col("number") < first), every.where(F.col("number") >= first)
    unused = old.select("file").join(new.select("file"), "file", "left_anti").where("file is not null").distinct()
    # The lists go first: a reader never finds a version whose files are gone.
    gone, lists = [r[0] for r in unused.collect()], [r[0] for r in old.select("list").distinct().collect()]
    for path in [*lists, *gone]:
        remove(spark, path)
    return len(gone)
