"""Where intermediate tables go, and who deletes them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

#: Whether Spark deletes the shuffle files of a query when it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

#: Bytes of an Arrow batch. A task holds a batch several times over, in Python and outside the JVM's heap.
_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 8 << 20
#: For steps that take small slices of their texts anyway.
FINE_BYTES = 2 << 20
#: The size that this module has set last, by application.
_GIVEN: dict[str, str] = {}

#: Run folders that have an owner, by application.
_OWNED: set[str] = set()


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    context = spark.sparkContext
    place = context._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(context._jsc.hadoopConfiguration())


def scratch_root(spark: SparkSession) -> str:
    """The folder of this run, below the shared folder that ``spark.checkpoint.dir`` names.

    Where the setting is missing, the run folder lies in the warehouse, which a cluster shares as well. The
    application owns the folder: it is deleted when the driver's JVM ends.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    folder = f"{shared.rstrip('/')}/_emberfield-{spark.sparkContext.applicationId}"
    if folder not in _OWNED:
        _OWNED.add(folder)
        place, files = _path(spark, folder)
        files.mkdirs(place)
        files.deleteOnExit(place)
        # Once for the session, so that writes in several threads do not undo each other's setting.
        spark.conf.set(_CLEANUP, "true")
    return folder


def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> None:
    """Let texts go to Python in batches of ``size`` bytes where the session has no setting of its own.

    The setting stays until an operator asks for another size, since a table is computed after the operator has returned it.
    """
    application = spark.sparkContext.applicationId
    if spark.conf.get(_BATCH_BYTES, None) in (None, _GIVEN.get(application)):
        _GIVEN[application] = str(size)
        spark.conf.set(_BATCH_BYTES, size)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new, unused path under the run folder."""
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to shared storage and read it back.

    Cuts the lineage in a way that survives the loss of executors: a consumer
    that is re-run reads files, it does not recompute the producer. The shuffle
    files of the write go as soon as it has ended.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    place, files = _path(spark, path)
    return files.exists(place)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    place, files = _path(spark, path)
    files.delete(place, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table that ``materialize`` wrote and that nothing reads any more."""
    spark = df.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in df.inputFiles()}:
        if f"/_emberfield-{spark.sparkContext.applicationId}/" in folder:
            remove(spark, folder)
