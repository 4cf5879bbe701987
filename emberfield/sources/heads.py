"""What files say of themselves: header lines and footers, one row per file.

Spark lists the files; tasks open what is listed and read the first bytes of a text file, or the
footer of a Parquet file. File contents are not scanned. Types are written as Spark writes them.
"""

from __future__ import annotations

import csv
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import from_arrow_type

_PIECE = 65_536
_COLUMNS = "array<struct<name:string,type:string>>"
_ROWS = f"file string, length long, head string, columns {_COLUMNS}"

#: Schemes whose files a task opens by itself. Text files elsewhere are scanned for their first line.
_OPENED = ("file", "hdfs", "s3", "s3a", "gs")


def _open(path: str) -> tuple[fs.FileSystem, str]:
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    return fs.FileSystem.from_uri(f"{'s3' if scheme == 's3a' else scheme}:{rest}")


def _first_line(path: str) -> str | None:
    """The first line that is not blank, of a plain or compressed file; nothing if there is none."""
    system, place = _open(path)
    read, ended = b"", False
    with system.open_input_stream(place) as stream:
        while not ended:
            piece = stream.read(_PIECE)
            read, ended = read + piece, not piece
            lines = read.replace(b"\r", b"\n").split(b"\n")
            for line in lines if ended else lines[:-1]:
                text = line.decode("utf-8", "replace").removeprefix("\ufeff")
                if text.strip():
                    return text
    return None


def _names(line: str) -> list[dict]:
    return [{"name": name.strip(), "type": None} for name in next(csv.reader([line]))]


def _footer(path: str) -> list[dict]:
    system, place = _open(path)
    with system.open_input_file(place) as opened:
        schema = pq.read_schema(opened)
    return [{"name": f.name, "type": from_arrow_type(f.type).simpleString()} for f in schema]


_SHAPE = pa.schema(
    [
        ("file", pa.string()), ("length", pa.int64()), ("head", pa.string()),
        ("columns", pa.list_(pa.struct([("name", pa.string()), ("type", pa.string())]))),
    ]
)


def _read(batches: Iterator[pa.RecordBatch], kind: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            head = _first_line(row["path"]) if kind == "csv" else None
            columns = _footer(row["path"]) if kind == "parquet" else _names(head) if head else None
            rows.append({"file": row["file"], "length": row["length"], "head": head, "columns": columns})
        yield pa.RecordBatch.from_pylist(rows, schema=_SHAPE)


def listing(spark: SparkSession, path: str) -> DataFrame:
    """``path``, ``file`` (as ``_metadata`` names it) and ``length``; file contents are not read.

    Spark's scans pass over files of zero length, so these have no row.
    """
    return spark.read.format("binaryFile").load(path).select(
        "path", F.col("_metadata.file_path").alias("file"), "length"
    )


def csv_heads(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length, head, columns)`` of each text file; ``columns`` is null without a line that is not blank."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.getUri().getScheme() in _OPENED:
        return listing(spark, path).mapInArrow(lambda it: _read(it, "csv"), _ROWS)
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"), "value",
        F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"),
    )
    first = lines.where((F.col("start") == 0) & (F.trim("value") != "")).groupBy("file").agg(
        F.min_by("value", "at").alias("head")
    )
    columns = F.transform(
        F.split("head", ","),
        lambda c: F.struct(F.trim(c).alias("name"), F.lit(None).cast("string").alias("type")),
    )
    return listing(spark, path).drop("path").join(first, "file", "left").select(
        "file", "length", "head", columns.alias("columns")
    )


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """``(file, length, head, columns)`` of each Parquet file, with the types of its columns.

    Partition columns are part of a file's path and not of its footer, so they are not listed.
    """
    return listing(spark, path).mapInArrow(lambda it: _read(it, "parquet"), _ROWS)


def names(columns: str | Column = "columns") -> Column:
    return F.transform(columns, lambda c: c["name"])


def differences(heads: DataFrame, expected: T.StructType) -> DataFrame:
    """``(file, column, finding)``: columns a file lacks (missing), has besides (extra), or has with another type (type).

    Each file is judged by itself, without a shuffle. A file without any columns lacks them all. Headers
    of text files have no types, so those are not judged.
    """
    want = F.array(
        *[F.struct(F.lit(f.name).alias("name"), F.lit(f.dataType.simpleString()).alias("type")) for f in expected]
    ).cast(_COLUMNS)
    have = F.coalesce(F.col("columns"), F.array().cast(_COLUMNS))

    def found(which: Column, finding: str) -> Column:
        return F.transform(which, lambda c: F.struct(c["name"].alias("column"), F.lit(finding).alias("finding")))

    def among(columns: Column, name: Column) -> Column:
        return F.exists(columns, lambda c: c["name"] == name)

    missing = F.filter(want, lambda c: ~among(have, c["name"]))
    extra = F.filter(have, lambda c: ~among(want, c["name"]))
    other = F.filter(have, lambda c: F.exists(want, lambda w: (w["name"] == c["name"]) & (w["type"] != c["type"])))
    return heads.select(
        "file", F.inline(F.concat(found(missing, "missing"), found(extra, "extra"), found(other, "type")))
    )
