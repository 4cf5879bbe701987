"""File scans: detections, cells, context tiles, map objects, boundary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession, functions as F, types as T

from emberfield import schemas
from emberfield.constants import (
    BOUNDARY_CODE_KEYS,
    BOUNDARY_NAME_KEYS,
    CONTEXT_FEATURES,
    DETECTION_FEATURES,
    IDENTIFIERS,
    TARGETS,
)
from emberfield.functions import values as v
from emberfield.functions.ordered import keep_one
from emberfield.operators.context import unique_by
from emberfield.operators.normalize import number_column, prepare_archive
from emberfield.schemas import require_columns
from emberfield.sources import heads as file_heads


def _csv(spark: SparkSession, path, schema: T.StructType, **options) -> DataFrame:
    # enforceSchema=false checks every file's header against the schema.
    return spark.read.schema(schema).csv(path, header=True, enforceSchema=False, **options)


#: Texts that the published reader takes for a missing value.
_MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
    "NaN", "None", "n/a", "nan", "null",
)


def archive_detections(spark: SparkSession, path: str) -> DataFrame:
    """Archive CSV with flags and confidence score.

    Confidence is a number when every value of the file set that is not missing is one, and
    is then the score itself; a missing one has no score. Else it is text, scored by its letters.
    Letters end the look at their first row; numbers take one more scan of the column.
    """
    table = _csv(spark, path, schemas.ARCHIVE_DETECTIONS)
    number = v.to_number(F.col("confidence"))
    if table.where(number.isNull() & ~F.col("confidence").isin(*_MISSING)).isEmpty() and not table.isEmpty():
        table = table.withColumn("confidence", number)
    return prepare_archive(table)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and sizes; file contents are not read."""
    return file_heads.listing(spark, path).select("path", "length")


def newest_file(spark: SparkSession, path: str) -> str:
    """The last file by name."""
    found = list_files(spark, path).agg(F.max("path").alias("path")).first()["path"]
    if found is None:
        raise FileNotFoundError(path)
    return found


def _typed(text: Column, kind: T.DataType, strict: bool) -> Column:
    """The value of a field; a strict reading refuses what is neither a value nor missing."""
    if kind == T.StringType():
        return text
    if isinstance(kind, (T.IntegerType, T.LongType)):
        # Writers of tables with gaps put whole numbers as 3.0.
        number = text.try_cast("double")
        whole = F.when(number == F.floor(number), number.try_cast("bigint"))
        value = F.coalesce(text.try_cast("bigint"), whole).try_cast(kind)
    else:
        value = text.try_cast(kind)
    blank = text.isNull() | F.trim(text).isin(*_MISSING)
    refused = F.raise_error(F.concat(F.lit(f"not a value of type {kind.simpleString()}: "), text)).cast(kind)
    return F.when(~blank, F.when(value.isNull(), refused).otherwise(value) if strict else value)


def _lacking(fields: list[T.StructField]) -> Column:
    return F.array_sort(F.array_except(F.array(*[F.lit(f.name) for f in fields]), "names"))


def _heads(spark: SparkSession, path: str, fields: list[T.StructField]) -> tuple[DataFrame, Row]:
    """The files with a header, and one row about them: the widest, how many kinds, one kind, how many have
    all ``fields``, what one of the others lacks, a reply that is no table, the fields that some file has."""
    heads = file_heads.csv_heads(spark, path).where("columns is not null").select(
        "file", "head", file_heads.names().alias("names")
    )
    absent = _lacking(fields)
    facts = heads.agg(
        F.max(F.size("names")).alias("width"),
        F.count_distinct("names").alias("kinds"),
        F.min("names").alias("names"),
        F.count_if(F.size(absent) == 0).alias("complete"),
        F.max(F.when(F.size(absent) > 0, F.array_join(absent, ", "))).alias("lack"),
        F.max(F.when(F.size("names") < 2, F.col("head"))).alias("reply"),
        *[F.max(F.array_contains("names", f.name)).alias(f"has_{i}") for i, f in enumerate(fields)],
    )
    return heads, facts.first()


def _read_named(
    spark: SparkSession, path: str, heads: DataFrame, facts: Row, fields: list[T.StructField], strict: bool
) -> DataFrame:
    """Fields by name, each file in its own order of columns; ``_file`` is the file.

    One scan whatever the headers: fields are read by place. Where all headers agree, the place is a
    constant and only the wanted columns are parsed; else it comes with the header of the file.
    Files that are not in ``heads`` add no rows.
    """
    places = [f"_{i}" for i in range(facts["width"])]
    schema = T.StructType([T.StructField(c, T.StringType()) for c in places])
    rows = spark.read.schema(schema).csv(path, header=True)
    file = F.col("_metadata.file_path").alias("_file")
    if facts["kinds"] == 1:
        at = {name: places[i] for i, name in reversed(list(enumerate(facts["names"])))}
        picked = rows.select(
            *[(F.col(at[f.name]) if f.name in at else F.lit(None).cast("string")).alias(f.name) for f in fields], file
        )
    else:
        place = F.array(*[F.array_position("names", F.lit(f.name)).cast("int") - 1 for f in fields])
        known = heads.select(F.col("file").alias("_file"), place.alias("_at"))
        # Places are below 0 where a file lacks the field; such an index has no value.
        picked = rows.select(F.array(*places).alias("_row"), file).join(known, "_file").select(
            *[F.get("_row", F.get("_at", i)).alias(f.name) for i, f in enumerate(fields)], "_file"
        )
    return picked.select(*[_typed(F.col(f.name), f.dataType, strict).alias(f.name) for f in fields], "_file")


def cell_table(spark: SparkSession, path: str) -> DataFrame:
    """Cell feature CSV; required columns are checked by name in each header.

    Columns beyond the required ones may be absent and are then null. A number that is not one is an error.
    """
    required = [*IDENTIFIERS, *DETECTION_FEATURES, *TARGETS]
    heads, facts = _heads(spark, path, [schemas.CELLS[c] for c in required])
    if not facts["kinds"]:
        raise FileNotFoundError(path)
    if facts["lack"]:
        raise ValueError("missing required columns: " + facts["lack"])
    return _read_named(spark, path, heads, facts, schemas.CELLS.fields, strict=True).drop("_file")


_TILE_REQUIRED = [f for f in schemas.CONTEXT_TILE.fields if f.name in {"grid_id", *CONTEXT_FEATURES}]


def context_tiles(spark: SparkSession, path: str, per_file: bool = False) -> DataFrame:
    """Context tiles, strict: complete headers, no grid id twice, no number that is not one.

    ``per_file`` adds the stricter reading: no file without rows, and grid ids
    unique inside each file (reported as such before the global check).
    """
    heads, facts = _heads(spark, path, _TILE_REQUIRED)
    if not facts["kinds"]:
        raise FileNotFoundError(path)
    if facts["lack"]:
        raise ValueError("context tile lacks columns: " + facts["lack"])
    out = _read_named(spark, path, heads, facts, schemas.CONTEXT_TILE.fields, strict=True)
    if per_file:
        listed = file_heads.listing(spark, path).select(F.col("file").alias("_file"))
        first = listed.join(out.select("_file").distinct(), "_file", "left_anti").limit(1).collect()
        if first:
            raise ValueError("empty context file: " + first[0]["_file"].rsplit("/", 1)[-1])
        out = unique_by(out, ["_file", "grid_id"])
    return unique_by(out.drop("_file"), ["grid_id"])


def context_tiles_lenient(spark: SparkSession, path: str, wanted_ids: DataFrame) -> DataFrame:
    """Context tiles, lenient: files with a short header are skipped, the last
    duplicate (by file name) is kept, only wanted ids remain, and a number that is not one is null."""
    heads, facts = _heads(spark, path, _TILE_REQUIRED)
    if not facts["complete"]:
        raise FileNotFoundError(f"no valid context tile in {path}")
    out = _read_named(spark, path, heads.where(F.size(_lacking(_TILE_REQUIRED)) == 0), facts, _TILE_REQUIRED, strict=False)
    wanted = out.join(wanted_ids.select("grid_id"), "grid_id", "left_semi")
    return keep_one(wanted, ["grid_id"], ["_file", *CONTEXT_FEATURES], last=True).drop("_file")


def grid_scan(cells: DataFrame) -> DataFrame:
    """Grid keys with numeric coercion; NULL keys and repeated ids are errors."""
    require_columns(cells, [*IDENTIFIERS, "observation_count"])
    coerced = cells.select(
        F.col("grid_id").cast("string").alias("grid_id"),
        *[number_column(cells, c).alias(c) for c in ("lat_grid", "lon_grid", "observation_count")],
    )
    bad = F.col("grid_id").isNull() | F.col("lat_grid").isNull() | F.col("lon_grid").isNull()
    checked = F.when(~bad, F.lit(True)).otherwise(
        F.raise_error(F.lit("grid contains invalid identifiers or coordinates")).cast("boolean")
    )
    return unique_by(coerced.where(checked), ["grid_id"])


def map_elements(spark: SparkSession, path: str, one_document_per_file: bool = True) -> DataFrame:
    """Cached map JSON to raw elements; documents are files or lines."""
    return (
        spark.read.schema(schemas.MAP_ELEMENTS_JSON)
        .json(path, multiLine=one_document_per_file)
        .select(F.inline("elements"))
    )


def parse_elements(elements: DataFrame) -> DataFrame:
    """Nodes by position, ways and relations by center; one row per object id."""
    is_node = F.col("type") == "node"
    located = elements.where(F.col("type").isNotNull() & F.col("id").isNotNull()).select(
        F.concat_ws(":", "type", F.col("id").cast("string")).alias("osm_id"),
        F.when(is_node, F.col("lat")).otherwise(F.col("center.lat")).alias("latitude"),
        F.when(is_node, F.col("lon")).otherwise(F.col("center.lon")).alias("longitude"),
        F.coalesce("tags", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))).alias("tags"),
    )
    present = located.where("latitude is not null and longitude is not null")
    return keep_one(
        present, ["osm_id"], ["latitude", "longitude", F.to_json("tags")]
    )


def boundary_shapes(
    spark: SparkSession, path: str, code: str, name: str, one_document_per_file: bool = True
) -> DataFrame:
    """Polygons of the features matching an ISO code or a name."""
    features = (
        spark.read.schema(schemas.BOUNDARY_JSON)
        .json(path, multiLine=one_document_per_file)
        .select(F.inline("features"))
    )
    props = F.col("properties")
    codes = F.array(*[F.upper(F.element_at(props, k)) for k in BOUNDARY_CODE_KEYS])
    names = F.array(*[F.lower(F.trim(F.element_at(props, k))) for k in BOUNDARY_NAME_KEYS])
    match = F.array_contains(F.array_compact(codes), code.upper()) | F.array_contains(
        F.array_compact(names), name.strip().lower()
    )
    kind, text = F.col("geometry.type"), F.col("geometry.coordinates")
    ring = "array<array<array<double>>>"
    polygons = (
        F.when(kind == "Polygon", F.array(F.from_json(text, ring)))
        .when(kind == "MultiPolygon", F.from_json(text, f"array<{ring}>"))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported geometry: "), kind)))
    )
    return features.where(match & F.col("geometry").isNotNull()).select(polygons.alias("polygons"))


def landing_csv(spark: SparkSession, path: str) -> DataFrame:
    """Downloaded CSV bodies: empty files add no rows, text replies are errors."""
    fields = schemas.LIVE_DETECTIONS_RAW.fields
    heads, facts = _heads(spark, path, fields)
    if facts["reply"] is not None:
        raise ValueError(f"unexpected response: {facts['reply'][:300]}")
    if not facts["kinds"]:
        return spark.createDataFrame([], schemas.LIVE_DETECTIONS_RAW)
    present = [f for i, f in enumerate(fields) if facts[f"has_{i}"]]
    return _read_named(spark, path, heads, facts, present, strict=False).drop("_file")


def tile_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The tile manifest; an empty table when none was written yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(schemas.TILE_MANIFEST).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schemas.TILE_MANIFEST)


def event_table(spark: SparkSession, root: str) -> DataFrame:
    """The newest version of a stored event table, with the alias columns."""
    from emberfield.operators.events import scan_events
    from emberfield.sinks import store

    return scan_events(store.read(spark, root, schemas.EVENTS))

