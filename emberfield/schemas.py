"""Explicit schemas: nothing in this package infers types from data."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp": T.TimestampType(),
}


def _struct(columns: str) -> T.StructType:
    """A flat schema from ``name type`` pairs (works without a session)."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


ARCHIVE_DETECTIONS = _struct(
    "latitude double, longitude double, brightness double, scan double, "
    "track double, acq_date date, acq_time int, satellite string, "
    "instrument string, confidence string, version string, "
    "bright_t31 double, frp double, daynight string, type int"
)

# Landing files are read as text and coerced by the normaliser, so that one bad
# number costs one value and not the file.
LIVE_DETECTIONS_RAW = _struct(
    "latitude string, longitude string, bright_ti4 string, "
    "bright_ti5 string, acq_date string, acq_time string, satellite string, "
    "confidence string, frp string, daynight string"
)

CONTEXT_TILE = _struct(
    "grid_id string, lat_grid double, lon_grid double, "
    "osm_feature_count int, osm_industrial_count int, "
    "osm_power_count int, osm_manmade_count int, osm_min_distance_m double"
)

TILE_MANIFEST = _struct(
    "tile_id string, south double, west double, north double, east double, "
    "status string, feature_count int, firms_cell_count int, "
    "endpoint string, timestamp timestamp, error string"
)

_TEXT_MAP = T.MapType(T.StringType(), T.StringType())


def _array_of(name: str, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    element = T.StructType([T.StructField(n, t) for n, t in fields])
    return T.StructType([T.StructField(name, T.ArrayType(element))])


MAP_ELEMENTS_JSON = _array_of(
    "elements",
    [
        ("type", T.StringType()),
        ("id", T.LongType()),
        ("lat", T.DoubleType()),
        ("lon", T.DoubleType()),
        ("center", _struct("lat double, lon double")),
        ("tags", _TEXT_MAP),
    ],
)

# Coordinates stay text until the geometry type is known.
BOUNDARY_JSON = _array_of(
    "features",
    [
        ("properties", _TEXT_MAP),
        ("geometry", _struct("type string, coordinates string")),
    ],
)

CELLS = _struct(
    "grid_id string, lat_grid double, lon_grid double, "
    "observation_count bigint, first_seen date, last_seen date, "
    "active_days bigint, day_observations bigint, "
    "night_observations bigint, mean_frp double, max_frp double, "
    "std_frp double, mean_brightness double, max_brightness double, "
    "mean_bright_t31 double, max_bright_t31 double, "
    "mean_confidence_score double, type_2_count bigint, "
    "persistence_days int, recurrence_ratio double, "
    "obs_per_active_day double, night_ratio double, type_2_ratio double, "
    "target_multiclass int, target_persistent_source int"
)

EVENTS = _struct(
    "id bigint, event_id string, grid_id string, latitude double, "
    "longitude double, observation_count int, active_days int, "
    "first_seen date, last_seen date, persistence_days int, "
    "recurrence_ratio double, obs_per_active_day double, "
    "day_observations int, night_observations int, night_ratio double, "
    "mean_frp double, max_frp double, std_frp double, "
    "mean_brightness double, max_brightness double, "
    "mean_bright_t31 double, max_bright_t31 double, "
    "mean_confidence_score double, type_2_count int, type_2_ratio double, "
    "target_persistent_source int, target_multiclass int, "
    "osm_context_available boolean, osm_feature_count int, "
    "osm_industrial_count int, osm_power_count int, osm_manmade_count int, "
    "osm_min_distance_m double"
)


def require_columns(df, columns) -> None:
    """Fail on the plan's schema, before any data is read."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError("missing required columns: " + ", ".join(missing))
