"""From raw detections to clean ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from emberfield.constants import LIVE_DEDUPE_KEY, LIVE_NOT_NULL, LIVE_REQUIRED
from emberfield.functions import grid, values as v
from emberfield.functions.ordered import keep_one
from emberfield.schemas import require_columns


def prepare_archive(df: DataFrame) -> DataFrame:
    """Day, night and type-2 flags and the confidence score of archive rows."""
    require_columns(df, ["acq_date", "daynight", "type", "confidence"])
    if isinstance(df.schema["confidence"].dataType, T.StringType):
        score = v.archive_confidence(F.col("confidence"))
    else:
        score = F.col("confidence").cast("double")
    return df.withColumns(
        {
            "acq_date": F.col("acq_date").cast("date"),
            "is_day": v.flag(F.col("daynight") == "D"),
            "is_night": v.flag(F.col("daynight") == "N"),
            "is_type2": v.flag(F.col("type") == 2),
            "confidence_score": score,
        }
    )


def number_column(df: DataFrame, name: str) -> Column:
    if isinstance(df.schema[name].dataType, T.StringType):
        return v.to_number(F.col(name))
    return v.finite_or_null(F.col(name).cast("double"))


def coerce_live(df: DataFrame) -> DataFrame:
    """Numbers, dates, score and flags of live rows; bad values become NULL."""
    require_columns(df, LIVE_REQUIRED)
    numeric = ["latitude", "longitude", "bright_ti4", "bright_ti5", "frp"]
    # Times as text come with and without a leading zero; both are the same minute.
    text_time = "acq_time" in df.columns and isinstance(df.schema["acq_time"].dataType, T.StringType)
    time = {"acq_time": number_column(df, "acq_time").cast("int")} if text_time else {}
    return df.withColumns(
        {
            **time,
            **{name: number_column(df, name) for name in numeric},
            "acq_date": F.col("acq_date").try_cast("date"),
            "confidence_score": v.live_confidence(F.col("confidence").cast("string")),
            "is_day": v.flag(F.upper("daynight") == "D"),
            "is_night": v.flag(F.upper("daynight") == "N"),
        }
    )


def drop_incomplete(df: DataFrame) -> DataFrame:
    """Keep rows whose seven required values are all present."""
    return df.na.drop(subset=LIVE_NOT_NULL)


def drop_repeats(df: DataFrame) -> DataFrame:
    """One row per detection key; the order is total, so runs agree."""
    rest = sorted(c for c in df.columns if c not in LIVE_DEDUPE_KEY)
    return keep_one(df, LIVE_DEDUPE_KEY, rest)


def normalize_live(df: DataFrame) -> DataFrame:
    """Coerce, drop incomplete rows, drop repeats, and rename to archive names."""
    clean = drop_incomplete(coerce_live(df))
    return drop_repeats(clean).withColumns(
        {"brightness": F.col("bright_ti4"), "bright_t31": F.col("bright_ti5")}
    )


def with_clock(df: DataFrame) -> DataFrame:
    """Hour, minute, clock validity and acquisition timestamp."""
    hour, minute = v.hour_of(F.col("acq_time")), v.minute_of(F.col("acq_time"))
    return df.withColumns(
        {
            "acq_hour": hour,
            "acq_minute": minute,
            "valid_time": hour.between(0, 23) & minute.between(0, 59),
            "acq_datetime": v.acquisition_time(F.col("acq_date"), F.col("acq_time")),
        }
    )


CLEAN_COLUMNS = [
    "latitude", "longitude", "brightness", "scan", "track", "acq_date",
    "acq_time", "acq_datetime", "satellite", "instrument", "confidence",
    "version", "bright_t31", "frp", "daynight", "type", "lat_grid",
    "lon_grid", "grid_id",
]


def clean_detections(df: DataFrame) -> DataFrame:
    """The 19-column exploration table, on the two-decimal grid."""
    lat = grid.snap_by_decimals(F.col("latitude"))
    lon = grid.snap_by_decimals(F.col("longitude"))
    return (
        with_clock(df)
        .withColumns({"lat_grid": lat, "lon_grid": lon})
        .withColumn("grid_id", grid.grid_key(F.col("lat_grid"), F.col("lon_grid")))
        .select(*CLEAN_COLUMNS)
    )


def union_sources(frames: dict[str, DataFrame]) -> DataFrame:
    """Stack frames by column name with the source as a tag column."""
    tagged = [df.withColumn("source_dataset", F.lit(name)) for name, df in frames.items()]
    out = tagged[0]
    for df in tagged[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
