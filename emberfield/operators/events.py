"""The thermal event table: records, snapshot replace, filters, statistics."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from emberfield.constants import (
    BINARY_TARGET,
    DISPLAY_CLASS_LABELS,
    LIVE_EVENT_PREFIX,
    TARGET,
    UNCLASSIFIED_TEXT,
)
from emberfield.functions import grid, values as v
from emberfield.operators.context import is_live_event, unique_by
from emberfield.schemas import EVENTS

# --- records and snapshots ------------------------------------------------


def _cast_to_events(df: DataFrame) -> DataFrame:
    return df.select(
        *[F.col(f.name).cast(f.dataType).alias(f.name) for f in EVENTS.fields]
    )


def live_event_records(cells: DataFrame) -> DataFrame:
    """Event rows of live cells; what the feed does not tell stays NULL."""
    unknown = [
        "type_2_count", "type_2_ratio", BINARY_TARGET, TARGET, "osm_feature_count",
        "osm_industrial_count", "osm_power_count", "osm_manmade_count", "osm_min_distance_m",
    ]
    return _cast_to_events(
        cells.withColumns(
            {
                "id": grid.lattice_id(F.col("lat_grid"), F.col("lon_grid")),
                "event_id": F.concat(F.lit(LIVE_EVENT_PREFIX), F.col("grid_id")),
                "latitude": F.col("lat_grid"),
                "longitude": F.col("lon_grid"),
                "osm_context_available": F.lit(False),
                **{c: F.lit(None) for c in unknown},
            }
        )
    )


def archive_event_records(cells: DataFrame, prefix: Column) -> DataFrame:
    """Event rows of labelled archive cells joined with their context."""
    return _cast_to_events(
        cells.withColumns(
            {
                "id": grid.lattice_id(F.col("lat_grid"), F.col("lon_grid")),
                "event_id": F.concat(prefix, F.col("grid_id")),
                "latitude": F.bround("lat_grid", 4),
                "longitude": F.bround("lon_grid", 4),
            }
        )
    )


def replace_snapshot(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """The table after a live snapshot: old live rows out, fresh rows in.

    A kept row with the grid id of a fresh row is overwritten by it.
    """
    fresh = unique_by(fresh, ["grid_id"])
    kept = current.where(~is_live_event()).join(fresh.select("grid_id"), "grid_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def upsert_events(current: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh rows replace rows of the same grid id; all others stay."""
    kept = current.join(fresh.select("grid_id"), "grid_id", "left_anti")
    return kept.select(*fresh.columns).unionByName(fresh)


def scan_events(events: DataFrame) -> DataFrame:
    """Event columns with the two alias columns of the query interface."""
    return events.withColumns(
        {
            "brightness": F.col("mean_brightness"),
            "confidence": F.col("mean_confidence_score"),
        }
    )


# --- filters and top lists ------------------------------------------------


def list_hotspots(
    events: DataFrame, min_active_days: int = 1, persistent_only: bool = False, limit: int = 1500
) -> DataFrame:
    """Most persistent first, then most active; ties by grid id."""
    if min_active_days < 1 or not 1 <= limit <= 10_000:
        raise ValueError("min_active_days must be >= 1 and limit within 1..10000")
    rows = events.where(F.col("active_days") >= min_active_days)
    if persistent_only:
        rows = rows.where(F.col(BINARY_TARGET) == 1)
    return rows.orderBy(
        F.coalesce(F.col(BINARY_TARGET), F.lit(0)).desc(),
        F.desc("active_days"),
        F.desc("observation_count"),
        "grid_id",
    ).limit(limit)


def find_hotspot(events: DataFrame, key: str | int) -> DataFrame:
    """At most one row whose id, event id or grid id equals the key.

    Plain comparisons of stored columns, which reach the scan.
    """
    text = str(key)
    match = (F.col("event_id") == text) | (F.col("grid_id") == text)
    number = _whole_number(text)
    if number is not None:
        match = match | (F.col("id") == F.lit(number).cast("long"))
    return events.where(match).orderBy("id").limit(1)


def _whole_number(text: str) -> int | None:
    """The number that is written exactly like this."""
    digits = text.removeprefix("-")
    if not (digits.isascii() and digits.isdigit()) or len(digits) > 18 or str(int(text)) != text:
        return None
    return int(text)


def key_box(key: str | int) -> dict[str, object] | None:
    """A search box around the cell that a key names; None where the key tells no place.

    Ids number the cells of the world, and grid ids, which end event ids, hold the position.
    """
    number = _whole_number(str(key))
    if number is not None:
        lat, lon = grid.lattice_position(number)
    else:
        found = re.fullmatch(r"(?:[A-Za-z]+-)?(-?[0-9]+(?:\.[0-9]+)?)_(-?[0-9]+(?:\.[0-9]+)?)", str(key))
        if not found:
            return None
        lat, lon = float(found[1]), float(found[2])
    if abs(lat) > 90 or abs(lon) > 180:
        return None
    return grid.search_box(lat, lon, 2000.0)


def identity() -> Column:
    return F.coalesce(F.col("event_id"), F.col("grid_id"), F.col("id").cast("string"))


def search_events(
    events: DataFrame, text: str = "", classification: str = "all", need_position: bool = True
) -> DataFrame:
    """Case-insensitive substring over the ids, class filter, usable position."""
    out = events
    wanted = text.strip().lower()
    if wanted:
        hit = F.lit(False)
        for field in (identity(), F.col("id").cast("string"), F.col("grid_id")):
            hit = hit | F.coalesce(F.lower(field).contains(wanted), F.lit(False))
        out = out.where(hit)
    if classification != "all":
        wanted_class = _whole_number(classification)
        out = out.where(F.lit(False) if wanted_class is None else F.col(TARGET) == F.lit(wanted_class))
    if need_position:
        out = out.where(v.is_finite(F.col("latitude")) & v.is_finite(F.col("longitude")))
    return out


def map_selection(
    cells: DataFrame, min_active: int = 1, persistent_only: bool = False, limit: int = 500
) -> DataFrame:
    """Interactive map filter, first rows by grid id."""
    out = cells
    if min_active > 1:
        out = out.where(F.col("active_days") >= min_active)
    if persistent_only:
        out = out.where(F.col(BINARY_TARGET) == 1)
    return out.orderBy("grid_id").limit(limit)


def pick_list(cells: DataFrame, limit: int = 100) -> DataFrame:
    """Grid ids to inspect: positive label first, most active first."""
    return (
        cells.orderBy(F.desc(BINARY_TARGET), F.desc("active_days"), "grid_id")
        .limit(limit)
        .select("grid_id", BINARY_TARGET, "active_days")
    )


def with_display_text(events: DataFrame) -> DataFrame:
    text = F.coalesce(v.lookup(F.col(TARGET), DISPLAY_CLASS_LABELS), F.lit(UNCLASSIFIED_TEXT))
    return events.withColumns({"classification_text": text, "identity": identity()})


def event_reports(events: DataFrame, predictions: DataFrame) -> DataFrame:
    """Each event with its prediction; NULL prediction where scoring failed."""
    chosen = unique_by(
        predictions.select("event_id", "classification", "model_score", "model_version"), ["event_id"]
    )
    return events.join(chosen, "event_id", "left")


def event_statistics(events: DataFrame) -> DataFrame:
    """Ten headline numbers in one pass."""
    label = F.col(BINARY_TARGET)
    return events.agg(
        F.count(F.lit(1)).alias("total_spatial_cells"),
        F.coalesce(F.sum("observation_count"), F.lit(0)).alias("total_raw_observations"),
        F.count_if(label == 1).alias("persistent_candidate_cells"),
        F.count_if(label == 0).alias("ephemeral_candidate_cells"),
        F.count_if(label.isNull()).alias("unclassified_candidate_cells"),
        F.count_if(label.isNotNull()).alias("labelled_candidate_cells"),
        F.max("active_days").alias("max_active_days"),
        F.max("persistence_days").alias("max_persistence_days"),
        F.avg("night_ratio").alias("mean_night_ratio"),
        F.count_if("osm_context_available").alias("osm_context_cells"),
    )


# --- rules ----------------------------------------------------------------

# Fixed ranges of the record rules: column, lowest, highest (None = open).
RECORD_RULES = [
    ("latitude", -90, 90),
    ("longitude", -180, 180),
    ("observation_count", 0, None),
    ("active_days", 0, None),
    ("persistence_days", 0, None),
    ("night_ratio", 0, 1),
    ("mean_frp", 0, None),
    ("max_frp", 0, None),
]


def with_violations(records: DataFrame, rules=None) -> DataFrame:
    """Add ``violations``: names of the present values that break their range."""
    checks = []
    for name, low, high in rules or RECORD_RULES:
        bad = F.lit(False)
        if low is not None:
            bad = bad | (F.col(name) < low)
        if high is not None:
            bad = bad | (F.col(name) > high)
        # NaN compares as the greatest double; a rule is broken by it.
        bad = bad | F.isnan(F.col(name).cast("double"))
        checks.append(F.when(F.coalesce(bad, F.lit(False)), F.lit(name)))
    return records.withColumn("violations", F.array_compact(F.array(*checks)))


def split_by_rules(records: DataFrame, rules=None) -> tuple[DataFrame, DataFrame]:
    """Valid rows, and invalid rows with their violations."""
    checked = with_violations(records, rules)
    ok = F.size("violations") == 0
    return checked.where(ok).drop("violations"), checked.where(~ok)


def check_search(lat: float, lon: float, radius_m: float) -> None:
    """Ranges of a nearby request."""
    if not (-90 <= lat <= 90 and -180 <= lon <= 180 and 0 < radius_m <= 100_000):
        raise ValueError("latitude, longitude or radius out of range")


def table_violations(events: DataFrame) -> DataFrame:
    """Broken table constraints as rows ``(rule, violations)``."""
    def out_of(name: str, allowed: list[int]) -> Column:
        return F.col(name).isNotNull() & ~F.col(name).isin(allowed)

    row_rules = {
        "latitude_range": ~F.coalesce(F.col("latitude").between(-90, 90), F.lit(False)),
        "longitude_range": ~F.coalesce(F.col("longitude").between(-180, 180), F.lit(False)),
        "binary_label": out_of(BINARY_TARGET, [0, 1]),
        "multiclass_label": out_of(TARGET, [0, 1, 2, 3]),
        "event_id_present": F.col("event_id").isNull(),
        "grid_id_present": F.col("grid_id").isNull(),
    }
    counts = events.agg(*[F.count_if(rule).alias(name) for name, rule in row_rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in row_rules])
    out = counts.select(F.inline(rows))
    for key in ("event_id", "grid_id"):
        copies = events.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
        out = out.unionByName(
            copies.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations")).select(
                F.lit(f"{key}_unique").alias("rule"), "violations"
            )
        )
    return out


# --- request records ------------------------------------------------------


def merge_request_features(requests: DataFrame, names: list[str]) -> DataFrame:
    """Model input of classification requests.

    ``features`` (map of numbers) wins; a non-null outer column fills a gap;
    the grid key is derived from the position unless given.
    """
    nested = F.coalesce(F.col("features"), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>")))
    outer = [
        F.when(F.col(n).isNotNull(), F.struct(F.lit(n).alias("key"), F.col(n).cast("double").alias("value")))
        for n in names
        if n in requests.columns
    ]
    gaps = F.filter(
        F.array_compact(F.array(*outer)), lambda e: ~F.map_contains_key(nested, e["key"])
    )
    merged = F.map_concat(nested, F.map_from_entries(gaps))
    at = lambda name: F.element_at("_all", name)
    lat, lon = F.bround(grid.snap(at("latitude")), 4), F.bround(grid.snap(at("longitude")), 4)
    key = F.when(lat.isNotNull() & lon.isNotNull(), grid.grid_key(lat, lon))
    return requests.withColumn("_all", merged).select(
        F.coalesce(
            F.nullif(F.col("event_id"), F.lit("")),
            F.nullif(F.col("grid_id"), F.lit("")),
            key,
            F.lit("unidentified-event"),
        ).alias("event_id"),
        F.coalesce(F.col("grid_id"), key).alias("grid_id"),
        F.coalesce(at("lat_grid"), lat).alias("lat_grid"),
        F.coalesce(at("lon_grid"), lon).alias("lon_grid"),
        *[at(n).alias(n) for n in names],
    )
