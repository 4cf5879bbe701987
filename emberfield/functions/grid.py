"""Grid, tile and block keys as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

from emberfield.constants import GRID_SIZE, METERS_PER_DEGREE, SPLIT_BLOCK, TILE_SIZE


def cell_index(coordinate: Column, size: float = GRID_SIZE) -> Column:
    """Integer lattice index, half-even on ties.

    Grouping on two integers keeps the shuffle key short and fixed-width; the
    text key is built once per cell, after the aggregation.
    """
    return F.rint(coordinate / F.lit(size)).cast("int")


def index_to_degrees(index: Column, size: float = GRID_SIZE) -> Column:
    return index * F.lit(size)


def snap(coordinate: Column, size: float = GRID_SIZE) -> Column:
    """Cell centre ``round_half_even(x / size) * size``, without minus zero."""
    return F.rint(coordinate / F.lit(size)) * F.lit(size) + F.lit(0.0)


def snap_by_decimals(coordinate: Column) -> Column:
    """The exploration grid: two decimals, which differs from snap on ties."""
    return F.rint(coordinate * F.lit(100.0)) / F.lit(100.0) + F.lit(0.0)


def grid_key(lat: Column, lon: Column) -> Column:
    """Text key ``lat_lon`` with four decimals and no padding zeros."""
    def text(value: Column) -> Column:
        return (F.bround(value, 4) + F.lit(0.0)).cast("string")

    return F.concat_ws("_", text(lat), text(lon))


def lattice_id(lat: Column, lon: Column, size: float = GRID_SIZE) -> Column:
    """A stable numeric row id per cell: row-major position in the world grid.

    Unlike a serial number it needs no global sort and keeps its value from
    one snapshot to the next.
    """
    columns = int(round(360 / size)) + 1
    row = cell_index(lat, size).cast("long") + F.lit(int(round(90 / size)))
    col = cell_index(lon, size).cast("long") + F.lit(int(round(180 / size)))
    return row * F.lit(columns) + col


def lattice_position(number: int, size: float = GRID_SIZE) -> tuple[float, float]:
    """Latitude and longitude of the cell with a lattice id."""
    row, col = divmod(number, int(round(360 / size)) + 1)
    return row * size - 90.0, col * size - 180.0


def tile_edge(coordinate: Column, size: float = TILE_SIZE) -> Column:
    return F.floor(coordinate / F.lit(size)) * F.lit(size)


def tile_key(lat: Column, lon: Column, size: float = TILE_SIZE) -> Column:
    """``south_west`` of the tile with six decimals."""
    return F.format_string("%.6f_%.6f", tile_edge(lat, size), tile_edge(lon, size))


def tile_bounds(lat: Column, lon: Column, size: float = TILE_SIZE) -> dict[str, Column]:
    south, west = tile_edge(lat, size), tile_edge(lon, size)
    return {
        "south": south,
        "west": west,
        "north": south + F.lit(size),
        "east": west + F.lit(size),
    }


def grow_bounds(bounds: dict[str, Column], radius_m: float) -> dict[str, Column]:
    """Grow a box by a radius, with the flat degree-per-metre approximation."""
    middle = (bounds["south"] + bounds["north"]) / F.lit(2.0)
    d_lat = F.lit(radius_m * (1.0 / METERS_PER_DEGREE))
    per_meter = F.lit(1.0) / (F.lit(METERS_PER_DEGREE) * F.cos(F.radians(middle)))
    d_lon = F.lit(radius_m) * per_meter
    return {
        "south": bounds["south"] - d_lat,
        "west": bounds["west"] - d_lon,
        "north": bounds["north"] + d_lat,
        "east": bounds["east"] + d_lon,
    }


def block_index(coordinate: Column, size: float = SPLIT_BLOCK) -> Column:
    return F.floor(coordinate / F.lit(size)).cast("int")


def block_key(lat: Column, lon: Column, size: float = SPLIT_BLOCK) -> Column:
    return F.concat_ws("_", block_index(lat, size).cast("string"), block_index(lon, size).cast("string"))


def search_box(lat: float, lon: float, radius_m: float) -> dict[str, object]:
    """A latitude band and one or two longitude ranges that surely cover a circle.

    Plain numbers, so that the ranges reach the Parquet scan as pushed filters.
    One degree of latitude is never shorter than 110,574 m on the spheroid.
    """
    d_lat = radius_m / 110_574.0 * 1.001
    south, north = max(-90.0, lat - d_lat), min(90.0, lat + d_lat)
    widest = max(abs(south), abs(north))
    if widest >= 89.9:
        return {"lat": (south, north), "lon": [(-180.0, 180.0)]}
    d_lon = radius_m / (110_574.0 * math.cos(math.radians(widest))) * 1.001
    west, east = lon - d_lon, lon + d_lon
    if d_lon >= 180.0:
        ranges = [(-180.0, 180.0)]
    elif west < -180.0:
        ranges = [(-180.0, east), (west + 360.0, 180.0)]
    elif east > 180.0:
        ranges = [(west, 180.0), (-180.0, east - 360.0)]
    else:
        ranges = [(west, east)]
    return {"lat": (south, north), "lon": ranges}


# --- space-filling curve --------------------------------------------------

_ROWS, _COLUMNS = int(round(90 / GRID_SIZE)), int(round(180 / GRID_SIZE))
_CURVE_BITS = 16


def _spread(x: Column) -> Column:
    """The 16 low bits of a number with a zero bit after each."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("long"))
    return x


def place_code(lat: Column, lon: Column) -> Column:
    """Position of a cell on a Z-shaped curve: near cells mostly have near codes. -1 without a position."""
    usable = lat.isNotNull() & lon.isNotNull() & ~F.isnan(lat) & ~F.isnan(lon)
    row = F.greatest(F.least(cell_index(lat) + F.lit(_ROWS), F.lit(2 * _ROWS)), F.lit(0)).cast("long")
    col = F.greatest(F.least(cell_index(lon) + F.lit(_COLUMNS), F.lit(2 * _COLUMNS)), F.lit(0)).cast("long")
    return F.when(usable, F.shiftleft(_spread(row), 1).bitwiseOR(_spread(col))).otherwise(F.lit(-1).cast("long"))


def place_ranges(box: dict[str, object], most: int = 16) -> list[tuple[int, int]]:
    """At most ``most`` ranges of place codes that cover all cells of a search box.

    Squares of the curve that lie in the box are ranges; those on its edge are cut into four. Ranges with the
    smallest gaps between them are joined.
    """
    size = GRID_SIZE
    bounds = lambda a, b, shift, top: (
        max(0, min(top, math.floor(a / size) + shift)), max(0, min(top, math.ceil(b / size) + shift))
    )
    south, north = bounds(*box["lat"], _ROWS, 2 * _ROWS)
    found: list[tuple[int, int]] = []

    def cover(row: int, col: int, bits: int, code: int, west: int, east: int) -> None:
        side = 1 << bits
        if row > north or row + side <= south or col > east or col + side <= west:
            return
        inside = row >= south and row + side - 1 <= north and col >= west and col + side - 1 <= east
        if inside or side <= small:
            found.append((code, code + (1 << (2 * bits)) - 1))
            return
        half = side // 2
        for k in range(4):
            cover(row + half * (k >> 1), col + half * (k & 1), bits - 1, code + (k << (2 * bits - 2)), west, east)

    for west_degrees, east_degrees in box["lon"]:
        west, east = bounds(west_degrees, east_degrees, _COLUMNS, 2 * _COLUMNS)
        # Squares far smaller than the box are not told apart.
        small = max(1, (max(north - south, east - west) + 1) // 32)
        cover(0, 0, _CURVE_BITS, 0, west, east)
    found.sort()
    ranges = [list(found[0])] if found else []
    for a, b in found[1:]:
        if a <= ranges[-1][1] + 1:
            ranges[-1][1] = max(b, ranges[-1][1])
        else:
            ranges.append([a, b])
    while len(ranges) > most:
        i = min(range(len(ranges) - 1), key=lambda i: ranges[i + 1][0] - ranges[i][1])
        ranges[i : i + 2] = [[ranges[i][0], ranges[i + 1][1]]]
    return [tuple(r) for r in ranges]
