"""Tiles, map objects, radius and nearest joins, polygon clip, nearby search."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from emberfield.constants import (
    CONTEXT_FEATURES,
    GRID_SIZE,
    INDUSTRIAL_BUILDINGS,
    MAP_TAGS,
    RADIUS_M,
    TILE_SIZE,
)
from emberfield.functions import distance as d, grid
from emberfield.session import materialize

# --- tiles ----------------------------------------------------------------


def active_tiles(cells: DataFrame, min_observations: int, size: float = TILE_SIZE) -> DataFrame:
    """Distinct tiles holding a cell with enough observations."""
    edges = (
        cells.where(F.col("observation_count") >= min_observations)
        .select(
            grid.tile_edge(F.col("lat_grid"), size).alias("tile_south"),
            grid.tile_edge(F.col("lon_grid"), size).alias("tile_west"),
        )
        .distinct()
    )
    key = F.format_string("%.6f_%.6f", F.col("tile_south"), F.col("tile_west"))
    return edges.select(
        key.alias("tile_id"),
        "tile_south",
        "tile_west",
        (F.col("tile_south") + F.lit(size)).alias("tile_north"),
        (F.col("tile_west") + F.lit(size)).alias("tile_east"),
    )


def first_tiles(tiles: DataFrame, limit: int) -> DataFrame:
    return tiles.orderBy("tile_south", "tile_west").limit(limit)


def objects_per_tile(
    objects: DataFrame, radius_m: float = RADIUS_M, size: float = TILE_SIZE
) -> DataFrame:
    """Objects inside each tile's box grown by the radius: ``(tile_id, n)``.

    An object can lie in the grown box of its own tile and of the neighbours
    only, so nine candidates are checked by arithmetic and folded by tile.
    """
    def around(name: str) -> Column:
        here = F.floor(F.col(name) / F.lit(size)).cast("int")
        return F.explode(F.array(here - 1, here, here + 1))

    near = objects.select("latitude", "longitude", around("latitude").alias("_tr")).select(
        "*", around("longitude").alias("_tc")
    )
    south, west = F.col("_tr") * F.lit(size), F.col("_tc") * F.lit(size)
    box = grid.grow_bounds(
        {"south": south, "west": west, "north": south + F.lit(size), "east": west + F.lit(size)}, radius_m
    )
    inside = F.col("latitude").between(box["south"], box["north"]) & F.col("longitude").between(
        box["west"], box["east"]
    )
    counts = near.where(inside).groupBy("_tr", "_tc").agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.format_string("%.6f_%.6f", south, west).alias("tile_id"), "n")


def cells_in_tiles(
    cells: DataFrame, tiles: DataFrame, size: float = TILE_SIZE, closed: bool = False
) -> DataFrame:
    """Cells of each tile, south and west edge included, north and east not.

    The half-open rule makes a cell belong to exactly one tile, so this is an
    equi-join on the tile's integer position. ``closed`` is the older rule that
    counts a cell on a shared edge in both tiles.
    """
    def position(name: str) -> Column:
        here = F.floor(F.col(name) / F.lit(size)).cast("int")
        if not closed:
            return here
        on_edge = F.col(name) == here * F.lit(size)
        return F.explode(F.when(on_edge, F.array(here, here - 1)).otherwise(F.array(here)))

    def tile_position(name: str) -> Column:
        return F.rint(F.col(name) / F.lit(size)).cast("int")

    right = tiles.select(
        "tile_id", tile_position("tile_south").alias("_tr"), tile_position("tile_west").alias("_tc")
    )
    return (
        cells.select("*", position("lat_grid").alias("_tr"))
        .select("*", position("lon_grid").alias("_tc"))
        .join(right, ["_tr", "_tc"])
        .drop("_tr", "_tc")
    )


def sample_tiles(tiles: DataFrame, sample_size: int) -> DataFrame:
    """Evenly spaced tiles of the list ordered by (south, west).

    Positions are numbered inside each tile row and shifted by the sizes of
    the rows south of it, so no task sees more than one row of tiles.
    """
    if sample_size <= 0:
        raise ValueError("sample_size must be greater than zero")
    total = tiles.agg(F.count(F.lit(1)).alias("n")).scalar()
    inside = F.row_number().over(Window.partitionBy("tile_south").orderBy("tile_west"))
    # One row per tile row: at most 720 on the whole globe.
    rows = tiles.groupBy("tile_south").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("tile_south").rowsBetween(Window.unboundedPreceding, -1)
    offsets = rows.select(
        "tile_south", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    )
    placed = (
        tiles.withColumn("_inside", inside)
        .join(F.broadcast(offsets), "tile_south")
        .withColumn("position", F.col("_before") + F.col("_inside") - F.lit(1))
    )
    if sample_size == 1:
        wanted = F.col("position") == 0
    else:
        # position p is picked when rint(i * (n - 1) / (s - 1)) = p for some i;
        # only the i nearest to p * (s - 1) / (n - 1) can do that.
        last, step = (total - F.lit(1)).cast("double"), F.lit(float(sample_size - 1))
        near = F.rint(F.col("position") * step / F.greatest(last, F.lit(1.0)))
        hits = [
            (F.rint(i * last / step) == F.col("position")) & i.between(0, sample_size - 1)
            for i in (near - 1, near, near + 1)
        ]
        wanted = (F.lit(sample_size) >= total) | hits[0] | hits[1] | hits[2]
    return placed.where(wanted).select(*tiles.columns)


# --- map objects ----------------------------------------------------------


def tag_is_listed(tags: Column, allowed: dict[str, list[str] | None] = MAP_TAGS) -> Column:
    """True when any tag is on the allow-list (None allows every value)."""
    hit = F.lit(False)
    for key, options in allowed.items():
        has = F.map_contains_key(tags, key)
        if options is not None:
            has = has & F.coalesce(F.element_at(tags, key).isin(options), F.lit(False))
        hit = hit | has
    return F.coalesce(hit, F.lit(False))


def relevant_objects(
    objects: DataFrame, box: dict[str, float] | None = None, allowed=MAP_TAGS
) -> DataFrame:
    """Objects on the allow-list, inside a box when one is given."""
    out = objects.where(tag_is_listed(F.col("tags"), allowed))
    if box is not None:
        out = out.where(
            F.col("latitude").between(box["south"], box["north"])
            & F.col("longitude").between(box["west"], box["east"])
        )
    return out


def _tag(name: str) -> Column:
    return F.coalesce(F.lower(F.element_at("tags", name)), F.lit(""))


def with_category_flags(objects: DataFrame) -> DataFrame:
    """Industrial, power and man-made flags; one object may carry several."""
    industrial = (
        (_tag("landuse") == "industrial")
        | F.map_contains_key("tags", "industrial")
        | _tag("building").isin(INDUSTRIAL_BUILDINGS)
    )
    return objects.withColumns(
        {
            "industrial": F.coalesce(industrial, F.lit(False)),
            "power": F.coalesce(F.map_contains_key("tags", "power"), F.lit(False)),
            "manmade": F.coalesce(F.map_contains_key("tags", "man_made"), F.lit(False)),
        }
    )


def with_single_category(objects: DataFrame) -> DataFrame:
    """One category per object: power, industrial, man_made, other, in that order."""
    def value(name: str) -> Column:
        return F.element_at("tags", name)

    industrial = (
        (value("landuse") == "industrial")
        | value("industrial").isNotNull()
        | value("building").isin(INDUSTRIAL_BUILDINGS)
    )
    category = (
        F.when(value("power").isNotNull(), "power")
        .when(industrial, "industrial")
        .when(value("man_made").isNotNull(), "man_made")
        .otherwise("other")
    )
    return objects.withColumn("category", category)


def with_projection(df: DataFrame, lat: str = "latitude", lon: str = "longitude") -> DataFrame:
    return df.withColumns({"x": d.mercator_x(F.col(lon)), "y": d.mercator_y(F.col(lat))})


# --- radius and nearest joins ---------------------------------------------


def objects_near_cells(objects: DataFrame, radius_m: float, size: float = GRID_SIZE) -> DataFrame:
    """One row per object and lattice cell within the radius of it.

    Cells sit on a regular lattice, so the cells around an object follow from
    arithmetic: no join, and at most a dozen rows per object however dense the
    place is. Consumers aggregate by cell, which combines on the map side.
    """
    r, eps = F.lit(float(radius_m)), F.lit(1e-6)
    step = F.lit(size)

    def span(low: Column, high: Column) -> Column:
        first = F.ceil(low / step - eps).cast("int")
        last = F.floor(high / step + eps).cast("int")
        return F.when(first <= last, F.sequence(first, last, F.lit(1)))

    rows = with_projection(objects).withColumn(
        "_row", F.explode(span(d.mercator_lat(F.col("y") - r), d.mercator_lat(F.col("y") + r)))
    )
    rows = rows.withColumn("_cell_y", d.mercator_y(grid.index_to_degrees(F.col("_row"), size)))
    dy = F.col("y") - F.col("_cell_y")
    reach = F.sqrt(F.greatest(F.lit(0.0), r * r - dy * dy))
    cols = rows.withColumn(
        "_col",
        F.explode(span(d.mercator_lon(F.col("x") - reach), d.mercator_lon(F.col("x") + reach))),
    )
    cell_x = d.mercator_x(grid.index_to_degrees(F.col("_col"), size))
    return (
        cols.withColumn(
            "distance_m", d.planar_distance(F.col("x"), F.col("y"), cell_x, F.col("_cell_y"))
        )
        .where(F.col("distance_m") <= r)
        .drop("_cell_y")
    )


def _attach(cells: DataFrame, found: DataFrame, radius_m: float, size: float) -> DataFrame:
    """Left-join per-cell results; a queried cell with nothing near gets 0 and r."""
    keyed = cells.select(
        "grid_id",
        "lat_grid",
        "lon_grid",
        grid.cell_index(F.col("lat_grid"), size).alias("_row"),
        grid.cell_index(F.col("lon_grid"), size).alias("_col"),
    )
    counts = [
        F.coalesce(F.col(c), F.lit(0)).cast("int").alias(c) for c in CONTEXT_FEATURES[:-1]
    ]
    nearest = F.coalesce(F.col("osm_min_distance_m"), F.lit(float(radius_m)))
    return keyed.join(found, ["_row", "_col"], "left").select(
        "grid_id", "lat_grid", "lon_grid", *counts, nearest.alias("osm_min_distance_m")
    )


def radius_context(
    cells: DataFrame, objects: DataFrame, radius_m: float = RADIUS_M, size: float = GRID_SIZE
) -> DataFrame:
    """Counts by category and the smallest distance of objects within the radius.

    Distances are Web-Mercator metres and the radius is inclusive.
    """
    near = objects_near_cells(
        with_category_flags(objects).select("latitude", "longitude", "industrial", "power", "manmade"),
        radius_m,
        size,
    )
    found = near.groupBy("_row", "_col").agg(
        F.count(F.lit(1)).alias("osm_feature_count"),
        F.count_if("industrial").alias("osm_industrial_count"),
        F.count_if("power").alias("osm_power_count"),
        F.count_if("manmade").alias("osm_manmade_count"),
        F.min("distance_m").alias("osm_min_distance_m"),
    )
    return _attach(cells, found, radius_m, size)


def nearest_context(
    cells: DataFrame, objects: DataFrame, radius_m: float = RADIUS_M, size: float = GRID_SIZE
) -> DataFrame:
    """Like ``radius_context`` but only the nearest objects count (ties kept)."""
    near = objects_near_cells(
        with_single_category(objects).select("latitude", "longitude", "category"), radius_m, size
    )
    # Objects at one distance fold into a row first; the nearest such row wins.
    by_distance = near.groupBy("_row", "_col", "distance_m").agg(
        F.count(F.lit(1)).alias("osm_feature_count"),
        F.count_if(F.col("category") == "industrial").alias("osm_industrial_count"),
        F.count_if(F.col("category") == "power").alias("osm_power_count"),
        F.count_if(F.col("category") == "man_made").alias("osm_manmade_count"),
    )
    found = by_distance.groupBy("_row", "_col").agg(
        *[F.min_by(c, "distance_m").alias(c) for c in CONTEXT_FEATURES[:-1]],
        F.min("distance_m").alias("osm_min_distance_m"),
    )
    return _attach(cells, found, radius_m, size)


# --- polygons -------------------------------------------------------------

#: Edges that one row of the tile index holds at most.
TILE_EDGES = 256
# Widens the columns that an edge is listed in, far more than rounding can move a crossing.
_SLACK = 1e-9


def polygon_edges(shapes: DataFrame) -> DataFrame:
    """Edges of ``polygons`` (array of polygons, of rings, of [x, y] points).

    Each ring is turned into edges inside its row; ring 0 is the outer one.
    """
    ring = F.col("ring")
    previous = lambda i: F.when(i == 0, F.element_at(ring, -1)).otherwise(F.element_at(ring, i))
    edges = F.transform(
        ring,
        lambda p, i: F.struct(
            p[0].alias("x1"),
            p[1].alias("y1"),
            previous(i)[0].alias("x2"),
            previous(i)[1].alias("y2"),
        ),
    )
    return (
        shapes.withColumn("_shape", F.monotonically_increasing_id())
        .select("_shape", F.posexplode("polygons").alias("_p", "rings"))
        .select("_shape", "_p", F.posexplode("rings").alias("ring_no", "ring"))
        .select(
            F.concat_ws(":", "_shape", "_p").alias("poly"), "ring_no", F.inline(edges)
        )
    )


def _odd_runs(rows: DataFrame, by: list[str]) -> DataFrame:
    """Columns that have an odd number of ``cmin`` to their right, one row per column (``col``).

    Sorted, the places pair up; the columns between the two of a pair are the odd ones.
    """
    order = Window.partitionBy(*by).orderBy("cmin", "edge")
    paired = rows.withColumns({"n": F.row_number().over(order), "next": F.lead("cmin").over(order)})
    run = F.when(F.col("next") > F.col("cmin"), F.sequence(F.col("cmin"), F.col("next") - 1))
    return paired.where("n % 2 = 1").select(*by, F.explode(run).alias("col"))


def tile_index(shapes: DataFrame, size: float) -> DataFrame:
    """Per lattice tile (``row, col``) and ring: what decides whether a point of the tile is inside.

    A point is inside a ring when an odd number of edges crosses the ray to its right. Edges listed in the tile
    are tested; those wholly to the right cross the ray or not whatever the point's longitude, and their
    number is odd or even by ``base``, the parity of those that come from below the row, and by ``turns``, the latitudes in the tile's row
    at which it changes. Edges that meet at a vertex cancel there, so turns are only left where one of them is listed and the other is
    not. Tiles without edges or turns are wholly inside (listed) or outside (not listed). A row holds at most
    ``TILE_EDGES`` edges; further edges of a tile are in further rows (``chunk``).
    """
    low, high = F.least("y1", "y2"), F.greatest("y1", "y2")
    step = F.lit(size)
    by = ["poly", "ring_no", "row"]
    rows = (
        polygon_edges(shapes)
        .where("y1 <> y2")
        .withColumns({"edge": F.monotonically_increasing_id(), "low": low, "high": high})
        .withColumn("row", F.explode(F.sequence(F.floor(F.col("low") / step).cast("int"), F.floor(F.col("high") / step).cast("int"))))
    )
    slope = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    at = lambda y: F.col("x1") + (y - F.col("y1")) * slope
    bottom, top = F.col("row") * step, (F.col("row") + 1) * step
    x_low, x_high = at(F.greatest("low", bottom)), at(F.least("high", top))
    rows = rows.withColumns(
        {
            "cmin": F.floor((F.least(x_low, x_high) - F.lit(_SLACK)) / step).cast("int"),
            "cmax": F.floor((F.greatest(x_low, x_high) + F.lit(_SLACK)) / step).cast("int"),
        }
    )
    listed = rows.withColumn("col", F.explode(F.sequence("cmin", "cmax"))).select(
        *by, "col", F.struct("x1", "y1", "x2", "y2").alias("e"),
        F.floor((F.row_number().over(Window.partitionBy(*by, "col").orderBy("edge")) - 1) / F.lit(TILE_EDGES)).cast("int").alias("chunk"),
    )
    # An edge counts from its lower to its upper end: ends in the row are turns, an edge from below is base.
    ends = rows.select(*by, "cmin", "edge", F.explode(F.array("low", "high")).alias("y"))
    turns = _odd_runs(ends.where(F.floor(F.col("y") / step) == F.col("row")), [*by, "y"])
    base = _odd_runs(rows.where(F.floor(F.col("low") / step) < F.col("row")), by)
    none = lambda t: F.lit(None).cast(t)
    edge = "struct<x1:double,y1:double,x2:double,y2:double>"
    parts = (
        listed.select(*by, "col", "chunk", "e", none("double").alias("y"), F.lit(0).alias("base"))
        .unionByName(turns.select(*by, "col", F.lit(0).alias("chunk"), none(edge).alias("e"), "y", F.lit(0).alias("base")))
        .unionByName(base.select(*by, "col", F.lit(0).alias("chunk"), none(edge).alias("e"), none("double").alias("y"), F.lit(1).alias("base")))
    )
    return parts.groupBy("row", "col", "poly", "ring_no", "chunk").agg(
        F.collect_list("e").alias("edges"), F.collect_list("y").alias("turns"), F.max("base").alias("base")
    )


def _tile_size(shapes: DataFrame) -> float:
    row = polygon_edges(shapes).agg(
        F.count(F.lit(1)).alias("n"), F.max("x1").alias("e"), F.min("x1").alias("w"), F.max("y1").alias("t"), F.min("y1").alias("s")
    ).first()
    if not row["n"]:
        return 1.0
    return max(math.sqrt(max(row["e"] - row["w"], 1e-6) * max(row["t"] - row["s"], 1e-6) / max(row["n"], 4096)), 1e-4)


def _crosses(edge: Column, x: Column, y: Column) -> Column:
    x1, y1, x2, y2 = edge["x1"], edge["y1"], edge["x2"], edge["y2"]
    return ((y1 > y) != (y2 > y)) & (x < F.try_divide((x2 - x1) * (y - y1), y2 - y1) + x1)


def clip_to_polygons(
    points: DataFrame,
    shapes: DataFrame,
    lat: str = "latitude",
    lon: str = "longitude",
    size: float | None = None,
) -> DataFrame:
    """Rows whose point lies in any polygon: inside its outer ring, in no hole.

    Without a size, tiles are as large as lets the extent of the polygons hold about one per edge, 4096 at least.
    Points meet their lattice tile by an equi-join on (row, col); the index of the tiles is written first, so its
    size is known when the join is planned. Tiles whose edges fill one row per ring are decided in that row;
    in denser tiles the crossings of a point are added up over the rows.
    """
    if size is None:
        size = _tile_size(shapes)
    index = materialize(tile_index(shapes, size), "polygon-tiles")
    extent = index.agg(*[f(c).alias(n) for n, f, c in (("s", F.min, "row"), ("n", F.max, "row"), ("w", F.min, "col"), ("e", F.max, "col"))]).first()
    if extent["s"] is None:
        return points.limit(0)
    x, y = F.col(lon).cast("double"), F.col(lat).cast("double")
    # The literal box reaches the scan of the points.
    box = F.col(lon).between(extent["w"] * size - size, (extent["e"] + 2) * size) & F.col(lat).between(
        extent["s"] * size - size, (extent["n"] + 2) * size
    )
    tiled = points.where(box).withColumns(
        {"_row": F.floor(y / F.lit(size)).cast("int"), "_col": F.floor(x / F.lit(size)).cast("int")}
    )
    crossings = lambda ring: (
        ring["base"]
        + F.size(F.filter(ring["turns"], lambda t: t <= y))
        + F.size(F.filter(ring["edges"], lambda e: _crosses(e, x, y)))
    )
    outer = F.col("ring_no") == 0
    ring = F.struct("base", "turns", "edges").alias("ring")
    tile = [F.col("row").alias("_row"), F.col("col").alias("_col")]
    dense = index.where("chunk > 0").select("row", "col").distinct()
    sparse = index.join(dense, ["row", "col"], "left_anti").select(*tile, "poly", outer.alias("outer"), ring)
    polys = sparse.groupBy("_row", "_col", "poly").agg(
        F.max_by("ring", F.col("outer")).alias("first"),
        F.max("outer").alias("has_outer"),
        F.collect_list(F.when(~F.col("outer"), F.col("ring"))).alias("holes"),
    )
    polys = polys.where("has_outer").groupBy("_row", "_col").agg(F.collect_list(F.struct("first", "holes")).alias("_polys"))
    odd = lambda one: crossings(one) % 2 == 1
    inside = F.exists("_polys", lambda p: odd(p["first"]) & ~F.exists(p["holes"], odd))
    easy = tiled.join(polys, ["_row", "_col"]).where(inside).select(*points.columns)

    numbered = tiled.withColumn("_point", F.monotonically_increasing_id())
    chunks = index.join(dense, ["row", "col"], "left_semi").select(*tile, "poly", outer.alias("_outer"), "ring_no", ring)
    met = numbered.join(chunks, ["_row", "_col"]).withColumn("_n", crossings(F.col("ring")))
    keep = F.struct(*points.columns)
    rings = met.groupBy("_point", "poly", "ring_no", "_outer").agg((F.sum("_n") % 2 == 1).alias("_odd"), F.any_value(keep).alias("_kept"))
    hits = rings.groupBy("_point", "poly").agg(
        (F.max(F.col("_outer") & F.col("_odd")) & ~F.max(~F.col("_outer") & F.col("_odd"))).alias("_in"), F.any_value("_kept").alias("_kept")
    )
    hard = hits.where("_in").groupBy("_point").agg(F.any_value("_kept").alias("_kept")).select("_kept.*")
    return easy.unionByName(hard)


# --- nearby search --------------------------------------------------------


def nearby(
    events: DataFrame, lat: float, lon: float, radius_m: float = RADIUS_M, limit: int = 500
) -> DataFrame:
    """Events within a geodesic radius of a point, nearest first.

    The box is made of literals and reaches the scan as pushed filters; when
    the table is sorted by place, whole row groups are skipped.
    """
    box = grid.search_box(lat, lon, radius_m)
    in_lon = F.lit(False)
    for west, east in box["lon"]:
        in_lon = in_lon | F.col("longitude").between(west, east)
    away = d.geodesic_distance(F.col("latitude"), F.col("longitude"), F.lit(float(lat)), F.lit(float(lon)))
    return (
        events.where(F.col("latitude").between(*box["lat"]) & in_lon)
        .withColumn("distance_m", away)
        .where(F.col("distance_m") <= radius_m)
        .orderBy("distance_m", "grid_id")
        .limit(limit)
    )
