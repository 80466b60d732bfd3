"""Columns over Web-Mercator tiles and their routes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pyramid.
HALF_WORLD = 20037508.342789244
WORLD = 2 * HALF_WORLD
TILE_SIZE = 256
MIN_ZOOM, MAX_ZOOM = 6, 14
OVERSCAN = 8
HATCH_PERIOD, HATCH_WIDTH = 12, 2


def extent(z: Column) -> Column:
    """Tiles along an axis."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), z.cast("int"))


def tile_x(z: Column, x: Column) -> Column:
    """Tile that a Mercator x in metres lies in, moved inside the world."""
    raw = F.floor((x + HALF_WORLD) / WORLD * (TILE_SIZE * extent(z)) / TILE_SIZE).cast("long")
    return F.least(extent(z) - 1, F.greatest(F.lit(0).cast("long"), raw))


def tile_y(z: Column, y: Column) -> Column:
    raw = F.floor((HALF_WORLD - y) / WORLD * (TILE_SIZE * extent(z)) / TILE_SIZE).cast("long")
    return F.least(extent(z) - 1, F.greatest(F.lit(0).cast("long"), raw))


def bounds(z: Column, x: Column, y: Column) -> Column:
    """min_x, min_y, max_x, max_y of a tile in metres."""
    span = F.lit(WORLD) / extent(z)
    left, top = x * span - HALF_WORLD, F.lit(HALF_WORLD) - y * span
    return F.struct(left.alias("min_x"), (top - span).alias("min_y"), (left + span).alias("max_x"), top.alias("max_y"))


def in_range(z: Column, x: Column, y: Column) -> Column:
    return z.between(MIN_ZOOM, MAX_ZOOM) & (x >= 0) & (y >= 0) & (x < extent(z)) & (y < extent(z))


#: The state's routes take leading zeroes, the strict ones do not.
ROUTE = r"^/tiles/(?:(current|forecast-next-day)/)?([0-9]+)/([0-9]+)/([0-9]+)\.png\z"
STRICT_ROUTE = r"^/tiles/([^/]+)/([^/]+)/([^/]+)\.png\z"


def _number(text: Column) -> Column:
    """Digits as a number; too many to be in any range count as -1."""
    plain = F.regexp_replace(text, "^0+(?=[0-9])", "")
    return F.when(F.length(plain) <= 9, plain.cast("long")).otherwise(F.lit(-1).cast("long"))


def parse_route(path: Column) -> Column:
    """period, z, x, y of a tile path; null if it is none or out of range."""
    part = [F.regexp_extract(path, ROUTE, i) for i in range(1, 5)]
    z, x, y = (F.when(p != "", _number(p)) for p in part[1:])
    period = F.when(part[0] == "forecast-next-day", "forecast_next_day").otherwise("current")
    return F.when(path.rlike(ROUTE) & in_range(F.when(z.between(MIN_ZOOM, MAX_ZOOM), z), x, y), F.struct(period.alias("period"), z.alias("z"), x.alias("x"), y.alias("y")))


def classify_route(path: Column) -> Column:
    """ok, or why a path is no tile: unknown_route, not_canonical, zoom_out_of_range, tile_out_of_range."""
    parts = [F.regexp_extract(path, STRICT_ROUTE, i) for i in (1, 2, 3)]
    canonical = parts[0].rlike(r"^(0|[1-9][0-9]*)\z") & parts[1].rlike(r"^(0|[1-9][0-9]*)\z") & parts[2].rlike(r"^(0|[1-9][0-9]*)\z")
    z, x, y = (F.when(F.length(p) <= 9, F.try_to_number(p, F.lit("999999999")).cast("long")).otherwise(F.lit(-1).cast("long")) for p in parts)
    fits = (x >= 0) & (y >= 0) & (x < extent(F.least(z, F.lit(30)))) & (y < extent(F.least(z, F.lit(30))))
    return (
        F.when(~path.rlike(STRICT_ROUTE), "unknown_route").when(~canonical, "not_canonical").when(~z.between(MIN_ZOOM, MAX_ZOOM), "zoom_out_of_range").when(~fits, "tile_out_of_range").otherwise("ok")
    )


def hatched(global_x: Column, global_y: Column) -> Column:
    """Whether the global hatch paints a pixel."""
    return F.pmod(global_x + global_y, F.lit(HATCH_PERIOD)) < HATCH_WIDTH
