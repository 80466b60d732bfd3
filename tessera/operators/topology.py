"""Dissolve, borders and coverage of multipolygons by their edges, where neighbours share vertices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def edges(shapes: DataFrame, key: str, geometry: str) -> DataFrame:
    """key, ax, ay, bx, by: the directed edges of all rings; vertices without length are left out."""
    rings = shapes.select(key, F.explode(F.flatten(geometry)).alias("r"))
    pairs = F.zip_with(F.slice("r", F.lit(1), F.size("r") - 1), F.slice("r", F.lit(2), F.size("r")), lambda a, b: F.struct(a["x"].alias("ax"), a["y"].alias("ay"), b["x"].alias("bx"), b["y"].alias("by")))
    return rings.select(key, F.explode(pairs).alias("e")).select(key, "e.*").where("ax <> bx or ay <> by")


def _ends(a: str = "a", b: str = "b") -> list[Column]:
    p, q = F.struct(F.col(f"{a}x").alias("x"), F.col(f"{a}y").alias("y")), F.struct(F.col(f"{b}x").alias("x"), F.col(f"{b}y").alias("y"))
    return [F.least(p, q).alias("p"), F.greatest(p, q).alias("q")]


def dissolve(own: DataFrame, zone: str) -> DataFrame:
    """Edges (zone, ax..by) that bound the union of each zone's shapes: those that occur an odd number of times without direction.

    Holds where shapes of a zone don't overlap and share vertices; check() finds others.
    """
    counted = own.groupBy(zone, *_ends()).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("ax", "ay", "bx", "by")).alias("e"))
    return counted.where("n % 2 = 1").select(zone, "e.*")


def measures(outline: DataFrame, zone: str) -> DataFrame:
    """zone, area, perimeter, edges of outlines with shells counter-clockwise."""
    return outline.groupBy(zone).agg(
        (F.sum(F.col("ax") * F.col("by") - F.col("bx") * F.col("ay")) / 2).alias("area"),
        F.sum(F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))).alias("perimeter"),
        F.count(F.lit(1)).alias("edges"),
    )


def borders(outline: DataFrame, zone: str) -> DataFrame:
    """left, right, length: what two zones share of their outlines."""
    sides = outline.select(F.col(zone).alias("zone"), *_ends(), F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")).alias("length"))
    by = sides.groupBy("p", "q").agg(F.array_sort(F.collect_set("zone")).alias("zones"), F.max("length").alias("length")).where(F.size("zones") == 2)
    return by.groupBy(F.col("zones")[0].alias("left"), F.col("zones")[1].alias("right")).agg(F.sum("length").alias("length"))


def coverage(shapes: DataFrame, outline: DataFrame, zone: str, absolute: float, relative: float) -> DataFrame:
    """zone, parts_area, union_area, difference, tolerance, passes: the parts' summed area against the union's. Overlaps and
    edges that don't match show as a difference."""
    parts = measures(shapes, zone).select(zone, F.col("area").alias("parts_area"))
    whole = measures(outline, zone).select(zone, F.col("area").alias("union_area"))
    difference = F.abs(F.col("parts_area") - F.col("union_area"))
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.abs("parts_area"))
    return parts.join(whole, zone, "full_outer").select(zone, "parts_area", "union_area", difference.alias("difference"), tolerance.alias("tolerance"), F.coalesce(difference <= tolerance, F.lit(False)).alias("passes"))


def repair(shapes: DataFrame, key: str, geometry: str, absolute: float, relative: float) -> tuple[DataFrame, DataFrame]:
    """Outlines of shapes whose parts share segments, with the parts merged: (outline edges, report).

    A segment that two parts of a shape share is no border: both copies go, as lines without area. report, for shapes that had such:
    key, discarded (segments), discarded_length, area_before, area_after, tolerance, passes; others are valid in this respect.
    """
    own = edges(shapes, key, geometry)
    counted = own.groupBy(key, *_ends()).agg(F.count(F.lit(1)).alias("n"), F.first(F.struct("ax", "ay", "bx", "by")).alias("e"))
    outline = counted.where("n % 2 = 1").select(key, "e.*")
    length = F.hypot(F.col("q.x") - F.col("p.x"), F.col("q.y") - F.col("p.y"))
    lost = counted.where("n > 1").groupBy(key).agg(F.count(F.lit(1)).alias("discarded"), F.sum(length).alias("discarded_length"))
    area = lambda rows, name: measures(rows, key).select(key, F.col("area").alias(name))
    report = lost.join(area(own, "area_before"), key).join(area(outline, "area_after"), key)
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.abs("area_before"))
    return outline, report.select("*", tolerance.alias("tolerance"), (F.abs(F.col("area_after") - F.col("area_before")) <= tolerance).alias("passes"))


def near_pairs(boxes: DataFrame, key: str, cell: float) -> DataFrame:
    """left, right: keys whose boxes (min_x, min_y, max_x, max_y) share a point, left before right; found by cells of the grid both are in."""
    across, down = (F.sequence(F.floor(F.col(f"min_{a}") / cell), F.floor(F.col(f"max_{a}") / cell)) for a in "xy")
    cells = boxes.select(key, "min_x", "min_y", "max_x", "max_y", F.explode(across).alias("i"), down.alias("j")).withColumn("j", F.explode("j"))
    a, b = cells.alias("a"), cells.alias("b")
    meet = (F.col("a.min_x") <= F.col("b.max_x")) & (F.col("b.min_x") <= F.col("a.max_x")) & (F.col("a.min_y") <= F.col("b.max_y")) & (F.col("b.min_y") <= F.col("a.max_y"))
    same = (F.col("a.i") == F.col("b.i")) & (F.col("a.j") == F.col("b.j"))
    return a.join(b, same & (F.col(f"a.{key}") < F.col(f"b.{key}")) & meet).select(F.col(f"a.{key}").alias("left"), F.col(f"b.{key}").alias("right")).distinct()


def overlaps(outline: DataFrame, zone: str, pairs: DataFrame) -> DataFrame:
    """left, right, area of what two zones share, for outlines with shells counter-clockwise and holes clockwise.

    The area under a zone's edges, each counted by its direction, is the zone's; so what two zones share is the sum over their
    edges' pairs of the area under the lower of both, where they lie above each other. Edges are joined within a pair of zones.
    """
    floor_y = outline.agg(F.min(F.least("ay", "by")).alias("_floor"))
    e = outline.where("ax <> bx").crossJoin(F.broadcast(floor_y)).select(
        F.col(zone).alias("zone"), F.least("ax", "bx").alias("x0"), F.greatest("ax", "bx").alias("x1"), F.when(F.col("ax") < F.col("bx"), F.col("ay")).otherwise(F.col("by")).alias("y0"),
        F.when(F.col("ax") < F.col("bx"), F.col("by")).otherwise(F.col("ay")).alias("y1"), F.when(F.col("ax") < F.col("bx"), -1.0).otherwise(1.0).alias("s"), "_floor",
    )
    left = pairs.join(e.select(F.col("zone").alias("left"), F.struct("x0", "x1", "y0", "y1", "s", "_floor").alias("a")), "left")
    right = pairs.join(e.select(F.col("zone").alias("right"), F.struct("x0", "x1", "y0", "y1", "s").alias("b")), "right")
    both = left.alias("l").join(right.alias("r"), (F.col("l.left") == F.col("r.left")) & (F.col("l.right") == F.col("r.right")) & (F.col("a.x0") < F.col("b.x1")) & (F.col("b.x0") < F.col("a.x1")), "inner")
    both = both.select(F.col("l.left").alias("left"), F.col("l.right").alias("right"), "a", "b", F.greatest("a.x0", "b.x0").alias("x0"), F.least("a.x1", "b.x1").alias("x1"))

    def height(side: str, x: str) -> Column:
        y = F.col(f"{side}.y0") + (F.col(x) - F.col(f"{side}.x0")) / (F.col(f"{side}.x1") - F.col(f"{side}.x0")) * (F.col(f"{side}.y1") - F.col(f"{side}.y0"))
        return y - F.col("a._floor")

    both = both.select("left", "right", (F.col("a.s") * F.col("b.s")).alias("s"), (F.col("x1") - F.col("x0")).alias("w"), height("a", "x0").alias("a0"), height("a", "x1").alias("a1"), height("b", "x0").alias("b0"), height("b", "x1").alias("b1"))
    d0, d1 = F.col("a0") - F.col("b0"), F.col("a1") - F.col("b1")
    low0, low1 = F.least("a0", "b0"), F.least("a1", "b1")
    t = d0 / (d0 - d1)
    meet = F.col("a0") + t * (F.col("a1") - F.col("a0"))
    area = F.when(d0 * d1 < 0, (low0 + meet) / 2 * t + (meet + low1) / 2 * (1 - t)).otherwise((low0 + low1) / 2) * F.col("w")
    found = both.groupBy("left", "right").agg(F.sum(F.col("s") * area).alias("area"))
    return pairs.join(found, ["left", "right"], "left").select("left", "right", F.greatest(F.lit(0.0), F.coalesce("area", F.lit(0.0))).alias("area"))


def pair_report(outline: DataFrame, zone: str, pairs: DataFrame, absolute: float, relative: float) -> DataFrame:
    """left, right, overlap, difference (of left without right), symmetric_difference, border, tolerance, passes of pairs of zones."""
    area = measures(outline, zone).select(F.col(zone).alias("zone"), "area")
    rows = overlaps(outline, zone, pairs).withColumnRenamed("area", "overlap")
    rows = rows.join(area.select(F.col("zone").alias("left"), F.col("area").alias("a")), "left").join(area.select(F.col("zone").alias("right"), F.col("area").alias("b")), "right")
    rows = rows.join(borders(outline, zone).withColumnRenamed("length", "border"), ["left", "right"], "left")
    tolerance = F.greatest(F.lit(absolute), F.lit(relative) * F.least("a", "b"))
    return rows.select(
        "left", "right", "overlap", (F.col("a") - F.col("overlap")).alias("difference"), (F.col("a") + F.col("b") - 2 * F.col("overlap")).alias("symmetric_difference"),
        F.coalesce("border", F.lit(0.0)).alias("border"), tolerance.alias("tolerance"), (F.col("overlap") <= tolerance).alias("passes"),
    )


def inside(points: DataFrame, outline: DataFrame, zone: str, boxes: DataFrame, cell: float) -> DataFrame:
    """The points (with px, py) with each zone that they are in by the even-odd rule; boxes: zone, min_x..max_y, which are met by grid cells."""
    across, down = (F.sequence(F.floor(F.col(f"min_{a}") / cell), F.floor(F.col(f"max_{a}") / cell)) for a in "xy")
    cells = boxes.select(zone, "min_x", "min_y", "max_x", "max_y", F.explode(across).alias("_i"), down.alias("_j")).withColumn("_j", F.explode("_j"))
    own = points.withColumns({"_i": F.floor(F.col("px") / cell), "_j": F.floor(F.col("py") / cell)})
    near = own.join(cells, ["_i", "_j"]).where("px between min_x and max_x and py between min_y and max_y").select(*points.columns, zone)
    above = (F.col("ay") > F.col("py")) != (F.col("by") > F.col("py"))
    cross = F.col("ax") + (F.col("py") - F.col("ay")) / (F.col("by") - F.col("ay")) * (F.col("bx") - F.col("ax"))
    hits = near.join(outline, zone).where(above & (cross > F.col("px")))
    return hits.groupBy(*points.columns, zone).count().where("count % 2 = 1").drop("count")


def extreme_vertex(outline: DataFrame, zone: str) -> DataFrame:
    """zone, x, y of the vertex farthest east, of those the one farthest south."""
    best = F.max(F.struct(F.col("ax").alias("x"), (-F.col("ay")).alias("south"))).alias("v")
    return outline.groupBy(zone).agg(best).select(zone, "v.x", (-F.col("v.south")).alias("y"))


def zone_records(shapes: DataFrame, zone: str, shape: str) -> DataFrame:
    """Statistics of zones from canonical shapes that don't overlap: zone, area, min_x, min_y, max_x, max_y, parts, holes, municipalities."""
    area = F.aggregate(F.flatten(shape), F.lit(0.0), lambda a, r: a + g.signed_area(r))
    rows = shapes.select(zone, area.alias("a"), g.bbox(F.col(shape)).alias("b"), g.part_count(F.col(shape)).alias("p"), g.hole_count(F.col(shape)).alias("h"))
    return rows.groupBy(zone).agg(
        F.sum("a").alias("area"), *[F.min(f"b.min_{v}").alias(f"min_{v}") for v in "xy"], *[F.max(f"b.max_{v}").alias(f"max_{v}") for v in "xy"],
        F.sum("p").alias("parts"), F.sum("h").alias("holes"), F.count(F.lit(1)).alias("municipalities"),
    )
