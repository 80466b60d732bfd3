"""Tiles that shapes touch, their neighbours and per-zoom summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import tiles as t


def candidates(boxes: DataFrame, zooms: tuple[int, ...] = tuple(range(t.MIN_ZOOM, t.MAX_ZOOM + 1))) -> DataFrame:
    """Rows (with min_x, min_y, max_x, max_y in metres) times the tiles z, x, y that their box touches."""
    z = F.explode(F.array(*map(F.lit, zooms))).alias("z")
    own = boxes.select("*", z)
    across = F.sequence(t.tile_x(F.col("z"), F.col("min_x")), t.tile_x(F.col("z"), F.col("max_x")))
    down = F.sequence(t.tile_y(F.col("z"), F.col("max_y")), t.tile_y(F.col("z"), F.col("min_y")))
    return own.withColumn("x", F.explode(across)).withColumn("y", F.explode(down))


def touches(box: Column, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """Whether two boxes share a point; touching sides count."""
    return (box["min_x"] <= max_x) & (box["max_x"] >= min_x) & (box["min_y"] <= max_y) & (box["max_y"] >= min_y)


def enumerate_tiles(segments: DataFrame, key: str, zooms: tuple[int, ...]) -> DataFrame:
    """Distinct key, z, x, y of the tiles that edges (key, ax..by) cross, exactly: candidates by box, refined by clipping.

    Tiles wholly inside a shape have no edge; fill_rows adds them.
    """
    box = segments.select("*", F.least("ax", "bx").alias("min_x"), F.least("ay", "by").alias("min_y"), F.greatest("ax", "bx").alias("max_x"), F.greatest("ay", "by").alias("max_y"))
    own = candidates(box, zooms).withColumn("b", t.bounds(F.col("z"), F.col("x"), F.col("y")))
    # a segment meets a box that its own box meets, unless all four corners lie on one side of its line
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = [dx * (F.col(f"b.{v}_y") - F.col("ay")) - dy * (F.col(f"b.{h}_x") - F.col("ax")) for h in ("min", "max") for v in ("min", "max")]
    crosses = (F.least(*side) <= 0) & (F.greatest(*side) >= 0)
    hit = touches(F.col("b"), F.col("min_x"), F.col("min_y"), F.col("max_x"), F.col("max_y")) & crosses
    return own.where(hit).select(key, "z", "x", "y").distinct()


def fill_rows(segments: DataFrame, edge_tiles: DataFrame, key: str) -> DataFrame:
    """edge_tiles with the tiles inside: in a row of tiles, between two edge tiles whose middle line is inside by the even-odd rule.

    segments: closed outlines. For each gap the crossings left of it are counted on the line through the tiles' middles.
    """
    order = Window.partitionBy(key, "z", "y").orderBy("x")
    gaps = edge_tiles.withColumn("next", F.lead("x").over(order)).where(F.col("next") > F.col("x") + 1)
    b = t.bounds(F.col("z"), F.col("x") + 1, F.col("y"))
    gaps = gaps.select(key, "z", "x", "y", "next", ((b["min_x"] + b["max_x"]) / 2).alias("px"), ((b["min_y"] + b["max_y"]) / 2).alias("py"))
    # edges are sent to the rows of tiles whose middle line they cross
    zooms = F.array(*[F.lit(int(r["z"])) for r in edge_tiles.select("z").distinct().collect()])
    sent = segments.select(key, "ax", "ay", "bx", "by", F.explode(zooms).alias("z")).where("ay <> by")
    span = F.lit(t.WORLD) / t.extent(F.col("z"))
    row = lambda v: (F.lit(t.HALF_WORLD) - v) / span - 0.5
    first, last = F.ceil(row(F.greatest("ay", "by"))) - 1, F.floor(row(F.least("ay", "by"))) + 1
    sent = sent.withColumn("y", F.explode(F.sequence(first, last)))
    s, g = sent.alias("s"), gaps.alias("g")
    above = (F.col("s.ay") > F.col("g.py")) != (F.col("s.by") > F.col("g.py"))
    cross = F.col("s.ax") + (F.col("g.py") - F.col("s.ay")) / (F.col("s.by") - F.col("s.ay")) * (F.col("s.bx") - F.col("s.ax"))
    same = (F.col(f"g.{key}") == F.col(f"s.{key}")) & (F.col("g.z") == F.col("s.z")) & (F.col("g.y") == F.col("s.y"))
    inside = g.join(s, same & above & (cross < F.col("g.px"))).groupBy(f"g.{key}", "g.z", "g.x", "g.y", "g.next").count().where("count % 2 = 1")
    filled = inside.select(key, "z", F.explode(F.sequence(F.col("x") + 1, F.col("next") - 1)).alias("x"), "y")
    return edge_tiles.select(key, "z", "x", "y").union(filled).distinct()


def neighbours(tiles: DataFrame) -> DataFrame:
    """z, x, y and direction (east, south) where the next tile is covered too."""
    own = tiles.select("z", "x", "y").distinct()
    to = [("east", 1, 0), ("south", 0, 1)]
    moved = own.select("z", "x", "y", F.explode(F.array(*[F.struct(F.lit(d).alias("direction"), (F.col("x") + i).alias("nx"), (F.col("y") + j).alias("ny")) for d, i, j in to])).alias("n"))
    there = own.select("z", F.col("x").alias("nx"), F.col("y").alias("ny"))
    return moved.select("z", "x", "y", "n.*").join(there, ["z", "nx", "ny"]).select("z", "x", "y", "direction")


def zoom_summary(tiles: DataFrame, size: str) -> DataFrame:
    """Tiles, bytes and bounds for each zoom and in total (null zoom)."""
    return tiles.rollup("z").agg(F.count(F.lit(1)).alias("tiles"), F.sum(size).alias("bytes"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def first_middle_last(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The first, middle and last row of each group, with position."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = rows.withColumn("_rn", F.row_number().over(w)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(group)))
    middle = F.floor(F.col("_n") / 2) + 1
    position = F.when(F.col("_rn") == 1, "first").when(F.col("_rn") == F.col("_n"), "last").when(F.col("_rn") == middle, "middle")
    return ranked.withColumn("position", position).where("position is not null").drop("_rn", "_n")


def best_pairs(pairs: DataFrame, score: str) -> DataFrame:
    """z, direction, x, y, score of the neighbours (neighbours() with a score) that come last by score, x and y in each zoom and direction."""
    best = F.max(F.struct(F.col(score).alias("score"), "x", "y")).alias("m")
    return pairs.groupBy("z", "direction").agg(best).select("z", "direction", "m.x", "m.y", "m.score")


def window_edges(segments: DataFrame, key: str, zooms: tuple[int, ...], overscan: int = t.OVERSCAN) -> DataFrame:
    """Edges (key, ax..by) with each tile z, x, y whose window, wider by so many pixels on every side, they meet.

    Candidates are the tiles of the edge's box made wider; those whose window lies to one side of the edge's line go.
    """
    z = F.explode(F.array(*map(F.lit, zooms))).alias("z")
    own = segments.select("*", z).withColumn("_o", F.lit(t.WORLD / t.TILE_SIZE * overscan) / t.extent(F.col("z")))
    low, high = (lambda a: F.least(f"a{a}", f"b{a}")), (lambda a: F.greatest(f"a{a}", f"b{a}"))
    across = F.sequence(t.tile_x(F.col("z"), low("x") - F.col("_o")), t.tile_x(F.col("z"), high("x") + F.col("_o")))
    down = F.sequence(t.tile_y(F.col("z"), high("y") + F.col("_o")), t.tile_y(F.col("z"), low("y") - F.col("_o")))
    own = own.withColumn("x", F.explode(across)).withColumn("y", F.explode(down)).withColumn("_b", t.bounds(F.col("z"), F.col("x"), F.col("y")))
    left, right, bottom, top = F.col("_b.min_x") - F.col("_o"), F.col("_b.max_x") + F.col("_o"), F.col("_b.min_y") - F.col("_o"), F.col("_b.max_y") + F.col("_o")
    dx, dy = F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")
    side = [dx * (v - F.col("ay")) - dy * (h - F.col("ax")) for h in (left, right) for v in (bottom, top)]
    meets = (low("x") <= right) & (high("x") >= left) & (low("y") <= top) & (high("y") >= bottom) & (F.least(*side) <= 0) & (F.greatest(*side) >= 0)
    return own.where(meets).drop("_o", "_b")
