"""Queries of geometry and tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import affine, png
from ..functions import geometry as g
from ..functions import tiles as t
from ..operators import pyramid, rendering, topology
from ..sources import geojson
from .base import query, table
from .registry import BOXES, POINTS, _boxes, _points, _tiles

ZOOMS = (6, 7, 8, 9, 10, 11)


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(rows: DataFrame, key: str, corners: list[tuple[Column, Column]]) -> DataFrame:
    """Edges of a shape with one ring of these corners, counter-clockwise."""
    ring = F.array(*[_point(x, y) for x, y in [*corners, corners[0]]])
    return topology.edges(rows.select(key, F.array(F.array(ring)).alias("geometry")), key, "geometry")


WIDE = "wide AS (SELECT label, min(px) AS min_x, min(py) AS min_y, min(px) + 900000.0 AS max_x, min(py) + 800000.0 AS max_y FROM points GROUP BY label)"


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes that many points are in and many of which overlap."""
    low = _points(spark, sf_dir).groupBy("label").agg(F.min("px").alias("min_x"), F.min("py").alias("min_y"))
    return low.withColumn("max_x", F.col("min_x") + 900000.0).withColumn("max_y", F.col("min_y") + 800000.0)


def _triangles(boxes: DataFrame) -> DataFrame:
    c = F.col
    return _edges(boxes, "label", [(c("min_x"), c("min_y")), (c("max_x"), c("min_y")), (c("min_x"), c("max_y"))])


def _rectangles(boxes: DataFrame) -> DataFrame:
    c = F.col
    return _edges(boxes, "label", [(c("min_x"), c("min_y")), (c("max_x"), c("min_y")), (c("max_x"), c("max_y")), (c("min_x"), c("max_y"))])


@query(f"""WITH {POINTS}, {BOXES}, b AS (SELECT t.*, 40075016.685578488 / (1 << z) AS w FROM tiles t), c AS (SELECT b.label, z, x, y, x * w - 20037508.342789244 AS tx, 20037508.342789244 - (y + 1) * w AS ty, min_x, min_y FROM b JOIN boxes USING (label))
    SELECT label, z, x, y FROM c WHERE (greatest(tx, min_x) - min_x) / 30000.0 + (greatest(ty, min_y) - min_y) / 20000.0 <= 1""")
def polygon_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tiles that right triangles meet, exactly: those on their edges, and those inside. SQL has the half-plane of the long side."""
    outline = _triangles(_boxes(spark, sf_dir))
    return pyramid.fill_rows(outline, pyramid.enumerate_tiles(outline, "label", ZOOMS), "label")


PAIRS = WIDE + ", pairs AS (SELECT a.label AS l, b.label AS r, least(a.max_x, b.max_x) - greatest(a.min_x, b.min_x) AS w, least(a.max_y, b.max_y) - greatest(a.min_y, b.min_y) AS h FROM wide a JOIN wide b ON a.label < b.label)"


@query(f"""WITH {POINTS}, {PAIRS} SELECT l AS "left", r AS "right", round(w * h / 1e6) AS overlap, round((72e10 - w * h) / 1e6) AS difference, round((144e10 - 2 * w * h) / 1e6) AS symmetric_difference, 72e9 AS tolerance, w * h <= 72e9 AS passes FROM pairs WHERE w >= 0 AND h >= 0""")
def zone_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of boxes that meet: what they share and what they do not, in square kilometres, against a tolerance of a tenth."""
    boxes = _wide(spark, sf_dir)
    rows = topology.pair_report(_rectangles(boxes), "label", topology.near_pairs(boxes, "label", 250000.0), 1.0, 0.1)
    area = [F.round(F.col(c) / 1e6).alias(c) for c in ("overlap", "difference", "symmetric_difference")]
    return rows.select("left", "right", *area, F.round("tolerance").alias("tolerance"), "passes")


@query(f"""WITH {POINTS}, {WIDE} SELECT vec_id, b.label AS zone FROM points JOIN wide b ON px >= min_x AND py >= min_y AND (px - min_x) / 900000.0 + (py - min_y) / 800000.0 < 1""")
def points_in_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with the triangles that they are in, by grid cells and the even-odd rule."""
    points = _points(spark, sf_dir).select("vec_id", "px", "py")
    boxes = _wide(spark, sf_dir)
    found = topology.inside(points, _triangles(boxes).withColumnRenamed("label", "zone"), "zone", boxes.withColumnRenamed("label", "zone"), 250000.0)
    return found.select("vec_id", "zone")


@query("""SELECT n_nationkey AS nation, CAST(1 AS BIGINT) AS discarded, CAST(100 AS DOUBLE) AS discarded_length, CAST(20000 AS DOUBLE) AS area_before, CAST(20000 AS DOUBLE) AS area_after, CAST(2 AS DOUBLE) AS tolerance, true AS passes FROM nation WHERE n_nationkey % 3 = 0""")
def geometry_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two boxes a nation; every third nation's share a side, which goes when they are merged."""
    k = F.col("n_nationkey")
    x = k.cast("double") * 1000.0
    gap = F.when(k % 3 == 0, 100.0).otherwise(150.0)

    def box(low: Column) -> Column:
        return F.array(F.array(_point(low, F.lit(0.0)), _point(low + 100.0, F.lit(0.0)), _point(low + 100.0, F.lit(100.0)), _point(low, F.lit(100.0)), _point(low, F.lit(0.0))))

    shapes = table(spark, sf_dir, "nation").select(k.alias("nation"), F.array(box(x), box(x + gap)).alias("geometry"))
    return topology.repair(shapes, "nation", "geometry", 1.0, 0.0001)[1]


def _rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A multipolygon for each supplier: a clockwise shell with a repeated vertex, with a counter-clockwise hole for every second, and a
    second part for every third."""
    k = F.col("s_suppkey")
    x, s = k.cast("double") * 10, 1.0 + (k % 7)

    def ring(low: Column, size: Column, ccw: bool) -> Column:
        corners = [(low, F.lit(1.0)), (low + size, F.lit(1.0)), (low + size, F.lit(1.0) + size), (low, F.lit(1.0) + size)]
        corners = corners if ccw else corners[::-1]
        return F.array(*[_point(a, b) for a, b in [corners[1], corners[1], *corners[2:], corners[0], corners[1]]])

    first = F.when(k % 2 == 0, F.array(ring(x, s, False), ring(x + s / 4, s / 4, True))).otherwise(F.array(ring(x, s, False)))
    shape = F.when(k % 3 == 0, F.array(F.array(ring(x + 100.0, s, True)), first)).otherwise(F.array(first))
    return table(spark, sf_dir, "supplier").select(k.alias("key"), s.alias("side"), shape.alias("shape"))


@query("""SELECT s_suppkey AS key, CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS parts, CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END AS holes, CAST(-(1 + s_suppkey % 7) * (1 + s_suppkey % 7) AS DOUBLE) AS given_area, CAST((1 + s_suppkey % 7) * (1 + s_suppkey % 7) AS DOUBLE) AS shell_area,
    CAST(CASE WHEN s_suppkey % 2 = 0 THEN -(1 + s_suppkey % 7) * (1 + s_suppkey % 7) / 16 ELSE 0 END AS DOUBLE) AS hole_area, CAST(10 * s_suppkey AS DOUBLE) AS first_x, CAST(1 AS DOUBLE) AS first_y, 5 AS vertices FROM supplier""")
def canonical_rings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, holes, signed areas before and after, and the first vertex of canonical multipolygons: shells turn left, holes right,
    repeats go, each ring begins at its least vertex, and parts are in order."""
    rows = _rings(spark, sf_dir).select("key", "shape", g.canonical(F.col("shape")).alias("own"), F.element_at("shape", -1).alias("given"))
    shell = F.col("own")[0][0]
    hole = F.when(F.size(F.col("own")[0]) > 1, g.signed_area(F.get(F.col("own")[0], F.lit(1)))).otherwise(0.0)
    return rows.select("key", g.part_count(F.col("own")).alias("parts"), g.hole_count(F.col("own")).alias("holes"), g.signed_area(F.col("given")[0]).alias("given_area"), g.signed_area(shell).alias("shell_area"), hole.alias("hole_area"),
                       shell[0]["x"].alias("first_x"), shell[0]["y"].alias("first_y"), F.size(shell).alias("vertices"))


@query("""SELECT s_suppkey AS key, 2 + 2 * CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END AS parts, 5 AS promoted_vertices FROM supplier""")
def flattened_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Collections (a shape, null, a shape with an empty part, two promoted polygons) as one list of parts."""
    rows = _rings(spark, sf_dir)
    ring = F.array(_point(F.lit(0), F.lit(0)), _point(F.lit(1), F.lit(0)), _point(F.lit(1), F.lit(1)), _point(F.lit(0), F.lit(1)), _point(F.lit(0), F.lit(0)))
    one = g.promoted(F.array(ring))
    none = F.lit(None).cast(g.MULTIPOLYGON)
    hollow = F.concat(F.col("shape"), F.array(F.array().cast(g.MULTIPOLYGON.elementType)))
    return rows.select("key", F.size(g.flattened(F.array(F.col("shape"), none, hollow, one, one))).alias("parts"), F.size(one[0][0]).alias("promoted_vertices"))


@query(f"""WITH {POINTS}, {BOXES} SELECT label, min_x + 30000.0 AS x, min_y AS y FROM boxes""")
def extreme_vertices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topology.extreme_vertex(_rectangles(_boxes(spark, sf_dir)), "label")


@query(f"""WITH {POINTS} SELECT vec_id, CAST(round(px / 1e6, 4) + 0.0 AS DOUBLE) AS x, CAST(round(py / 1e6, 4) + 0.0 AS DOUBLE) AS y FROM points""")
def clean_coordinates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).select("vec_id", g.rounded(F.col("px") / 1e6, 4).alias("x"), g.rounded(F.col("py") / 1e6, 4).alias("y"))


@query("""SELECT s_suppkey AS key, 0 AS part, 0 AS ring, CASE s_suppkey % 6 WHEN 0 THEN 'shell_clockwise' WHEN 1 THEN 'open_ring' WHEN 2 THEN 'range' WHEN 3 THEN 'not_finite' ELSE 'short_ring' END AS problem FROM supplier WHERE s_suppkey % 6 <> 5""")
def geojson_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squares in degrees with a planted fault for five of six suppliers: the rule of the published form that each breaks."""
    k = F.col("s_suppkey") % 6
    x = F.col("s_suppkey").cast("double") / 1000
    far = F.when(k == 2, 500.0).when(k == 3, float("nan")).otherwise(1.0)
    corners = [_point(x, F.lit(0)), _point(x + far, F.lit(0)), _point(x + far, F.lit(1)), _point(x, F.lit(1))]
    ring = F.when(k == 0, F.array(*corners[::-1], corners[3])).when(k == 1, F.array(*corners)).when(k == 4, F.array(corners[0], corners[1], corners[0])).otherwise(F.array(*corners, corners[0]))
    return geojson.violations(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.array(F.array(ring)).alias("parts")), "key", "parts")


@query(f"""WITH {POINTS}, b AS (SELECT min(px) AS x0, min(py) AS y0, max(px) AS x1, max(py) AS y1 FROM points), r AS (SELECT 990.0 / (y1 - y0) AS s, 400.0 - 990.0 / (y1 - y0) * (x0 + x1) / 2 AS tx, 5.0 + 990.0 / (y1 - y0) * y1 AS ty FROM b),
    d AS (SELECT label, vec_id % 4 AS e, px * s + tx AS x, ty - py * s AS y FROM points, r), e AS (SELECT label, sqrt(power(x - (floor(x) + e / 4), 2) + power(y - floor(y), 2)) AS d FROM d)
    SELECT label, count(*) AS n, round(max(d), 3) AS worst, max(d) <= 1.2 AS passes FROM e GROUP BY label""")
def map_registration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All points registered by their bounding box on an image of 1000 rows, as control points seen at whole pixels: the worst residual by label."""
    points = _points(spark, sf_dir)
    box = points.agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))
    by = box.select(affine.register(0.0, 5.0, 800.0, 995.0, F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1")).alias("by"))
    rows = points.crossJoin(F.broadcast(by)).withColumn("at", affine.pixel(F.col("by"), F.col("px"), F.col("py")))
    seen = rows.withColumn("d", affine.residual(F.col("at"), F.floor("at.x") + (F.col("vec_id") % 4) / 4, F.floor("at.y")))
    return affine.worst(seen, "label", "d", 1.2).withColumn("worst", F.round("worst", 3))


def _raster(key: Column, kind: str, work) -> Column:
    """A column from a tile of (row + column + key) mod 16 for each key, in Arrow batches."""

    @F.pandas_udf(kind)
    def run(keys: pd.Series) -> pd.Series:
        grid = np.add.outer(np.arange(png.SIDE), np.arange(png.SIDE))
        return keys.map(lambda k: work(((grid + k) % 16).astype(np.uint8), int(k)))

    return run(key)


PALETTE = bytes(v for i in range(16) for v in (i * 10, 255 - i, i))
PIXELS = "pixels AS (SELECT n_nationkey AS k, r, c, (r + c + n_nationkey) % 16 AS i FROM nation CROSS JOIN range(256) a(r) CROSS JOIN range(256) b(c))"


@query(f"""WITH {PIXELS} SELECT k AS tile, i * 10 AS red, 255 - i AS green, i AS blue, CAST(CASE i WHEN 0 THEN 0 WHEN 15 THEN 179 ELSE 77 END AS BIGINT) AS alpha, count(*) AS n FROM pixels GROUP BY k, i""")
def rgba_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles encoded, decoded and expanded to RGBA: how many pixels have which colour."""

    def count(indices: np.ndarray, k: int) -> list[list[int]]:
        own = png.rgba(png.decode(png.encode(indices, PALETTE)), PALETTE).reshape(-1, 4)
        colours, n = np.unique(own, axis=0, return_counts=True)
        return [[*map(int, c), int(m)] for c, m in zip(colours, n, strict=True)]

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), F.explode(_raster(F.col("n_nationkey"), "array<array<long>>", count)).alias("v"))
    return rows.select("tile", *[F.col("v")[i].alias(c) for i, c in enumerate(("red", "green", "blue", "alpha", "n"))])


@query("""SELECT n_nationkey AS tile, lower(list_aggregate(list_transform(range(16), lambda i: CASE WHEN i BETWEEN 1 AND 7 THEN format('{:02x}{:02x}{:02x}', (n_nationkey * i) % 256, i * 30, 17)
    WHEN i BETWEEN 8 AND 14 THEN format('{:02x}{:02x}{:02x}', CAST(floor(((n_nationkey * (i - 7)) % 256) * CAST(0.55 AS DOUBLE) + 0.5) AS BIGINT), CAST(floor((i - 7) * 30 * CAST(0.55 AS DOUBLE) + 0.5) AS BIGINT), 9) ELSE format('{:02x}{:02x}{:02x}', i * 10, 255 - i, i) END), 'string_agg', '')) AS palette,
    true AS same_pixels, true AS valid FROM nation""")
def recoloured_palettes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles recoloured with hatches: the palette's bytes as they then are, whether the pixels are the same and the file holds its contract."""

    def paint(indices: np.ndarray, k: int) -> list[str]:
        tile = png.recolour(png.encode(indices, PALETTE), [[(k * i) % 256, i * 30, 17] for i in range(1, 8)], True)
        return [png.check(tile)[b"PLTE"].hex(), str(bool((png.decode(tile) == indices).all())), str(all(ok for *_, ok in png.chunks(tile)))]

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), _raster(F.col("n_nationkey"), "array<string>", paint).alias("v"))
    return rows.select("tile", F.col("v")[0].alias("palette"), (F.col("v")[1] == "True").alias("same_pixels"), (F.col("v")[2] == "True").alias("valid"))


@query("""SELECT n_nationkey AS tile, sum(CASE WHEN ((a.i + n_nationkey * 256) + (b.i + n_nationkey * 3 * 256)) % 12 < 2 THEN 1 ELSE 0 END)::BIGINT AS hatched FROM nation CROSS JOIN range(256) a(i) CROSS JOIN range(256) b(i) GROUP BY 1""")
def hatch_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many pixels of a tile the global hatch paints, by the raster and by the column function, which must agree."""

    @F.pandas_udf("long")
    def painted(keys: pd.Series) -> pd.Series:
        whole = np.array([[-3e7, -3e7, 3e7, -3e7], [3e7, -3e7, 3e7, 3e7], [3e7, 3e7, -3e7, 3e7], [-3e7, 3e7, -3e7, -3e7]])
        return keys.map(lambda k: int(np.isin(png.render(whole, np.ones(4, int), 8, int(k), 3 * int(k)), range(8, 15)).sum()))

    k, grid = F.col("n_nationkey"), F.sequence(F.lit(0).cast("long"), F.lit(png.SIDE - 1).cast("long"))
    # along a row the hatch repeats, so a row's count follows from its first global pixel
    rows = F.transform(grid, lambda r: F.size(F.filter(grid, lambda c: t.hatched(c + k * png.SIDE, r + 3 * k * png.SIDE))))
    own = table(spark, sf_dir, "nation").select(k.alias("tile"), F.aggregate(rows, F.lit(0).cast("long"), lambda a, v: a + v).alias("hatched"), painted(k).alias("raster"))
    return own.select("tile", F.when(F.col("hatched") == F.col("raster"), F.col("hatched")).otherwise(-1).cast("long").alias("hatched"))


@query(f"""WITH {PIXELS}, seen AS (SELECT DISTINCT k, i FROM pixels WHERE i NOT IN (5, 9, 15)) SELECT n_nationkey AS tile, CAST(m AS INTEGER) AS missing FROM nation CROSS JOIN range(1, 16) x(m) WHERE NOT EXISTS (SELECT 1 FROM seen WHERE k = n_nationkey AND i = m)""")
def missing_indices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Palette indices that no tile of a zoom has: three were painted over."""

    def seen(indices: np.ndarray, k: int) -> list[int]:
        return np.unique(np.where(np.isin(indices, (5, 9, 15)), 0, indices)).tolist()

    tiles = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("z"), _raster(F.col("n_nationkey"), "array<int>", seen).alias("indices"))
    return rendering.missing_indices(tiles).select(F.col("z").alias("tile"), F.explode("missing").alias("missing"))


@query("""SELECT n_nationkey AS tile, true AS crops, CAST(n_nationkey % 5 + 1 AS BIGINT) AS width, CAST((n_nationkey % 5 + 1) * 16 * 16 AS BIGINT) AS overview, CAST(n_nationkey % 16 AS BIGINT) AS corner FROM nation""")
def mosaics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles side by side: every crop of the window is its tile, and an overview has one pixel for each 16 by 16."""

    def work(indices: np.ndarray, k: int) -> list[int]:
        n = k % 5 + 1
        window = png.mosaic({(i, 0): (indices + i) % 16 for i in range(n)}, 0, 0, n - 1, 0)
        same = all((png.crop(window, i, 0) == (indices + i) % 16).all() for i in range(n))
        return [int(same), window.shape[1] // png.SIDE, png.overview(window, 16).size, int(window[0, 0])]

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), _raster(F.col("n_nationkey"), "array<long>", work).alias("v"))
    return rows.select("tile", (F.col("v")[0] == 1).alias("crops"), F.col("v")[1].alias("width"), F.col("v")[2].alias("overview"), F.col("v")[3].alias("corner"))


@query("""WITH hits AS (SELECT n_nationkey AS k, min((r, c)) AS best FROM nation CROSS JOIN range(250) a(r) CROSS JOIN range(250) b(c) WHERE (r + c + n_nationkey) % 16 = 15 AND abs(r - (10 + n_nationkey)) <= 3 AND abs(c - (40 + 2 * n_nationkey)) <= 3 GROUP BY 1)
    SELECT n_nationkey AS tile, coalesce(best[2], -1) AS x, coalesce(best[1], -1) AS y FROM nation LEFT JOIN hits ON k = n_nationkey""")
def border_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first border pixel within three of a place, in each tile."""

    def work(indices: np.ndarray, k: int) -> list[int]:
        return list(png.border_near(indices, 40 + 2 * k, 10 + k) or (-1, -1))

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), _raster(F.col("n_nationkey"), "array<long>", work).alias("v"))
    return rows.select("tile", F.col("v")[0].alias("x"), F.col("v")[1].alias("y"))


@query(f"""WITH {POINTS}, {BOXES}, d AS (SELECT DISTINCT z, x, y FROM tiles), n AS (SELECT a.z, a.x, a.y, 'east' AS direction, (a.x * 7 + a.y * 13) % 257 AS score FROM d a JOIN d b ON a.z = b.z AND a.x + 1 = b.x AND a.y = b.y UNION ALL SELECT a.z, a.x, a.y, 'south', (a.x * 7 + a.y * 13) % 257 FROM d a JOIN d b ON a.z = b.z AND a.x = b.x AND a.y + 1 = b.y)
    SELECT z, direction, arg_max(x, (score, x, y)) AS x, arg_max(y, (score, x, y)) AS y, max(score) AS score FROM n GROUP BY z, direction""")
def best_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the pairs of neighbours in each zoom and direction the one with the highest score, then place."""
    scored = pyramid.neighbours(_tiles(spark, sf_dir)).withColumn("score", (F.col("x") * 7 + F.col("y") * 13) % 257)
    return pyramid.best_pairs(scored, "score")


@query(f"""WITH {POINTS}, {BOXES}, d AS (SELECT label, z, x, y, 40075016.685578488 / (1 << z) AS w, min_x, min_y, max_x, max_y FROM tiles JOIN boxes USING (label)), e AS (SELECT *, w / 32 AS o, x * w - 20037508.342789244 AS tx, 20037508.342789244 - (y + 1) * w AS ty FROM d)
    SELECT label, z, x, y, CAST((min_y BETWEEN ty - o AND ty + w + o AND max_x >= tx - o AND min_x <= tx + w + o)::INT + (max_y BETWEEN ty - o AND ty + w + o AND max_x >= tx - o AND min_x <= tx + w + o)::INT + (min_x BETWEEN tx - o AND tx + w + o AND max_y >= ty - o AND min_y <= ty + w + o)::INT + (max_x BETWEEN tx - o AND tx + w + o AND max_y >= ty - o AND min_y <= ty + w + o)::INT AS BIGINT) AS edges FROM e""")
def clip_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many edges of a box a tile's window with eight pixels of overscan meets."""
    own = pyramid.window_edges(_rectangles(_boxes(spark, sf_dir)), "label", ZOOMS).groupBy("label", "z", "x", "y").agg(F.count(F.lit(1)).alias("edges"))
    return _tiles(spark, sf_dir).join(own, ["label", "z", "x", "y"], "left").withColumn("edges", F.coalesce("edges", F.lit(0)))


@query("""SELECT doc_id, CAST('0x' || substr(sha256(text), 1, 8) AS BIGINT) AS first, CAST('0x' || substr(sha256(text), 57, 8) AS BIGINT) AS last FROM documents""")
def big_endian_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    digest = F.unhex(F.sha2("text", 256))
    return table(spark, sf_dir, "documents").select("doc_id", png.uint32(digest, F.lit(0)).alias("first"), png.uint32(digest, F.lit(28)).alias("last"))

