import math
import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import crs, geometry, png, tiles
from tessera.operators import pyramid, topology
from tessera.sources.gpkg import GeoPackageSource, inspect


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0)]


def shapes(spark, rows):
    data = [(k, [[[{"x": float(x), "y": float(y)} for x, y in ring] for ring in part] for part in parts]) for k, parts in rows]
    from pyspark.sql import types as T

    return spark.createDataFrame(data, T.StructType([T.StructField("zone", T.LongType()), T.StructField("geometry", geometry.MULTIPOLYGON)]))


def blob(parts, srs=25830, flags=1):
    return b"GP\0" + bytes([flags]) + struct.pack("<i", srs) + geometry.encode_wkb(parts)


def test_dissolve_borders_and_coverage(spark):
    rows = shapes(spark, [(1, [[box(0, 0, 1, 1)]]), (1, [[box(1, 0, 2, 1)]]), (2, [[box(0, 1, 1, 2)]])])
    edges = topology.edges(rows, "zone", "geometry")
    outline = topology.dissolve(edges, "zone")
    got = {r["zone"]: (r["area"], r["perimeter"], r["edges"]) for r in topology.measures(outline, "zone").collect()}
    assert got == {1: (2.0, 6.0, 6), 2: (1.0, 4.0, 4)}
    assert [tuple(r) for r in topology.borders(outline, "zone").collect()] == [(1, 2, 1.0)]
    assert all(r["passes"] for r in topology.coverage(edges, outline, "zone", 1e-6, 1e-9).collect())
    overlap = topology.edges(shapes(spark, [(1, [[box(0, 0, 1, 1)]]), (1, [[box(0, 0, 1, 1)]])]), "zone", "geometry")
    assert not topology.coverage(overlap, topology.dissolve(overlap, "zone"), "zone", 1e-6, 1e-9).collect()[0]["passes"]


def test_canonical_form(spark):
    hole = [(2, 2), (4, 2), (4, 4), (2, 4), (2, 2)]
    a = shapes(spark, [(1, [[box(0, 0, 10, 10), hole], [box(20, 0, 21, 1)]])])
    turned = shapes(spark, [(1, [[box(20, 0, 21, 1)[::-1]], [[(10, 10), (10, 10), (0, 10), (0, 0), (10, 0), (10, 10)], hole[::-1]]])])
    one, two = (d.select(geometry.canonical(F.col("geometry")).alias("g")).collect()[0]["g"] for d in (a, turned))
    assert one == two
    row = a.select(geometry.part_count(F.col("geometry")).alias("p"), geometry.hole_count(F.col("geometry")).alias("h"), geometry.bbox(F.col("geometry")).alias("b")).collect()[0]
    assert (row["p"], row["h"], tuple(row["b"])) == (2, 1, (0.0, 0.0, 21.0, 10.0))
    assert geometry.decode_wkb(a.select(geometry.to_wkb(F.col("geometry"))).collect()[0][0])[1] == [box(20.0, 0.0, 21.0, 1.0)]


@pytest.mark.parametrize("bad", [b"", b"XX\0\1" + bytes(40), blob([[[(0, 0), (1, 0), (1, 1), (0, 0)]]], srs=4326), blob([[[(0, 0), (1, 0), (1, 1), (0, 0)]]], flags=0x11), blob([[[(0, 0), (1, 0), (1, 1), (0, 0)]]])[:-3], blob([])])
def test_malformed_blobs(bad):
    with pytest.raises(geometry.GeometryError):
        geometry.decode_blob(bad, 25830)


def test_geopackage_source(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    with sqlite3.connect(path) as db:
        db.executescript("""PRAGMA application_id = 1196444487; CREATE TABLE gpkg_spatial_ref_sys (srs_id INTEGER); CREATE TABLE gpkg_contents (table_name TEXT, data_type TEXT, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT, geometry_type_name TEXT, srs_id INTEGER); CREATE TABLE mun (fid INTEGER PRIMARY KEY, geom MULTIPOLYGON, cod TEXT, area DOUBLE);
            INSERT INTO gpkg_spatial_ref_sys VALUES (25830); INSERT INTO gpkg_contents VALUES ('mun', 'features', 25830); INSERT INTO gpkg_geometry_columns VALUES ('mun', 'MULTIPOLYGON', 25830);""")
        db.executemany("INSERT INTO mun (geom, cod, area) VALUES (?, ?, ?)", [(blob([[box(i, 0, i + 1, 1)]]), f"{i:05d}", i / 2) for i in range(20)])
    assert inspect(path, "mun", 25830, ("geom", "cod")) == [] and inspect(path, "mun", 25830, ("none",)) == ["column:none"]
    assert "contents" in inspect(path, "mun", 4326, ())
    spark.dataSource.register(GeoPackageSource)
    held = spark.read.format("gpkg").option("path", path).option("table", "mun").option("columns", "cod,geom,area").option("partitions", "3").load()
    assert held.dtypes == [("cod", "string"), ("geom", "binary"), ("area", "double")] and held.rdd.getNumPartitions() == 3
    rows = held.withColumn("g", geometry.from_blob(F.col("geom"), 25830)).orderBy("cod").collect()
    assert [r["cod"] for r in rows] == [f"{i:05d}" for i in range(20)] and rows[3]["g"][0][0][1] == (4.0, 0.0)


def test_projection_round_trip(spark):
    rows = spark.createDataFrame([(-0.5, 39.0), (-3.0, 40.0), (0.5, 38.2), (-6.0, 43.5)], "lon double, lat double")
    there = rows.select("*", crs.to_projected(F.col("lon"), F.col("lat")).alias("p")).select("*", crs.to_degrees(F.col("p.x"), F.col("p.y")).alias("d")).collect()
    for r in there:
        assert math.isclose(r["d"]["lon"], r["lon"], abs_tol=1e-9) and math.isclose(r["d"]["lat"], r["lat"], abs_tol=1e-9)
    # on the central meridian: 500 km east, and the scaled meridian arc (published value for 40 degrees, 4429529.03 m on GRS80)
    assert math.isclose(there[1]["p"]["x"], 500000.0, abs_tol=1e-6) and math.isclose(there[1]["p"]["y"], 4429529.0302 * 0.9996, abs_tol=0.01)


def test_tiles_of_a_box(spark):
    span = tiles.WORLD / 2**8
    left, top = -tiles.HALF_WORLD + 126 * span, tiles.HALF_WORLD - 97 * span
    inset = shapes(spark, [(1, [[box(left + 0.2 * span, top - 0.8 * span, left + 0.8 * span, top - 0.2 * span)]]), (2, [[box(left + 0.2 * span, top - 0.8 * span, left + 1.2 * span, top - 0.2 * span)]])])
    edges = topology.edges(inset, "zone", "geometry")
    got = {(r["zone"], r["x"], r["y"]) for r in pyramid.enumerate_tiles(edges, "zone", (8,)).collect()}
    assert got == {(1, 126, 97), (2, 126, 97), (2, 127, 97)}
    deep = pyramid.enumerate_tiles(edges, "zone", (11,))
    filled = pyramid.fill_rows(edges, deep, "zone")
    assert filled.where("zone = 1").count() == pyramid.candidates(spark.createDataFrame([(left + 0.2 * span, top - 0.8 * span, left + 0.8 * span, top - 0.2 * span)], "min_x double, min_y double, max_x double, max_y double"), (11,)).count()


def test_png_round_trip_and_recolour():
    rng = np.random.default_rng(1)
    indices = rng.integers(0, 16, (png.SIDE, png.SIDE)).astype(np.uint8)
    tile = png.encode(indices, bytes(range(48)))
    assert (png.decode(tile) == indices).all()
    colours = [[164, 204, 135], [255, 151, 0], [232, 61, 53]] + [[10, 20, 30]] * 4
    painted = png.recolour(tile, colours, True)
    own = png.check(painted)
    assert own[b"IDAT"] == png.check(tile)[b"IDAT"] and own[b"PLTE"][3:6] == bytes(colours[0]) and own[b"PLTE"][24:27] == bytes([90, 112, 74])
    assert len(painted) == len(tile) and sum(a != b for a, b in zip(tile, painted, strict=True)) <= 46
    with pytest.raises(png.PngError):
        png.check(tile + b"x")
    with pytest.raises(png.PngError):
        png.check(tile[:60] + bytes([tile[60] ^ 1]) + tile[61:])


def test_neighbouring_tiles_fit():
    span = tiles.WORLD / 2**8
    left, top = -tiles.HALF_WORLD + 126 * span, tiles.HALF_WORLD - 97 * span
    ring = box(left + 0.3 * span, top - 0.7 * span, left + 1.6 * span, top - 0.3 * span)
    edges = np.array([(*a, *b) for a, b in zip(ring, ring[1:])])
    a, b = (png.render(edges, np.full(4, 2), 8, x, 97) for x in (126, 127))
    assert set(np.unique(a)) == {0, 2, 9, 15} and (a[128, -1] in (2, 9)) and (b[128, 0] in (2, 9))
    rows = np.arange(90, 160)
    hatch = lambda x: (x * 256 + rows + 97 * 256) % 12 < 2
    assert ((b[rows, 0] == 9) == ((127 * 256 + rows + 97 * 256) % 12 < 2)).all()
