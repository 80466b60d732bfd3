import json

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import png, tiles, web
from tessera.operators import pyramid, rendering, topology
from tessera.sources import geojson, gpkg
from tests.test_geometry import box, shapes


def zones(spark):
    """Two neighbouring zones around z 8, tile (126, 97)."""
    span = tiles.WORLD / 2**8
    left, top = -tiles.HALF_WORLD + 126 * span, tiles.HALF_WORLD - 97 * span
    west, east = box(left + 0.25 * span, top - 0.75 * span, left + 0.75 * span, top - 0.25 * span), box(left + 0.75 * span, top - 0.75 * span, left + 1.5 * span, top - 0.25 * span)
    return topology.dissolve(topology.edges(shapes(spark, [(53, [[west]]), (54, [[east]])]), "zone", "geometry"), "zone")


def test_rendered_pyramid(spark):
    outline = zones(spark)
    edge_tiles = pyramid.enumerate_tiles(outline, "zone", (8, 9))
    covered = pyramid.fill_rows(outline, edge_tiles, "zone").select("z", "x", "y").distinct()
    out = rendering.render(outline, covered, "zone").cache()
    rows = {(r["z"], r["x"], r["y"]): r for r in out.collect()}
    assert {k for k in rows if k[0] == 8} == {(8, 126, 97), (8, 127, 97)}
    pixels = png.decode(rows[8, 126, 97]["content"])
    assert set(np.unique(pixels)) == {0, 1, 2, 8, 9, 15} == set(rows[8, 126, 97]["indices"])
    assert (pixels[70:186, 70:186] % 7 == 1).mean() > 0.95 and (pixels[:60] == 0).all()
    digest = {r["z"]: r for r in rendering.inventory_digest(out).collect()}
    assert digest[8]["tiles"] == 2 and digest[8]["bytes"] == sum(r["bytes"] for k, r in rows.items() if k[0] == 8)
    assert {r["z"]: r["missing"] for r in rendering.missing_indices(out).collect()}[8] == [3, 4, 5, 6, 7, 10, 11, 12, 13, 14]
    state = spark.createDataFrame([([[164, 204, 135], [255, 151, 0]] + [[128, 128, 128]] * 5, "forecast_hatch", "tag")], "colors array<array<int>>, style string, cache_tag string")
    painted = rendering.recoloured(out, state).where("z = 8 and x = 126").collect()[0]["content"]
    assert png.check(painted)[b"PLTE"][3:9] == bytes([164, 204, 135, 255, 151, 0]) and (png.decode(painted) == pixels).all()
    asked = spark.createDataFrame([(8, 126, 97), (8, 1, 1)], "z int, x long, y long")
    got = {r["x"]: r for r in rendering.with_default(asked, out, F.lit(b"none")).collect()}
    assert got[126]["covered"] and not got[1]["covered"] and bytes(got[1]["content"]) == b"none"
    assert rendering.render(outline, covered.where("false"), "zone").collect() == []


def test_geojson_and_geopackage(spark, tmp_path):
    hole = [(0.2, 0.2), (0.2, 0.4), (0.4, 0.4), (0.4, 0.2), (0.2, 0.2)]
    rows = shapes(spark, [(54, [[box(-0.0000000001, 0, 1.23456789012, 1), hole]]), (53, [[box(2, 0, 3, 1)]])])
    held = rows.select("zone", geojson.feature(F.col("zone"), F.col("geometry"), F.lit('{"code":"1N"}')).alias("f"))
    document = json.loads(geojson.collection(held, "zone", "f"))
    assert [f["id"] for f in document["features"]] == [53, 54] and "crs" not in document and document["bbox"] == [0.0, 0.0, 3.0, 1.0]
    assert document["features"][1]["geometry"]["coordinates"][0][0][1] == [1.23456789, 0.0]
    assert geojson.violations(rows, "zone", "geometry").count() == 0
    bad = shapes(spark, [(1, [[box(0, 0, 1, 1)[::-1]]]), (2, [[box(0, 0, 200, 1)]]), (3, [[box(0, 0, 1, 1)[:-1]]]), (4, [[box(0, 0, 1, 1), hole[::-1]]])])
    assert {r["zone"]: r["problem"] for r in geojson.violations(bad, "zone", "geometry").collect()} == {1: "shell_clockwise", 2: "range", 3: "open_ring", 4: "hole_counter_clockwise"}
    for name in ("a", "b"):
        gpkg.write_layer([([[box(0.0, 0.0, 1.0, 1.0)]], 53, "1N")], str(tmp_path / name), "zones", 25830, [("zone_id", "INTEGER"), ("code", "TEXT")], "2026-07-18T00:00:00Z")
    assert (tmp_path / "a").read_bytes() == (tmp_path / "b").read_bytes()
    assert gpkg.inspect(str(tmp_path / "a"), "zones", 25830, ("geom", "zone_id")) == []
    spark.dataSource.register(gpkg.GeoPackageSource)
    assert spark.read.format("gpkg").option("path", str(tmp_path / "a")).option("table", "zones").option("columns", "zone_id,code").load().collect() == [(53, "1N")]


def test_web_columns(spark):
    rows = spark.createDataFrame([("Application/JSON; charset=utf-8", '{"a":1,"b":2}', "https://h.org/x", "a b/ñ"), ("text/html", '{"a":1}', "https://u:p@h.org/", "x"), (None, "[]", "ftp://h.org", "y")], "t string, j string, u string, q string")
    got = rows.select(web.content_type_allowed(F.col("t"), ["application/json"]), web.exact_keys(F.col("j"), ["b", "a"]), web.valid_web_url(F.col("u"), True), web.quoted(F.col("q"))).collect()
    assert [tuple(r) for r in got] == [(True, True, True, "a%20b%2F%C3%B1"), (False, False, False, "x"), (False, False, False, "y")]
    heads = spark.createDataFrame([([("ETag", "1"), ("X", "no"), ("etag", "2")],)], "h array<struct<name:string,value:string>>")
    assert heads.select(web.selected_headers(F.col("h"), ["etag", "content-type"])).collect()[0][0] == {"etag": "1, 2"}
    pair = spark.createDataFrame([((200, "image/png", "max-age=3600", "x"), (200, "image/png", None, "y"))], "o struct<status:int,content_type:string,cache_control:string,sha256:string>, e struct<status:int,content_type:string,cache_control:string,sha256:string>")
    assert pair.select(web.response_violations(F.col("o"), F.col("e"))).collect()[0][0] == ["sha256"]


def test_fixture_holds_the_contract():
    tile = png.encode(png.fixture(), bytes(3 * png.COLOURS))
    assert (png.decode(tile) == png.fixture()).all() and set(np.unique(png.fixture())) == {0, 1, 2, 8, 9, 15}


def test_tiles_are_exported_as_files(spark, tmp_path):
    import hashlib

    rows = [(6, x, y, bytes([x, y]) * 9) for x in range(3) for y in range(4)]
    tiles = spark.createDataFrame(rows, "z int, x long, y long, content binary").repartition(3)
    for _ in range(2):
        written = rendering.export(tiles, str(tmp_path)).collect()
    assert sorted(tuple(r) for r in written) == [(z, x, y, hashlib.sha256(c).hexdigest(), 18) for z, x, y, c in rows]
    assert sorted(str(p.relative_to(tmp_path)) for p in tmp_path.rglob("*.*")) == sorted(f"{z}/{x}/{y}.png" for z, x, y, _ in rows)
    summary = rendering.published_inventory(spark.createDataFrame(written)).collect()[0]
    lines = "".join(f"{hashlib.sha256(c).hexdigest()}  {z}/{x}/{y}.png\n" for z, x, y, c in rows)
    assert summary["tiles"] == 12 and summary["bytes"] == 12 * 18 and summary["sha256"] == hashlib.sha256(lines.encode()).hexdigest()
