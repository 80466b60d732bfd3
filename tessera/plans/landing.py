"""Queries of sources and sinks: tables are written in a form that a source has, and read back through it."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import crs, png
from ..functions import geometry as g
from ..operators import gates, rendering, topology
from ..operators import state as st
from ..sources import files, geojson, gpkg, http, sinks
from ..streaming import publish
from .base import query, scratch, table
from .contracts import SNAPSHOTS, _states
from .registry import POINTS, _points
from .shapes import _rings


@query("SELECT CAST(row_number() OVER (ORDER BY n_nationkey) - 1 AS INTEGER) AS index, CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation")
def json_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations as one JSON array, read with strict types."""
    path = scratch(spark, "json")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name", "n_comment"))), lambda r: F.to_json(r))
    nation = table(spark, sf_dir, "nation").withColumn("n_comment", F.lit("not read"))
    nation.agg(F.concat(F.lit("[\n"), F.array_join(rows, ",\n"), F.lit("\n]")).alias("value")).write.text(path)
    return files.json_array(spark, path, {"n_nationkey": "int", "n_name": "string"}).drop("doc")


@query("SELECT lpad(CAST(c_custkey AS VARCHAR), 8, '0') AS code, c_name || ', \"' || c_mktsegment || '\"' AS name, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE CAST(c_nationkey AS VARCHAR) END AS zone FROM customer")
def csv_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as a control table of text columns: zeros in front stay, quotes and commas too, nulls are empty."""
    path, zone = scratch(spark, "csv"), F.when(F.col("c_custkey") % 4 != 0, F.col("c_nationkey").cast("string"))
    rows = table(spark, sf_dir, "customer").select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("code"), F.concat("c_name", F.lit(', "'), "c_mktsegment", F.lit('"')).alias("name"), zone.alias("zone"))
    sinks.write_csv(rows, ["code", "name", "zone"], ["code"], path)
    return files.control_table(spark, path, ["code", "name", "zone"])


@query("SELECT 'docs/' || doc_id || '.txt' AS path, sha256(text) AS sha256 FROM documents")
def inventory_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, docs = scratch(spark, "inventory"), table(spark, sf_dir, "documents")
    docs.select(F.concat(F.sha2("text", 256), F.lit("  docs/"), F.col("doc_id").cast("string"), F.lit(".txt"))).write.text(path)
    return files.inventory(spark, path, lines=docs.count())


@query("SELECT CAST(n_regionkey AS BIGINT) AS region, CAST(sum(strlen(n_name) + 1) AS BIGINT) AS bytes FROM nation GROUP BY 1")
def folder_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of nations as text files in a folder for each region, listed recursively."""
    path = scratch(spark, "folder")
    table(spark, sf_dir, "nation").select("n_name", F.col("n_regionkey").alias("region")).write.partitionBy("region").text(path)
    listed = files.binaries(spark, path, content=False).where(F.col("path").endswith(".txt"))
    return listed.groupBy(F.regexp_extract("path", r"region=(\d+)/", 1).cast("long").alias("region")).agg(F.sum("length").alias("bytes"))


@query("""SELECT n_nationkey AS k, CASE n_nationkey % 5 WHEN 1 THEN 'members' WHEN 2 THEN 'path' WHEN 3 THEN 'too_large' ELSE 'not_a_zip' END AS problem FROM nation WHERE n_nationkey % 5 <> 0""")
def zip_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packages with a planted fault for four of five nations: the first problem of their members."""

    @F.pandas_udf("binary")
    def pack(keys: pd.Series) -> pd.Series:
        kinds = {0: [("a.json", b"{}"), ("b.png", b"x")], 1: [("b.png", b"x"), ("a.json", b"{}")], 2: [("../a.json", b"{}"), ("b.png", b"x")], 3: [("a.json", b"{}" * 5000), ("b.png", b"x")]}
        return keys.map(lambda k: sinks.zip_bytes(kinds[k % 5]) if k % 5 in kinds else b"PK nothing")

    packed = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), pack("n_nationkey").alias("content"))
    spark.udtf.register("zip_members", files.zip_members())
    packed.createOrReplaceTempView("tessera_packages")
    members = spark.sql("SELECT k, m.* FROM tessera_packages, LATERAL zip_members(content, 1000) m")
    return files.member_problems(members, "k", ["a.json", "b.png"])


@query("""SELECT CAST(53 + r_regionkey AS BIGINT) AS zone_id, r_name AS zone_code, 100.0 * (r_regionkey + 1) * 100 AS area, 1 AS parts, 0 AS holes FROM region""")
def gpkg_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as zones in a GeoPackage, checked, read in order of code with their geometry decoded. The file is local, as SQLite is."""
    folder = scratch(spark, "gpkg").removeprefix("file://")
    os.makedirs(folder)
    rows = table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").collect()

    def shape(k: int) -> list:
        x, w = k * 1000.0, 100.0 * (k + 1)
        return [[[(x, 0.0), (x + w, 0.0), (x + w, 100.0), (x, 100.0), (x, 0.0)]]]

    path = f"{folder}/zones.gpkg"
    gpkg.write_layer([(shape(r[0]), 53 + r[0], r[1]) for r in rows], path, "zones", 25830, [("zone_id", "INTEGER"), ("zone_code", "TEXT")], "2024-01-01T00:00:00.000Z")
    found = gpkg.record(path, "zones", 25830, ("zone_id", "zone_code"))
    if found["problems"]:
        raise ValueError(found["problems"])
    names = gpkg.attributes(spark, path, "zones", ["zone_id", "zone_code"], "zone_id", len(rows))
    held = spark.read.format("gpkg").option("path", path).option("table", "zones").option("columns", "zone_id,geom").load().withColumn("shape", g.from_blob(F.col("geom"), 25830))
    own = held.select("zone_id", g.signed_area(F.col("shape")[0][0]).alias("area"), g.part_count(F.col("shape")).alias("parts"), g.hole_count(F.col("shape")).alias("holes"))
    return names.join(own, "zone_id")


@query("""WITH d AS (SELECT source, sha256(text) AS sha256, max(strlen(text)) AS size, min(doc_id) AS first, bool_or(doc_id % 3 = 0) AS early FROM documents WHERE text IS NOT NULL GROUP BY 1, 2) SELECT source, sha256, CAST(size AS BIGINT) AS size, NOT early AS new FROM d""")
def snapshot_promotion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' contents promoted twice, a third of the documents first: which contents were new to the second run. What was written holds its digests."""
    root = scratch(spark, "snapshots")
    docs = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "source", F.col("text").cast("binary").alias("content"))
    sinks.promote(docs.where("doc_id % 3 = 0").drop("doc_id"), root)
    report = sinks.promote(docs.drop("doc_id"), root)
    if not sinks.departed(root, spark).isEmpty():
        raise ValueError("a snapshot has departed from its digest")
    return report


@query("""SELECT page_id AS path, CASE WHEN page_id % 8 = 0 THEN 'missing' WHEN page_id % 8 = 1 THEN 'extra' ELSE 'changed' END AS problem FROM pages WHERE page_id % 8 < 2 OR page_id % 9 = 4
    UNION ALL SELECT -page_id - 1, CASE WHEN page_id % 8 = 0 THEN 'extra' ELSE 'missing' END FROM pages WHERE page_id % 8 < 2""")
def verified_copy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages against an inventory with planted departures; the good ones are copied and read back first, without any problem."""
    files_ = table(spark, sf_dir, "pages").select(F.col("page_id").alias("path"), F.col("html").cast("binary").alias("content"))
    listed = files_.select("path", F.sha2("content", 256).alias("sha256"))
    if not sinks.verified_copy(files_, listed, scratch(spark, "copy")).isEmpty():
        raise ValueError("the copy departs from its inventory")
    k = F.col("path")
    name = lambda rest: F.when(k % 8 == rest, -k - 1).otherwise(k).alias("path")
    own = files_.select(name(0), F.when((k % 9 == 4) & (k % 8 > 1), F.lit(b"x")).otherwise(F.col("content")).alias("content"))
    return sinks.verified_copy(own, listed.select(name(1), "sha256"), "", write=False)


@query("""SELECT sha256('n_nationkey,n_name,note' || chr(10) || string_agg(n_nationkey || ',' || n_name || ',' || CASE WHEN n_nationkey % 2 = 0 THEN '"a,""b""' || '"' ELSE '' END || chr(10), '' ORDER BY n_nationkey)) AS sha256 FROM nation""")
def csv_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.when(F.col("n_nationkey") % 2 == 0, 'a,"b"').alias("note"))
    data = sinks.csv_bytes(rows, ["n_nationkey", "n_name", "note"], ["n_nationkey"])
    return spark.createDataFrame([(bytearray(data),)], "data binary").select(F.sha2("data", 256).alias("sha256"))


@query("""WITH s AS (SELECT event_id, [[200, 500, 0, 404, 429][event_id % 5 + 1], [200, 503, 301][user_id % 3 + 1]] AS s FROM events), t AS (SELECT event_id, s, CASE WHEN s[1] IN (0, 408, 425, 429) OR s[1] BETWEEN 500 AND 599 THEN 2 ELSE 1 END AS used FROM s)
    SELECT event_id, CAST(used AS INTEGER) AS used, s[used] AS status, s[used] BETWEEN 200 AND 299 AS ok FROM t""")
def retry_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as sources that answer twice: how many attempts are made and what the last one says."""
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at + 1).cast("int"))
    answers = F.array(pick([200, 500, 0, 404, 429], F.col("event_id") % 5), pick([200, 503, 301], F.col("user_id") % 3))
    return table(spark, sf_dir, "events").select("event_id", http.attempts(answers).alias("a")).select("event_id", "a.*")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND value < 10 THEN 'low' WHEN event_type = 'click' AND user_id % 2 = 0 THEN 'even' WHEN event_type NOT IN ('view', 'click') THEN 'unknown_kind' END AS problem FROM events WHERE (event_type = 'view' AND value < 10) OR (event_type = 'click' AND user_id % 2 = 0) OR event_type NOT IN ('view', 'click')""")
def rules_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events under the rules of their kind, after a stage without problems has passed."""
    rows = table(spark, sf_dir, "events")
    gates.run([("ids", lambda: rows.where("event_id is null")), ("times", lambda: rows.where("ts is null"))])
    rules = {"view": [(F.col("value") >= 10, "low")], "click": [(F.col("user_id") % 2 == 1, "even")]}
    return gates.by_kind(rows, "event_type", rules).where("problem is not null").select("event_id", "problem")


@query("""WITH c AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'nowhere' WHEN c_custkey % 7 = 1 THEN 'other' END AS p, c_nationkey AS k FROM customer)
    SELECT id, CASE WHEN p = 'nowhere' THEN 'unknown_place' WHEN p = 'other' THEN 'other_zone' ELSE 'no_border' END AS problem FROM c JOIN nation n ON k = n.n_nationkey LEFT JOIN (SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS i, count(*) OVER (PARTITION BY n_regionkey) AS of FROM nation) r ON r.n_nationkey = k WHERE p IS NOT NULL OR (id % 7 >= 4 AND i < of AND k % 4 = 3)""")
def control_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as control points in one nation or, for some, in two that follow each other in a region; every fourth pair shares next to no border."""
    nation = table(spark, sf_dir, "nation")
    from pyspark.sql.window import Window

    order = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    chain = nation.select("n_nationkey", "n_name", "n_regionkey", F.lead("n_nationkey").over(order).alias("_next"), F.lead("n_name").over(order).alias("_name"))
    walk = nation.select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("zone"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0").alias("code"))
    two = lambda c: F.lpad(F.col(c).cast("string"), 2, "0")
    borders = chain.where("_next is not null").select(two("n_nationkey").alias("left"), two("_next").alias("right"), F.when(F.col("n_nationkey") % 4 == 3, 0.5).otherwise(2.0).alias("length"))
    k = F.col("c_custkey") % 7
    points = table(spark, sf_dir, "customer").join(chain, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").alias("id"), F.when(k == 1, F.col("n_regionkey") + 9).otherwise(F.col("n_regionkey")).alias("zone"),
        F.when(k == 0, F.array(F.lit("nowhere"))).when((k >= 4) & F.col("_name").isNotNull(), F.array("n_name", "_name")).otherwise(F.array("n_name")).alias("places"),
    )
    return gates.controls(points, walk, borders, 1.0)


@query("""SELECT s_nationkey AS zone, CAST(sum((1.0 + s_suppkey % 7) * (1.0 + s_suppkey % 7) * ((CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END) - CASE WHEN s_suppkey % 2 = 0 THEN 0.0625 ELSE 0 END)) AS DOUBLE) AS area, min(10.0 * s_suppkey) AS min_x, 1.0 AS min_y,
    max(10.0 * s_suppkey + 1.0 + s_suppkey % 7 + CASE WHEN s_suppkey % 3 = 0 THEN 100 ELSE 0 END) AS max_x, max(2.0 + s_suppkey % 7) AS max_y, CAST(sum(CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END) AS BIGINT) AS parts, CAST(sum(CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS BIGINT) AS holes, count(*) AS municipalities FROM supplier GROUP BY 1""")
def zone_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of zones from the shapes of their places."""
    shapes = _rings(spark, sf_dir).join(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_nationkey").alias("zone")), "key")
    return topology.zone_records(shapes.select("zone", g.canonical(F.col("shape")).alias("shape")), "zone", "shape")


@query(f"WITH {POINTS} SELECT vec_id, CAST(round(700000 + px / 10) AS BIGINT) AS x, CAST(round(py / 10 + 4000000) AS BIGINT) AS y FROM points")
def crs_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of zone 30 to degrees and back: the same to well under a millimetre, or the query fails."""
    points = _points(spark, sf_dir).select("vec_id", (700000 + F.col("px") / 10).alias("x"), (F.col("py") / 10 + 4000000).alias("y"))
    rows = points.withColumn("d", crs.to_degrees(F.col("x"), F.col("y")))
    rows = rows.withColumn("b", crs.to_projected(F.col("d.lon"), F.col("d.lat")))
    off = F.hypot(F.col("b.x") - F.col("x"), F.col("b.y") - F.col("y"))
    return rows.select("vec_id", F.when(off < 1e-4, F.round("x").cast("long")).alias("x"), F.when(off < 1e-4, F.round("y").cast("long")).alias("y"))


KRUEGER = """c AS (SELECT f / (2 - f) AS n, sqrt(f * (2 - f)) AS e FROM (SELECT 1 / 298.257222101 AS f)), k AS (SELECT n, e, 0.9996 * 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS r, n / 2 - 2 * n ** 2 / 3 + 5 * n ** 3 / 16 + 41 * n ** 4 / 180 AS a1,
    13 * n ** 2 / 48 - 3 * n ** 3 / 5 + 557 * n ** 4 / 1440 AS a2, 61 * n ** 3 / 240 - 103 * n ** 4 / 140 AS a3 FROM c)"""


@query(f"""WITH {POINTS}, {KRUEGER}, d AS (SELECT vec_id, -1.0 + px / 1e6 AS lon, 39.5 + (py - 4800000.0) / 1e6 AS lat FROM points), t AS (SELECT vec_id, lon, lat, radians(lon + 3) AS lam, sinh(atanh(sin(radians(lat))) - e * atanh(e * sin(radians(lat)))) AS t FROM d, k),
    u AS (SELECT *, atan2(t, cos(lam)) AS xi, asinh(sin(lam) / sqrt(t * t + cos(lam) * cos(lam))) AS eta FROM t)
    SELECT vec_id, CAST(floor((500000 + r * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta))) / 10) AS BIGINT) AS x,
        CAST(floor(r * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) / 10) AS BIGINT) AS y,
        CAST(floor(6378137.0 * radians(lon) / 10) AS BIGINT) AS mercator_x, CAST(floor(6378137.0 * atanh(sin(radians(lat))) / 10) AS BIGINT) AS mercator_y FROM u, k""")
def projected_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points in degrees to zone 30 and to Mercator, in tens of metres; SQL has the series to the third term."""
    rows = _points(spark, sf_dir).select("vec_id", (F.lit(-1.0) + F.col("px") / 1e6).alias("lon"), (F.lit(39.5) + (F.col("py") - 4800000.0) / 1e6).alias("lat"))
    at, flat = crs.to_projected(F.col("lon"), F.col("lat")), crs.to_mercator(F.col("lon"), F.col("lat"))
    tens = lambda v, name: F.floor(v / 10).cast("long").alias(name)
    return rows.select("vec_id", tens(at["x"], "x"), tens(at["y"], "y"), tens(flat["x"], "mercator_x"), tens(flat["y"], "mercator_y"))


@query("""WITH n AS (SELECT n_nationkey AS k, n_name, n_nationkey * 0.25 - 3 AS x, CAST(n_nationkey * 0.25 - 3 AS DOUBLE) AS a, CAST(n_nationkey * 0.25 - 1.5 AS DOUBLE) AS b FROM nation)
    SELECT k, '{"type":"Feature","id":' || k || ',"bbox":[' || a || ',40.5,' || b || ',41.125],"geometry":{"type":"MultiPolygon","coordinates":[[[[' || a || ',40.5],[' || b || ',40.5],[' || b || ',41.125],[' || a || ',40.5]]]]},"properties":{"name":"' || n_name || '"}}' AS feature FROM n""")
def geojson_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("n_nationkey").cast("double") * 0.25 - 3
    point = lambda a, b: F.struct(a.alias("x"), F.lit(b).alias("y"))
    ring = F.array(point(x, 40.5), point(x + 1.5, 40.5), point(x + 1.5, 41.125), point(x, 40.5))
    feature = geojson.feature(F.col("n_nationkey"), F.array(F.array(ring)), F.to_json(F.struct(F.col("n_name").alias("name"))))
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), feature.alias("feature"))


@query("""SELECT s_suppkey AS key, 9 + 9 * CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END + 84 * (CASE WHEN s_suppkey % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN s_suppkey % 2 = 0 THEN 1 ELSE 0 END) AS bytes, true AS same FROM supplier""")
def wkb_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical shapes as WKB, and decoded from a GeoPackage blob with it."""
    rows = _rings(spark, sf_dir).select("key", g.canonical(F.col("shape")).alias("shape"))
    rows = rows.withColumn("wkb", g.to_wkb(F.col("shape")))
    head = F.unhex(F.lit("47500001" + (25830).to_bytes(4, "little").hex()))
    return rows.select("key", F.octet_length("wkb").alias("bytes"), (g.from_blob(F.concat(head, F.col("wkb")), 25830) == F.col("shape")).alias("same"))


@query("""SELECT n_nationkey AS tile, CASE n_nationkey % 5 WHEN 0 THEN 'ok' ELSE 'broken' END AS verdict FROM nation""")
def png_contract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, whole or with a planted fault: a flipped bit, bytes behind the end, a cut, chunks in another order."""

    @F.pandas_udf("string")
    def judge(keys: pd.Series) -> pd.Series:
        def one(k: int) -> str:
            data = bytearray(png.encode(np.full((png.SIDE, png.SIDE), k % 16, np.uint8), bytes(3 * png.COLOURS)))
            if k % 5 == 1:
                data[60] ^= 1
            elif k % 5 == 2:
                data += b"x"
            elif k % 5 == 3:
                del data[-12:]
            elif k % 5 == 4:
                own = {kind: png.chunk(kind, body) for kind, body, _, _ in png.chunks(bytes(data))}
                data = png.SIGNATURE + b"".join(own[x] for x in (b"IHDR", b"tRNS", b"PLTE", b"IDAT", b"IEND"))
            try:
                png.check(bytes(data))
            except png.PngError:
                return "broken"
            return "ok"

        return keys.map(one)

    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), judge("n_nationkey").alias("verdict"))


def _hex(shift: int) -> str:
    return f"string_agg(['A4CC87', 'FF9700', 'E83D35'][((c_custkey + i + {shift}) % 9) // 3 + 1], ' ' ORDER BY i)"


@query(f"""WITH {SNAPSHOTS}, c AS (SELECT c_custkey, {_hex(0)} AS now_colours, {_hex(4)} AS next_colours FROM customer CROSS JOIN range(7) r(i) GROUP BY c_custkey), j AS (SELECT c_custkey AS key, d, snapshot, d <> '2024-05-09' AS old, c_custkey % 12 = 1 AS first, now_colours, next_colours FROM ids JOIN c USING (c_custkey) WHERE c_custkey % 12 < 3)
    SELECT key, 'current' AS period, snapshot || ':current:' || CASE WHEN old THEN 'stale-2024-05-09' ELSE 'current' END AS cache_tag, old AS stale, d AS valid_date, 'solid' AS style, now_colours AS colours FROM j
    UNION ALL SELECT key, 'forecast_next_day', CASE WHEN first THEN 'unavailable:forecast_next_day:2024-05-09' ELSE snapshot || ':forecast_next_day:' || CASE WHEN old THEN 'stale-2024-05-09' ELSE 'current' END END, first OR old, CASE WHEN first THEN '2024-05-10' ELSE strftime(CAST(d AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') END, 'forecast_hatch',
        CASE WHEN first THEN array_to_string(list_transform(range(7), lambda i: '808080'), ' ') ELSE next_colours END FROM j""")
def tile_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tag, staleness, date, style and all seven colours of valid states for both periods; a first version has no forecast."""
    rows = st.violations(_states(spark, sf_dir)).where("code is null")
    now = F.lit("2024-05-08 23:30:00").cast("timestamp")
    out = None
    for period in ("current", "forecast_next_day"):
        own = st.tile_states(rows, now, F.lit(period)).withColumn("period", F.lit(period))
        out = own if out is None else out.unionByName(own)
    colours = F.array_join(F.transform("colors", lambda c: F.format_string("%02X%02X%02X", c[0], c[1], c[2])), " ")
    return out.select("key", "period", "cache_tag", "stale", "valid_date", "style", colours.alias("colours"))


@query("""SELECT user_id AS key, event_id AS seq, event_type AS snapshot, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) = event_type THEN 'unchanged' ELSE 'published' END AS outcome FROM events""")
def streamed_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as candidates that land in one file, published by a stateful stream that takes all there is and stops."""
    landed, target = scratch(spark, "landed"), scratch(spark, "outcomes")
    table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), F.col("event_type").alias("snapshot")).write.parquet(landed)
    name, wanted = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    before = spark.conf.get(name)
    spark.conf.set(name, wanted)
    try:
        publish.run_available(spark.readStream.schema("key long, seq long, snapshot string").parquet(landed), scratch(spark, "checkpoint"), target)
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(target)


@query("""SELECT n_nationkey AS tile, CAST(0 AS BIGINT) AS differing, true AS painted FROM nation""")
def tile_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single tiles against the crops of a window of two by two that is rendered at once: pixels that differ."""

    @F.pandas_udf("array<long>")
    def compare(keys: pd.Series) -> pd.Series:
        def one(k: int) -> list[int]:
            x, y, z, w = 120 + k, 90 + k, 8, 156543.03392804097
            a, b = -20037508.342789244 + (x + 0.3) * w, 20037508.342789244 - (y + 0.4) * w
            ring = [(a, b), (a + w, b - 0.9 * w), (a + 1.2 * w, b - 0.2 * w)]
            edges = np.array([[*ring[i], *ring[(i + 1) % 3]] for i in range(3)])
            whole = png.render(edges, np.full(3, k % 7 + 1), z, x, y, 2, 2)
            off = sum(int((png.crop(whole, i, j) != png.render(edges, np.full(3, k % 7 + 1), z, x + i, y + j)).sum()) for i in range(2) for j in range(2))
            return [off, int((whole == 15).any() and (whole == k % 7 + 1).any())]

        return keys.map(one)

    rows = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tile"), compare("n_nationkey").alias("v"))
    return rows.select("tile", F.col("v")[0].alias("differing"), (F.col("v")[1] == 1).alias("painted"))


@query(f"""WITH r AS (SELECT event_id, 6 + event_id % 3 AS z, user_id % 11 AS x, event_id % 5 AS y FROM events) SELECT event_id, x % 2 = 0 AS covered, CASE WHEN x % 2 = 0 THEN z || '/' || x || '/' || y ELSE 'transparent' END AS content FROM r""")
def tile_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tile requests: the tile where there is one, else the shared transparent one."""
    rows = table(spark, sf_dir, "events").select("event_id", (6 + F.col("event_id") % 3).alias("z"), (F.col("user_id") % 11).alias("x"), (F.col("event_id") % 5).alias("y"))
    tiles = rows.select("z", "x", "y").distinct().where("x % 2 = 0").withColumn("content", F.concat_ws("/", "z", "x", "y"))
    return rendering.with_default(rows, tiles, F.lit("transparent")).select("event_id", "covered", "content")

