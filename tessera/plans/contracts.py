"""Queries of documents, states and requests: what holds to its contract, and which rule fails first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feed as f
from ..functions import web
from ..operators import cache, feed, state
from .base import query, table
from .registry import MADRID


def _key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc"))


@query("""SELECT * FROM (SELECT c_custkey AS doc, CASE c_custkey % 14 WHEN 0 THEN 'INVALID_REQUIRED_FIELD' WHEN 1 THEN 'INVALID_SOURCE_TIMESTAMP' WHEN 2 THEN 'INVALID_SOURCE_TIMESTAMP' WHEN 3 THEN 'INVALID_REQUIRED_FIELD' WHEN 4 THEN 'INVALID_REQUIRED_FIELD' WHEN 5 THEN 'INVALID_REQUIRED_FIELD'
        WHEN 6 THEN 'DUPLICATE_ZONE_ID' WHEN 7 THEN 'INVALID_ZONE_SET' WHEN 8 THEN 'INVALID_ZONE_SET' WHEN 9 THEN 'INVALID_REQUIRED_FIELD' WHEN 10 THEN 'DUPLICATE_ZONE_ID' END AS code,
        CASE c_custkey % 14 WHEN 0 THEN '$.time' WHEN 1 THEN '$.time' WHEN 2 THEN '$.time' WHEN 3 THEN '$.z1' WHEN 4 THEN '$.z1[2].nact' WHEN 5 THEN '$.z1[1].npre' WHEN 6 THEN '$.z1[4].id' WHEN 7 THEN '$.z1[5].id' WHEN 8 THEN '$.z1' WHEN 9 THEN '$.z1[3].id' WHEN 10 THEN '$.z1[6].id' END AS path FROM customer) WHERE code IS NOT NULL""")
def feed_document_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A feed document for each customer, three of fourteen kinds valid (one with integral 9.0 and unknown fields), the others with a
    planted fault: the first violation and its path."""
    k = F.col("doc") % 14
    time = F.when(k == 0, "20240501").when(k == 1, '"2024-02-30 10:00:00"').when(k == 2, '"2024-05-01 24:00:00"').otherwise('"2024-05-01 10:00:00.5"')

    def zone(i: Column) -> Column:
        own = F.when((k == 6) & (i == 4), 54).when((k == 7) & (i == 5), 60).when((k == 10) & (i == 6), 53).otherwise(i + 53).cast("string")
        # a repeated id is told before one that is no zone
        ident = F.when((k == 9) & (i == 3), "true").otherwise(own)
        nact = F.when((k == 4) & (i == 2), '"3"').when((k == 11) & (i == 2), "9.0").otherwise("3")
        npre = F.when((k == 5) & (i == 1), "").otherwise(',"npre":4')
        return F.concat(F.lit('{"id":'), ident, F.lit(',"nact":'), nact, npre, F.when(k == 12, ',"more":[1,{"id":5}]').otherwise(""), F.lit("}"))

    zones = F.array_join(F.transform(F.sequence(F.lit(0), F.when(k == 8, 5).otherwise(6)), zone), ",")
    z1 = F.when(k == 3, '{"id":53}').otherwise(F.concat(F.lit("["), zones, F.lit("]")))
    docs = _key(spark, sf_dir).withColumn("body", F.concat(F.lit('{"time":'), time, F.lit(',"other":null,"z1":'), z1, F.lit("}")))
    return feed.read_zones(docs)[1]


@query("""SELECT * FROM (SELECT c_custkey AS doc, CASE c_custkey % 9 WHEN 0 THEN 'INVALID_REQUIRED_FIELD' WHEN 1 THEN 'INVALID_REQUIRED_FIELD' WHEN 2 THEN 'DUPLICATE_SITUATION_ID' WHEN 3 THEN 'SITUATION_WRONG_ADVISORY' WHEN 4 THEN 'UNKNOWN_SITUATION_ID' WHEN 5 THEN 'SITUATION_INACTIVE' WHEN 6 THEN 'INVALID_SITUATION_CATALOG' END AS code,
        CASE c_custkey % 9 WHEN 0 THEN '$.SITUACION' WHEN 1 THEN '$.SITUACION[3]' WHEN 2 THEN '$.SITUACION[8]' WHEN 3 THEN '$.SITUACION[4]' WHEN 4 THEN '$.SITUACION[9]' WHEN 5 THEN '$.SITUACION[6]' WHEN 6 THEN '$.SITUACION' END AS path FROM customer) WHERE code IS NOT NULL""")
def catalogue_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A situation catalogue for each customer; rows of other advisories are skipped, and faults of every kind are planted."""
    k = F.col("doc") % 9

    def situation(i: Column) -> Column:
        ident = F.when((k == 2) & (i == 8), 1).when((k == 4) & (i == 9), 77).otherwise(i + 1)
        advisory = F.when((k == 3) & (i == 4), 2).when((i == 9) & (k != 4), 5).otherwise(3)
        active = F.when((k == 5) & (i == 6), '"N"').when((k == 1) & (i == 3), "1").otherwise('"S"')
        return F.concat(F.lit('{"ID_SITUACION":'), ident.cast("string"), F.lit(',"ID_AVISO":'), advisory.cast("string"), F.lit(',"ACTIVO":'), active, F.lit("}"))

    # nine of the advisory and one of another; kind 6 lacks the ninth
    places = F.filter(F.sequence(F.lit(0), F.lit(9)), lambda i: (k != 6) | (i != 8))
    body = F.concat(F.lit('{"SITUACION":'), F.when(k == 0, "5").otherwise(F.concat(F.lit("["), F.array_join(F.transform(places, situation), ","), F.lit("]"))), F.lit("}"))
    return feed.read_catalogue(_key(spark, sf_dir).withColumn("body", body))[1]


STAMPS = """CASE o_orderkey % 12 WHEN 0 THEN d || ' 24:00:00' WHEN 1 THEN d || ' 23:59:60' WHEN 2 THEN '0099' || substr(d, 5) || ' 10:00:00' WHEN 3 THEN d || ' 10:00:00.1234' WHEN 4 THEN d || ' 10:00:00.' WHEN 5 THEN d || 'T10:00:00' WHEN 6 THEN substr(d, 1, 8) || '31 10:00:00'
    WHEN 7 THEN substr(d, 1, 5) || '02-29 10:00:00' WHEN 8 THEN d || ' 10:00:00' || chr(10) WHEN 9 THEN d || ' 1:00:00' WHEN 10 THEN d || ' 10:00:00.12' ELSE d || ' 00:00:00' END"""


@query(f"""SELECT o_orderkey, s AS stamp, CASE o_orderkey % 12 WHEN 10 THEN true WHEN 11 THEN true WHEN 6 THEN CAST(substr(d, 6, 2) AS INTEGER) IN (1, 3, 5, 7, 8, 10, 12) WHEN 7 THEN CAST(substr(d, 1, 4) AS INTEGER) % 4 = 0 ELSE false END AS valid
    FROM (SELECT o_orderkey, d, {STAMPS} AS s FROM (SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders))""")
def source_timestamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order dates (1992 to 1998) as source timestamps of twelve forms, most of which are none."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    k, d = F.col("o_orderkey") % 12, F.col("d")
    ends = {0: " 24:00:00", 1: " 23:59:60", 3: " 10:00:00.1234", 4: " 10:00:00.", 5: "T10:00:00", 8: " 10:00:00\n", 9: " 1:00:00", 10: " 10:00:00.12"}
    stamp = F.when(k == 2, F.concat(F.lit("0099"), F.substring(d, 5, 6), F.lit(" 10:00:00"))).when(k == 6, F.concat(F.substring(d, 1, 8), F.lit("31 10:00:00"))).when(k == 7, F.concat(F.substring(d, 1, 5), F.lit("02-29 10:00:00")))
    for i, end in ends.items():
        stamp = stamp.when(k == i, F.concat(d, F.lit(end)))
    stamp = stamp.otherwise(F.concat(d, F.lit(" 00:00:00")))
    return rows.select("o_orderkey", stamp.alias("stamp"), f.valid_local_timestamp(stamp).alias("valid"))


@query("""SELECT event_id, CASE event_id % 5 WHEN 0 THEN s || 'Z' WHEN 1 THEN s WHEN 2 THEN replace(s, 'T', ' ') || 'Z' WHEN 3 THEN substr(s, 1, 19) || 'Z' ELSE substr(s, 1, 8) || '31' || substr(s, 11) || 'Z' END AS instant,
    CASE event_id % 5 WHEN 0 THEN true WHEN 4 THEN CAST(substr(s, 6, 2) AS INTEGER) IN (1, 3, 5, 7, 8, 10, 12) ELSE false END AS valid, CASE event_id % 5 WHEN 4 THEN CAST(substr(s, 6, 2) AS INTEGER) IN (1, 3, 5, 7, 8, 10, 12) ELSE true END AS date_valid, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS utc
    FROM (SELECT event_id, ts, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '.000' AS s FROM events)""")
def instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event times as ISO instants, whole and with planted faults, and as text to the second."""
    e, s = F.col("event_id") % 5, F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(".000"))
    last = F.concat(F.substring(s, 1, 8), F.lit("31"), F.substring(s, 11, 99), F.lit("Z"))
    instant = F.when(e == 0, F.concat(s, F.lit("Z"))).when(e == 1, s).when(e == 2, F.concat(F.replace(s, F.lit("T"), F.lit(" ")), F.lit("Z"))).when(e == 3, F.concat(F.substring(s, 1, 19), F.lit("Z"))).otherwise(last)
    return table(spark, sf_dir, "events").select("event_id", instant.alias("instant"), f.valid_instant(instant).alias("valid"), f.valid_date(F.substring(instant, 1, 10)).alias("date_valid"), f.utc_text(F.col("ts")).alias("utc"))


@query("""SELECT event_id, event_id % 4 = 0 AS exact FROM events""")
def exact_key_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as JSON objects with the agreed keys, one more, one less, or no object."""
    e = F.col("event_id") % 4
    body = F.when(e == 0, F.to_json(F.struct("user_id", "event_type"))).when(e == 1, F.to_json(F.struct("user_id", "event_type", "value"))).when(e == 2, F.to_json(F.struct("user_id"))).otherwise("[1]")
    return table(spark, sf_dir, "events").select("event_id", web.exact_keys(body, ["event_type", "user_id"]).alias("exact"))


def _states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A persisted state for each customer: kinds 0 to 2 valid, the others with a planted fault."""
    k = F.col("doc") % 12
    rows = _key(spark, sf_dir).withColumn("day", 1 + F.col("doc") % 28)
    date = F.format_string("2024-05-%02d", F.col("day"))

    def zones(shift: int, access: bool) -> Column:
        def one(i: Column) -> Column:
            s = (F.col("doc") + i + shift) % 9 + 1
            level = f.level(s)
            told = F.when((k == 3) & (i == 2) & F.lit(access), level % 3 + 1).otherwise(level)
            fields = [F.when((k == 4) & (i == 1), 59).otherwise(i + 53).alias("zone_id"), told.alias("level"), s.alias("situation_id")]
            return F.struct(*fields, *([F.when((k == 5) & (i == 6), "open").otherwise(f.access(level)).alias("forest_access")] if access else []))

        return F.transform(F.sequence(F.lit(0), F.when(k == 6, 5).otherwise(6)), one)

    first = F.struct(F.concat(date, F.lit("T05:00:00.000Z")).alias("a"), F.concat(date, F.lit("T06:00:00.000Z")).alias("b"))
    rows = rows.select(
        F.col("doc").alias("key"), F.when(k == 7, 3).when(k == 1, 1).otherwise(2).alias("version"), F.concat(date, F.when(k == 8, " 25:00:00").otherwise(" 07:00:00")).alias("source_time"),
        F.when(k == 9, first["a"]).otherwise(f.latest_instant(first["a"], first["b"])).alias("retrieved_at"), F.array(first["a"], first["b"]).alias("source_times"), zones(0, True).alias("current"), F.when(k != 1, zones(4, False)).alias("forecast"),
        F.when(k != 1, F.when(k == 10, date).otherwise(f.next_date(date))).alias("forecast_date"),
    )
    own = f.source_date(F.col("source_time"))
    snapshot = F.when(F.col("version") == 1, f.snapshot_id(own, F.col("current"))).otherwise(f.snapshot_id(own, F.col("current"), F.col("forecast")))
    return rows.withColumn("snapshot_id", F.when(F.col("key") % 12 == 11, "sha256:0").otherwise(snapshot))


def _zone_text(shift: int) -> str:
    return f"string_agg('[' || (53 + i) || ',' || (((c_custkey + i + {shift}) % 9) // 3 + 1) || ']', ',' ORDER BY i)"


SNAPSHOTS = f"""snaps AS (SELECT c_custkey, '2024-05-' || lpad(CAST(1 + c_custkey % 28 AS VARCHAR), 2, '0') AS d, {_zone_text(0)} AS now, {_zone_text(4)} AS ahead FROM customer CROSS JOIN range(7) r(i) GROUP BY c_custkey),
    ids AS (SELECT c_custkey, d, 'sha256:' || sha256(CASE WHEN c_custkey % 12 = 1 THEN '{{"sourceDate":"' || d || '","levels":[' || now || ']}}' ELSE '{{"sourceDate":"' || d || '","currentLevels":[' || now || '],"forecastNextDayLevels":[' || ahead || ']}}' END) AS snapshot FROM snaps)"""


@query(f"""WITH {SNAPSHOTS} SELECT c_custkey AS key, CASE WHEN c_custkey % 12 IN (3, 4, 5, 6, 7, 8, 9, 10, 11) THEN '' ELSE snapshot END AS snapshot_id, CASE c_custkey % 12 WHEN 7 THEN 'INCOMPATIBLE_SCHEMA_VERSION' WHEN 0 THEN 'OK' WHEN 1 THEN 'OK' WHEN 2 THEN 'OK' ELSE 'INVALID_PERSISTED_STATE' END AS code,
    c_custkey % 12 IN (0, 2, 3, 5, 8, 9, 10, 11) AS client_accepts FROM ids""")
def persisted_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States of both versions with planted faults: the repository's verdict and the map's; ids of valid ones against SQL's own digest."""
    rows = state.violations(_states(spark, sf_dir))
    code = F.coalesce("code", F.lit("OK"))
    accepts = state.client_accepts(F.col("version"), F.col("current"), F.col("forecast"))
    return rows.select("key", F.when(code == "OK", F.col("snapshot_id")).otherwise("").alias("snapshot_id"), code.alias("code"), accepts.alias("client_accepts"))


@query(f"""WITH {SNAPSHOTS}, j AS (SELECT c_custkey AS key, c_custkey % 12 AS k, d, snapshot, d <> '2024-05-09' AS old, CASE WHEN c_custkey % 12 = 1 THEN 'null' ELSE '"' || strftime(CAST(d AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') || '"' END AS ahead FROM ids),
    r AS (SELECT *, CASE WHEN key % 5 = 0 THEN 'not_published' WHEN k = 7 THEN 'incompatible_schema_version' WHEN k > 2 THEN 'invalid_persisted_state' ELSE '' END AS reason FROM j)
    SELECT key, CASE WHEN reason <> '' OR old THEN 503 ELSE 200 END AS health_status, CASE WHEN reason <> '' THEN 503 ELSE 200 END AS status_status, reason,
        CASE WHEN reason <> '' THEN '{{"ok":false,"status":"unavailable","reason":"' || reason || '"}}' ELSE '{{"ok":' || (NOT old) || ',"status":"' || CASE WHEN old THEN 'stale' ELSE 'current' END || '","snapshotId":"' || snapshot || '","sourceDate":"' || d || '","forecastValidDate":' || ahead || ',"currentDateMadrid":"2024-05-09"}}' END AS health,
        CASE WHEN reason <> '' THEN '{{"ok":false,"status":"unavailable","reason":"' || reason || '"}}' ELSE '{{"schemaVersion":' || CASE k WHEN 1 THEN 1 ELSE 2 END || ',"snapshotId":"' || snapshot || '","isStale":' || old || ',"forecastNextDay":' || CASE k WHEN 1 THEN 'null' ELSE '{{"validDate":' || ahead || ',"isStale":' || old || '}}' END || '}}' END AS status FROM r""")
def status_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the status and health routes answer at 23:30 UTC of 8 May 2024, when it is 9 May in Madrid; every fifth key has no state."""
    judged = state.violations(_states(spark, sf_dir))
    never = F.col("key") % 5 == 0
    rows = judged.select("key", *[F.when(~never, F.col(c)).alias(c) for c in ("version", "source_time", "snapshot_id", "forecast_date", "code")])
    return state.documents(rows, F.lit("2024-05-08 23:30:00").cast("timestamp"))


@query("""SELECT event_id AS key, CASE event_id % 5 WHEN 1 THEN 'INVALID_JSON' WHEN 2 THEN 'INVALID_JSON' ELSE 'OK' END AS code, CASE event_id % 5 WHEN 0 THEN user_id WHEN 3 THEN user_id ELSE -1 END AS user_id FROM events""")
def state_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored bodies: objects, cut-off and scalar JSON, none."""
    e = F.col("event_id") % 5
    body = F.when(e == 4, None).when(e == 1, '{"user_id":').when(e == 2, "17").otherwise(F.to_json(F.struct("user_id", "event_type")))
    rows = state.read_back(table(spark, sf_dir, "events").select(F.col("event_id").alias("key"), body.alias("body")), "user_id long")
    return rows.select("key", F.coalesce("code", F.lit("OK")).alias("code"), F.coalesce("state.user_id", F.lit(-1)).alias("user_id"))


@query("""SELECT l_orderkey, l_linenumber, strftime(greatest(l_shipdate, l_shipdate + INTERVAL (l_linenumber * 3 % 5 - 2) DAY), '%Y-%m-%dT00:00:00.000Z') AS retrieved_at FROM lineitem""")
def latest_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = lambda d: F.date_format(d, "yyyy-MM-dd'T'00:00:00.000'Z'")
    other = F.date_add(F.to_date("l_shipdate"), (F.col("l_linenumber") * 3 % 5 - 2).cast("int"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", f.latest_instant(text(F.to_date("l_shipdate")), text(other)).alias("retrieved_at"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'text/html' WHEN 1 THEN 'text/html' WHEN 2 THEN 'application/json' WHEN 3 THEN 'text/htmlx' ELSE '' END AS media_type, page_id % 5 IN (0, 1, 2) AS allowed FROM pages""")
def content_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 5
    header = F.when(k == 0, "text/html").when(k == 1, " Text/HTML ; charset=utf-8").when(k == 2, "application/JSON;q=1;v=2").when(k == 3, "text/htmlx")
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(web.content_type(header), F.lit("")).alias("media_type"), web.content_type_allowed(header, ["text/html", "application/json"]).alias("allowed"))


@query("""SELECT page_id, 'content-type=text/html;etag="' || page_id || '", "b"' || CASE WHEN page_id % 2 = 0 THEN ';last-modified=now' ELSE '' END AS headers FROM pages""")
def selected_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Allowed response headers by lower-cased name; those of one name are joined in order."""
    pair = lambda n, v: F.struct(F.lit(n).alias("name"), v.alias("value"))
    held = F.array(pair("ETag", F.concat(F.lit('"'), F.col("page_id").cast("string"), F.lit('"'))), pair("Set-Cookie", F.lit("x")), pair("etag", F.lit('"b"')), pair("Content-Type", F.lit("text/html")))
    held = F.concat(held, F.when(F.col("page_id") % 2 == 0, F.array(pair("LAST-MODIFIED", F.lit("now")))).otherwise(F.array().cast("array<struct<name:string,value:string>>")))
    own = web.selected_headers(held, ["content-type", "etag", "last-modified"])
    text = F.array_join(F.transform(F.array_sort(F.map_entries(own)), lambda e: F.concat_ws("=", e["key"], e["value"])), ";")
    return table(spark, sf_dir, "pages").select("page_id", text.alias("headers"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'INVALID_ZONE_SET' WHEN 1 THEN 'INVALID_JSON' ELSE 'UNEXPECTED_ERROR' END AS code FROM events""")
def safe_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id") % 4
    code = F.when(e == 0, "INVALID_ZONE_SET").when(e == 1, "INVALID_JSON").when(e == 2, F.concat(F.lit("java.io.IOException: /secret/"), F.col("user_id").cast("string")))
    return table(spark, sf_dir, "events").select("event_id", feed.safe_error(code).alias("code"))


@query("""SELECT page_id, CASE page_id % 6 WHEN 0 THEN true WHEN 1 THEN true ELSE false END AS web, CASE page_id % 6 WHEN 0 THEN true ELSE false END AS secure FROM pages""")
def web_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages' places under URLs of six forms: https, http, with credentials, ftp, without host, none."""
    k, at = F.col("page_id") % 6, F.concat(F.lit("host.example/p"), F.col("page_id").cast("string"))
    form = lambda a, b="": F.concat(F.lit(a), at, F.lit(b))
    url = F.when(k == 0, form("https://", "?q=1#x")).when(k == 1, form("http://")).when(k == 2, form("https://user:pw@")).when(k == 3, form("ftp://")).when(k == 4, "https:///p").otherwise("p q")
    return table(spark, sf_dir, "pages").select("page_id", web.valid_web_url(url).alias("web"), web.valid_web_url(url, secure=True).alias("secure"))


CASES = {
    "/": (200, "text/html", "public, max-age=300"), "/health": (200, "application/json", "no-store"), "/status.json": (200, "application/json", "public, max-age=300"), "/tiles/8/126/97.png": (200, "image/png", "public, max-age=3600"),
    "/tiles/5/0/0.png": (404, "application/json", None), "/tiles/6/64/0.png": (404, "application/json", None), "/tiles/06/0/0.png": (404, "application/json", None), "/nothing": (404, "text/html", None), "/package": (200, "application/zip", None),
}


@query("""SELECT event_id, CASE event_id % 5 WHEN 1 THEN 'status' WHEN 2 THEN 'content_type' WHEN 3 THEN CASE WHEN user_id % 9 < 4 THEN 'cache_control' ELSE '' END WHEN 4 THEN 'status,content_type' ELSE '' END AS problems FROM events""")
def response_contracts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as observed answers to nine fixed requests; what departs from the case is planted by event."""
    kind = "struct<status:int,content_type:string,cache_control:string,sha256:string>"
    cases = spark.createDataFrame([(i, (*v, None)) for i, v in enumerate(CASES.values())], f"case long, expected {kind}")
    e = F.col("event_id") % 5
    observed = F.struct(
        F.when(e.isin(1, 4), 500).otherwise(F.col("expected.status")).alias("status"), F.when(e.isin(2, 4), "text/plain").otherwise(F.col("expected.content_type")).alias("content_type"),
        F.when(e == 3, "private").otherwise(F.col("expected.cache_control")).alias("cache_control"), F.lit("00").alias("sha256"),
    )
    rows = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 9).alias("case")).join(F.broadcast(cases), "case")
    return rows.select("event_id", F.array_join(web.response_violations(observed, F.col("expected")), ",").alias("problems"))


@query("""SELECT page_id, url_encode(url || ' ~*é') AS quoted FROM pages""")
def quoted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", web.quoted(F.concat("url", F.lit(" ~*é"))).alias("quoted"))


REQUESTS = """requests AS (SELECT event_id, 'sha256:' || (user_id % 5) || ':current:' || CASE WHEN event_type = 'error' THEN 'stale-' || strftime(ts, '%Y-%m-%d') ELSE 'current' END AS cache_tag, CAST(8 AS BIGINT) AS z, user_id % 3 AS x, event_id % 4 AS y, ts < TIMESTAMP '{cut}' AS early FROM events)"""


@query("WITH cut AS (SELECT min(ts) + (max(ts) - min(ts)) / 2 AS middle FROM events), " + REQUESTS.replace("TIMESTAMP '{cut}'", "(SELECT middle FROM cut)") + """, cached AS (SELECT DISTINCT cache_tag, z, x, y FROM requests WHERE early AND x <> 2)
    SELECT event_id, cache_tag, c.z IS NOT NULL AS hit, CASE WHEN c.z IS NOT NULL THEN 'tile ' || r.x || '/' || r.y ELSE '' END AS content FROM requests r LEFT JOIN cached c USING (cache_tag, z, x, y) WHERE NOT early""")
def tile_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as tile requests: the first half of the time fills the cache (results of one column fail), the second half is served from it."""
    events = table(spark, sf_dir, "events")
    ends = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("a"), F.max(F.unix_micros(F.col("ts").cast("timestamp"))).alias("b"))
    old = F.when(F.col("event_type") == "error", F.concat(F.lit("stale-"), F.date_format("ts", "yyyy-MM-dd"))).otherwise("current")
    tag = F.concat(F.lit("sha256:"), (F.col("user_id") % 5).cast("string"), F.lit(":current:"), old)
    early = F.unix_micros(F.col("ts").cast("timestamp")) < F.floor((F.col("a") + F.col("b")) / 2)
    rows = events.crossJoin(F.broadcast(ends)).select("event_id", tag.alias("cache_tag"), F.lit(8).cast("long").alias("z"), (F.col("user_id") % 3).alias("x"), (F.col("event_id") % 4).alias("y"), early.alias("early"))
    empty = spark.createDataFrame([], "cache_tag string, z long, x long, y long, content string")
    _, wanted = cache.serve(rows.where("early"), empty)
    made = wanted.withColumn("content", F.when(F.col("x") != 2, F.concat(F.lit("tile "), F.concat_ws("/", "x", "y"))))
    answers, _ = cache.serve(rows.where("not early"), cache.store(empty, made))
    return answers.select("event_id", "cache_tag", "hit", F.coalesce("content", F.lit("")).alias("content"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","method":"GET","status":' || CASE WHEN event_type = 'error' THEN 500 ELSE 200 END || ',"user":' || CASE WHEN event_id % 3 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) END || '}' AS line FROM events""")
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = {"user": F.when(F.col("event_id") % 3 != 0, F.col("user_id")), "status": F.when(F.col("event_type") == "error", 500).otherwise(200), "method": F.lit("GET"), "event_type": F.col("event_type")}
    return table(spark, sf_dir, "events").select("event_id", web.log_line(fields).alias("line"))


@query("""SELECT doc_id, doc_id % 9 IN (0, 1) AS contained FROM documents""")
def contained_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["a/b-{}.json", "snapshots/{}", "/etc/{}", "a/../{}", "../{}", "a//{}", "./{}", "C:/{}", "a\\{}"]
    path = F.replace(F.element_at(F.array(*map(F.lit, forms)), (F.col("doc_id") % 9 + 1).cast("int")), F.lit("{}"), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", web.contained(path).alias("contained"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 4 THEN '' ELSE (p_partkey % 256) || ',' || (p_size % 256) || ',17' END AS rgb, p_partkey % 5 <> 4 AND p_partkey % 3 <> 2 AS palette FROM part""")
def colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colours written in hexadecimal, some malformed, and palettes of them, some with a channel out of range."""
    k = F.col("p_partkey")
    digits = F.format_string("%02x%02X11", (k % 256).cast("int"), (F.col("p_size") % 256).cast("int"))
    text = F.when(k % 5 == 4, F.concat(digits, F.lit("0"))).when(k % 2 == 0, digits).otherwise(F.concat(F.lit("#"), digits))
    rgb = f.colour(text)
    palette = F.array_repeat(F.when(k % 3 == 2, F.transform(rgb, lambda v: v + 300)).otherwise(rgb), 7)
    return table(spark, sf_dir, "part").select("p_partkey", F.coalesce(F.array_join(rgb, ","), F.lit("")).alias("rgb"), f.valid_palette(palette).alias("palette"))

