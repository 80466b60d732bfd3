"""The registered queries over the driver's tables and the SQL that each must agree with.

The tables hold no risk feeds, so each query applies an operator to a table of like form: events are feed rows (situation k mod 9
+ 1, zone 53 + user mod 7), nations and regions zones, customers and suppliers places, embeddings points in metres.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import feed as f
from ..functions import names as nm
from ..functions import png
from ..functions import tiles as t
from ..functions import web
from ..operators import crosswalk, pyramid, reconcile, state, topology
from ..operators.feed import first_violation, strict_int
from .base import QUERIES, SQL, query, table

__all__ = ["QUERIES", "SQL"]

def _feed_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = strict_int(F.try_parse_json("props"), "$.k")
    return table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), (k % 9 + 1).alias("situation_id"), (53 + F.col("user_id") % 7).alias("zone_id"))


def _catalogue(spark: SparkSession) -> DataFrame:
    return spark.range(1, 10).select(F.col("id").alias("situation_id"), f.level(F.col("id")).alias("level"))


FEED = """WITH feed AS (SELECT *, CAST(props->>'k' AS BIGINT) AS k, CAST(props->>'k' AS BIGINT) % 9 + 1 AS situation_id, 53 + user_id % 7 AS zone_id,
    CAST((CAST(props->>'k' AS BIGINT) % 9) // 3 + 1 AS INTEGER) AS level FROM events)"""


@query(FEED + """ SELECT event_id, zone_id, situation_id, level, CASE WHEN level = 3 THEN 'closed_by_mvp_rule' ELSE 'unrestricted_by_mvp_rule' END AS forest_access FROM feed""")
def feed_level_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir).join(F.broadcast(_catalogue(spark)), "situation_id", "left")
    return rows.select("event_id", "zone_id", "situation_id", "level", f.access(F.col("level")).alias("forest_access"))


@query(FEED + """ SELECT event_id, zone_id, CAST(((k + 1) % 9) // 3 + 1 AS INTEGER) AS level, strftime(CAST(ts AS DATE) + INTERVAL 1 DAY, '%Y-%m-%d') AS valid_date FROM feed""")
def forecast_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir)
    return rows.select("event_id", "zone_id", f.level((F.col("k") + 1) % 9 + 1).alias("level"), f.next_date(F.date_format("ts", "yyyy-MM-dd")).alias("valid_date"))


@query(FEED + """, rules AS (
    SELECT user_id, event_id, CASE WHEN k >= 95 THEN 0 WHEN value > 100 THEN 1 WHEN event_type = 'error' AND k % 5 = 0 THEN 2 END AS rank FROM feed)
    SELECT user_id, min(event_id) AS event_id, arg_min(CASE rank WHEN 0 THEN 'INVALID_REQUIRED_FIELD' WHEN 1 THEN 'INVALID_ZONE_SET' ELSE 'SITUATION_INACTIVE' END, event_id) AS code
    FROM rules WHERE rank IS NOT NULL GROUP BY user_id""")
def first_violation_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir)
    path = F.lit("$")
    bad = first_violation([
        (F.col("k") < 95, "INVALID_REQUIRED_FIELD", path), (F.col("value") <= 100, "INVALID_ZONE_SET", path), ((F.col("event_type") != "error") | (F.col("k") % 5 != 0), "SITUATION_INACTIVE", path),
    ])
    worst = rows.withColumn("bad", bad).where("bad is not null").groupBy("user_id").agg(F.min(F.struct("event_id", "bad")).alias("w"))
    return worst.select("user_id", "w.event_id", F.col("w.bad.code").alias("code"))


@query("""SELECT p_partkey, p_size % 12 AS situation, p_size % 4 AS advisory,
    CASE WHEN p_size % 4 <> 3 AND p_size % 12 BETWEEN 1 AND 9 THEN 'SITUATION_WRONG_ADVISORY' WHEN p_size % 4 = 3 AND p_size % 12 NOT BETWEEN 1 AND 9 THEN 'UNKNOWN_SITUATION_ID' ELSE 'OK' END AS verdict
    FROM part WHERE p_size % 4 = 3 OR p_size % 12 BETWEEN 1 AND 9""")
def advisory_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") % 12).alias("situation"), (F.col("p_size") % 4).alias("advisory"))
    own, known = F.col("advisory") == f.ADVISORY, F.col("situation").between(1, 9)
    verdict = F.when(~own & known, "SITUATION_WRONG_ADVISORY").when(own & ~known, "UNKNOWN_SITUATION_ID").otherwise("OK")
    return rows.where(own | known).withColumn("verdict", verdict)


@query(FEED + """, zones AS (SELECT CAST(ts AS DATE) AS d, zone_id, max(level) AS level FROM feed GROUP BY ALL)
    SELECT strftime(d, '%Y-%m-%d') AS source_date, 'sha256:' || sha256('{"sourceDate":"' || strftime(d, '%Y-%m-%d') || '","levels":[' || string_agg('[' || zone_id || ',' || level || ']', ',' ORDER BY zone_id) || ']}') AS snapshot_id
    FROM zones GROUP BY d""")
def snapshot_id_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir).withColumn("level", f.level(F.col("situation_id"))).withColumn("source_date", F.date_format("ts", "yyyy-MM-dd"))
    zones = rows.groupBy("source_date", "zone_id").agg(F.max("level").cast("long").alias("level"))
    days = zones.groupBy("source_date").agg(F.array_sort(F.collect_list(F.struct("zone_id", "level"))).alias("zones"))
    return days.select("source_date", f.snapshot_id(F.col("source_date"), F.col("zones")).alias("snapshot_id"))


@query("""SELECT event_id, user_id, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) = event_type THEN 'unchanged' ELSE 'published' END AS outcome FROM events""")
def publish_outcome(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.outcomes(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type").select("event_id", "user_id", "outcome")


@query("""SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id""")
def last_valid_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return state.current(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), ["user_id"], ["ts", "event_id"]).select("user_id", "event_id", "event_type")


MADRID = "strftime(timezone('Europe/Madrid', timezone('UTC', ts)), '%Y-%m-%d')"


@query(f"""SELECT event_id, {MADRID} AS local_date, strftime(ts, '%Y-%m-%d') <> {MADRID} AS is_stale FROM events""")
def madrid_stale_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    return table(spark, sf_dir, "events").select("event_id", f.local_date(F.col("ts")).alias("local_date"), f.stale(stamp, F.col("ts")).alias("is_stale"))


@query(f"""SELECT event_id, CASE WHEN event_type = 'signup' THEN 503 WHEN strftime(ts, '%Y-%m-%d') <> {MADRID} THEN 503 ELSE 200 END AS health_status, CASE WHEN event_type = 'signup' THEN 503 ELSE 200 END AS status_status FROM events""")
def health_status_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    never = F.col("event_type") == "signup"
    old = f.stale(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("ts"))
    return table(spark, sf_dir, "events").select("event_id", F.when(never | old, 503).otherwise(200).alias("health_status"), F.when(never, 503).otherwise(200).alias("status_status"))


@query(FEED + f""", tagged AS (SELECT event_id, level, CASE WHEN event_type = 'signup' THEN 'unavailable:current:' || {MADRID} ELSE 'sha256:' || sha256(CAST(event_id AS VARCHAR)) || ':current:' || CASE WHEN strftime(ts, '%Y-%m-%d') <> {MADRID} THEN 'stale-' || {MADRID} ELSE 'current' END END AS cache_tag FROM feed)
    SELECT event_id, cache_tag, '"' || replace(cache_tag, ':', '-') || '-8-126-97"' AS etag, CASE level WHEN 1 THEN 'A4CC87' WHEN 2 THEN 'FF9700' ELSE 'E83D35' END AS color FROM tagged""")
def tile_state_tag(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _feed_rows(spark, sf_dir).withColumn("level", f.level(F.col("situation_id")))
    snapshot = F.when(F.col("event_type") != "signup", F.concat(F.lit("sha256:"), F.sha2(F.col("event_id").cast("string"), 256)))
    old = f.stale(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.col("ts"))
    tag = f.cache_tag(snapshot, F.lit("current"), old, f.local_date(F.col("ts")))
    colours = F.create_map(*[x for k, v in f.LEVEL_RGB.items() for x in (F.lit(k), F.lit("%02X%02X%02X" % v))])
    return rows.select("event_id", tag.alias("cache_tag"), f.etag(tag, F.lit(8), F.lit(126), F.lit(97)).alias("etag"), F.element_at(colours, F.col("level")).alias("color"))


@query("SELECT p_partkey, (p_size * 5) % 256 AS channel, CAST(floor(((p_size * 5) % 256) * CAST(0.55 AS DOUBLE) + 0.5) AS INTEGER) AS stripe FROM part")
def stripe_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 5 % 256).alias("channel"))
    return rows.withColumn("stripe", f.stripe(F.col("channel")))


@query("""WITH c AS (SELECT c_nationkey AS nation, count(*) AS n FROM customer GROUP BY 1), e AS (SELECT n_nationkey AS nation, CAST(50 + n_regionkey AS BIGINT) AS expected FROM (SELECT CASE WHEN n_nationkey = 7 THEN 107 ELSE n_nationkey END AS n_nationkey, n_regionkey FROM nation))
    SELECT coalesce(c.nation, e.nation) AS nation, coalesce(n, 0) AS n, coalesce(expected, 0) AS expected, coalesce(n, 0) = coalesce(expected, 0) AS passes FROM c FULL JOIN e ON c.nation = e.nation""")
def zone_count_vs_expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers of each nation against planned numbers; one plan stands under another nation."""
    expected = table(spark, sf_dir, "nation").select(F.when(F.col("n_nationkey") == 7, 107).otherwise(F.col("n_nationkey")).alias("nation"), (50 + F.col("n_regionkey")).alias("expected"))
    return reconcile.against_expected(table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")), expected, "nation")


@query("SELECT sha256(text) AS sha256, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) <> 1")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.duplicates(table(spark, sf_dir, "documents"), F.sha2("text", 256), "sha256")


@query("""SELECT count(*) AS n, count(DISTINCT doc_id) AS n_ids, count(DISTINCT sha256(text)) AS n_texts, count(DISTINCT source) AS n_sources, count(*) FILTER (text IS NULL OR trim(text) = '') AS n_blank, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars FROM documents""")
def scalar_quality_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    distinct = {"n_ids": F.col("doc_id"), "n_texts": F.sha2("text", 256), "n_sources": F.col("source")}
    return reconcile.metrics(table(spark, sf_dir, "documents"), distinct, "text", "n_chars")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers with a code and three name variants."""
    key = F.lpad(F.col("s_suppkey").cast("string"), 5, "0")
    short = F.concat(F.lit("S-"), (F.col("s_suppkey") % 40).cast("string"))
    both = F.concat(F.col("s_name"), F.lit("/"), F.col("s_suppkey").cast("string"))
    return table(spark, sf_dir, "supplier").select(key.alias("code"), F.col("s_name").alias("name_a"), short.alias("name_b"), both.alias("name_c"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that customers stand for: full, short, doubled, alias or unknown, by key."""
    key = F.col("c_custkey")
    full = F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))
    name = F.when(key % 5 == 0, full).when(key % 5 == 1, F.concat(F.lit("S-"), (key % 60).cast("string"))).when(key % 5 == 2, F.concat(full, F.lit("/"), key.cast("string"))).when(key % 5 == 3, F.concat(F.lit("alias-"), (key % 30).cast("string"))).otherwise(F.lower(full))
    return table(spark, sf_dir, "customer").select("c_custkey", name.alias("name"))


PLACES = """places AS (SELECT lpad(CAST(s_suppkey AS VARCHAR), 5, '0') AS code, s_name AS name_a, 'S-' || (s_suppkey % 40) AS name_b, s_name || '/' || s_suppkey AS name_c FROM supplier),
    asked AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN full_name WHEN 1 THEN 'S-' || (c_custkey % 60) WHEN 2 THEN full_name || '/' || c_custkey WHEN 3 THEN 'alias-' || (c_custkey % 30) ELSE lower(full_name) END AS name
        FROM (SELECT c_custkey, 'Supplier#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS full_name FROM customer)),
    variants AS (SELECT code, 0 AS rank, 'name_a' AS field, name_a AS name FROM places UNION ALL SELECT code, 1, 'name_b', name_b FROM places UNION ALL SELECT code, 2, 'name_c', name_c FROM places)"""


@query("WITH " + PLACES + """, idx AS (SELECT name, code, string_agg(field, ';' ORDER BY rank) AS fields, min(rank) AS first FROM variants GROUP BY 1, 2),
    hits AS (SELECT name, count(*) AS codes, min(code) AS code, min(fields) AS fields, min(first) AS first FROM idx GROUP BY 1),
    aliases AS (SELECT 'alias-' || i AS name, lpad(CAST(i AS VARCHAR), 5, '0') AS alias_code FROM range(20) r(i))
    SELECT c_custkey, a.name, CASE WHEN codes = 1 THEN h.code WHEN codes IS NULL THEN alias_code END AS code,
        CASE WHEN codes > 1 THEN 'ambiguous' WHEN codes = 1 AND first = 0 THEN 'exact_primary' WHEN codes = 1 THEN 'exact_variant' WHEN alias_code IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS method,
        CASE WHEN codes = 1 THEN fields WHEN codes IS NULL AND alias_code IS NOT NULL THEN 'alias_file' ELSE '' END AS match_fields
    FROM asked a LEFT JOIN hits h ON a.name = h.name LEFT JOIN aliases l ON a.name = l.name""")
def name_variant_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.range(20).select(F.concat(F.lit("alias-"), F.col("id").cast("string")).alias("name"), F.lpad(F.col("id").cast("string"), 5, "0").alias("alias_code"))
    return crosswalk.match(_asked(spark, sf_dir), _places(spark, sf_dir), "code", ["name_a", "name_b", "name_c"], aliases)


KEYS = """regexp_replace(lower(trim(regexp_replace(regexp_replace(name, '\\s*/\\s*', '/', 'g'), '\\s+', ' ', 'g'))), '$', '')"""


@query("WITH " + PLACES + f""", vk AS (SELECT code, {KEYS} AS k FROM variants), ak AS (SELECT name, {KEYS} AS k FROM (SELECT DISTINCT name FROM asked)),
    vkeys AS (SELECT DISTINCT code, key FROM (SELECT code, unnest(list_distinct(list_append(list_filter(string_split(k, '/'), lambda x: x <> ''), k))) AS key FROM vk)),
    akeys AS (SELECT DISTINCT name, key FROM (SELECT name, unnest(list_distinct(list_append(list_filter(string_split(k, '/'), lambda x: x <> ''), k))) AS key FROM ak))
    SELECT name, string_agg(DISTINCT code, ',' ORDER BY code) AS candidates FROM akeys JOIN vkeys USING (key) GROUP BY name""")
def candidate_suggestions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = crosswalk.suggest(_asked(spark, sf_dir).select("name").distinct(), _places(spark, sf_dir), "code", ["name_a", "name_b", "name_c"])
    return found.select("name", F.array_join("candidates", ",").alias("candidates"))


@query("""WITH a AS (SELECT CASE WHEN l_linenumber > 2 THEN -1000 * l_orderkey - l_linenumber ELSE l_orderkey END AS k, count(*) AS n FROM lineitem GROUP BY 1), b AS (SELECT DISTINCT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey - 1 ELSE o_orderkey END AS k FROM orders)
    SELECT * FROM (SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'missing' WHEN b.k IS NULL THEN 'extra' WHEN n > 1 THEN 'duplicate' END AS problem FROM a FULL JOIN b ON a.k = b.k) WHERE problem IS NOT NULL""")
def bijection_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines against orders; lines from the third on and every seventh order stand under other keys, so each problem occurs."""
    own, other = F.col("l_orderkey"), F.col("o_orderkey")
    left = table(spark, sf_dir, "lineitem").select(F.when(F.col("l_linenumber") > 2, -1000 * own - F.col("l_linenumber")).otherwise(own).alias("k"))
    right = table(spark, sf_dir, "orders").select(F.when(other % 7 == 0, -other - 1).otherwise(other).alias("k"))
    return crosswalk.bijection(left, right, "k")


@query("""WITH a AS (SELECT CASE WHEN doc_id % 3 = 1 THEN -doc_id ELSE doc_id END AS doc_id, CASE WHEN n_chars >= 500 THEN 1 ELSE 0 END AS quality FROM documents), b AS (SELECT doc_id, quality FROM labels)
    SELECT * FROM (SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN b.doc_id IS NULL THEN 'missing' WHEN a.doc_id IS NULL THEN 'extra' WHEN a.quality IS DISTINCT FROM b.quality THEN 'differs:quality' END AS problem FROM a FULL JOIN b ON a.doc_id = b.doc_id) WHERE problem IS NOT NULL""")
def review_reconciliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a rule's quality against labels; every third document stands under another id."""
    key = F.when(F.col("doc_id") % 3 == 1, -F.col("doc_id")).otherwise(F.col("doc_id")).alias("doc_id")
    required = table(spark, sf_dir, "documents").select(key, F.when(F.col("n_chars") >= 500, 1).otherwise(0).alias("quality"))
    return crosswalk.review_problems(required, table(spark, sf_dir, "labels"), "doc_id", ["quality"])


@query("""WITH d AS (SELECT doc_id, source, unnest(list_filter([CASE WHEN doc_id % 10 = 0 THEN 'required_sample' END, CASE WHEN contains(text, '/') THEN 'bilingual' END, CASE WHEN regexp_matches(text, '(?i),\\s*(el|la|els|les|los|las|l'')(/|$)') THEN 'postposed_article' END, CASE WHEN lang = 'es' THEN 'alias' END], lambda x: x IS NOT NULL)) AS category FROM documents)
    SELECT category, count(*) AS n FROM d GROUP BY 1""")
def category_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = nm.review_categories(F.col("text"), F.col("doc_id") % 10 == 0, F.col("lang") == "es")
    return table(spark, sf_dir, "documents").select(F.explode(own).alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT c_name AS place, lpad(CAST(c_custkey AS VARCHAR), 5, '0') AS code, CAST(n_regionkey AS VARCHAR) AS zone, coalesce(CASE WHEN c_acctbal >= 0 THEN c_mktsegment END, '') AS note, n_name || ';' || c_mktsegment AS fields
    FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey""")
def crosswalk_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return rows.select(
        F.col("c_name").alias("place"), F.lpad(F.col("c_custkey").cast("string"), 5, "0").alias("code"), F.col("n_regionkey").cast("string").alias("zone"),
        F.coalesce(F.when(F.col("c_acctbal") >= 0, F.col("c_mktsegment")), F.lit("")).alias("note"), F.array_join(F.array("n_name", "c_mktsegment"), ";").alias("fields"),
    )


@query("""SELECT source, sha256(text) AS sha256, min(doc_id) AS first_doc, count(*) AS versions, max(strlen(text)) AS bytes FROM documents GROUP BY 1, 2""")
def content_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("source", F.sha2("text", 256).alias("sha256"), "doc_id", F.octet_length("text").cast("long").alias("size"))
    return rows.groupBy("source", "sha256").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("versions"), F.max("size").alias("bytes"))


@query("""WITH rows AS (SELECT sha256(n_nationkey || chr(10) || '{"n_nationkey":' || n_nationkey || ',"n_name":"' || n_name || '","n_regionkey":' || n_regionkey || '}') AS h FROM nation),
    parts AS (SELECT substr(h, 1, 4) AS part, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS h FROM rows GROUP BY 1)
    SELECT CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(h, chr(10) ORDER BY part)) AS sha256 FROM parts""")
def logical_dataset_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.logical_hash(table(spark, sf_dir, "nation"), ["n_nationkey"], ["n_nationkey", "n_name", "n_regionkey"])


@query("""WITH a AS (SELECT source, lang, n_chars % 10 AS digit FROM documents WHERE doc_id % 2 = 0), b AS (SELECT source, lang, n_chars % 10 AS digit FROM documents WHERE doc_id % 2 = 1)
    SELECT *, 'missing' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'extra' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""")
def manifest_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", (F.col("n_chars") % 10).alias("digit"))
    return reconcile.multiset_difference(docs.where("doc_id % 2 = 0").drop("doc_id"), docs.where("doc_id % 2 = 1").drop("doc_id"))


@query("""WITH a AS (SELECT CASE WHEN doc_id % 5 = 0 THEN -doc_id - 1 ELSE doc_id END AS path, sha256(text) AS digest FROM documents), b AS (SELECT CASE WHEN doc_id % 11 = 0 THEN 1000000000 + doc_id ELSE doc_id END AS path, sha256(CASE WHEN doc_id % 7 = 0 THEN text || '!' ELSE text END) AS digest FROM documents)
    SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'missing' WHEN a.path IS NULL THEN 'extra' WHEN a.digest IS DISTINCT FROM b.digest THEN 'changed' ELSE 'same' END AS status FROM a FULL JOIN b ON a.path = b.path""")
def inventory_vs_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents against themselves with other paths on either side and some changed texts."""
    docs, k = table(spark, sf_dir, "documents"), F.col("doc_id")
    a = docs.select(F.when(k % 5 == 0, -k - 1).otherwise(k).alias("path"), F.sha2("text", 256).alias("digest"))
    text = F.when(k % 7 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    b = docs.select(F.when(k % 11 == 0, 1_000_000_000 + k).otherwise(k).alias("path"), F.sha2(text, 256).alias("digest"))
    return reconcile.inventory(a, b, "path", "digest")


@query("""SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS protocol, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, nullif(regexp_extract(url, '\\?([^#]*)', 1), '') AS query, regexp_extract(url, '^([a-z]+)://', 1) IN ('http', 'https') AS is_web FROM pages""")
def url_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = {p: F.try_parse_url("url", F.lit(p)) for p in ("PROTOCOL", "HOST", "QUERY")}
    return table(spark, sf_dir, "pages").select("page_id", part["PROTOCOL"].alias("protocol"), part["HOST"].alias("host"), part["QUERY"].alias("query"), web.valid_web_url(F.col("url")).alias("is_web"))


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile paths that events stand for: with and without period, out of range, with leading zeroes, of other form."""
    e, u = F.col("event_id"), F.col("user_id")
    z, x, y = 4 + e % 13, u * 37 % 20000, e * 11 % 9000
    plain = F.concat_ws("/", z.cast("string"), x.cast("string"), y.cast("string"))
    path = F.when(e % 6 == 0, F.concat(F.lit("/tiles/"), plain, F.lit(".png"))).when(e % 6 == 1, F.concat(F.lit("/tiles/current/"), plain, F.lit(".png")))
    path = path.when(e % 6 == 2, F.concat(F.lit("/tiles/forecast-next-day/"), plain, F.lit(".png"))).when(e % 6 == 3, F.concat(F.lit("/tiles/0"), plain, F.lit(".png"))).when(e % 6 == 4, F.concat(F.lit("/tile/"), plain, F.lit(".jpg")))
    return table(spark, sf_dir, "events").select("event_id", path.otherwise(F.concat(F.lit("/tiles/"), plain, F.lit("x.png"))).alias("path"))


PATHS = """raw AS (SELECT event_id, (4 + event_id % 13) || '/' || (user_id * 37 % 20000) || '/' || (event_id * 11 % 9000) AS plain FROM events),
    paths AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '/tiles/' || plain || '.png' WHEN 1 THEN '/tiles/current/' || plain || '.png' WHEN 2 THEN '/tiles/forecast-next-day/' || plain || '.png' WHEN 3 THEN '/tiles/0' || plain || '.png' WHEN 4 THEN '/tile/' || plain || '.jpg' ELSE '/tiles/' || plain || 'x.png' END AS path FROM raw)"""


@query("WITH " + PATHS + """, m AS (SELECT event_id, path, regexp_extract(path, '^/tiles/(?:(current|forecast-next-day)/)?([0-9]+)/([0-9]+)/([0-9]+)\\.png$', ['p', 'z', 'x', 'y']) AS g FROM paths),
    n AS (SELECT event_id, path, CASE WHEN g.p = 'forecast-next-day' THEN 'forecast_next_day' ELSE 'current' END AS period, try_cast(g.z AS BIGINT) AS z, try_cast(g.x AS BIGINT) AS x, try_cast(g.y AS BIGINT) AS y FROM m)
    SELECT event_id, path, CASE WHEN ok THEN period END AS period, CASE WHEN ok THEN z ELSE -1 END AS z, CASE WHEN ok THEN x ELSE -1 END AS x, CASE WHEN ok THEN y ELSE -1 END AS y
    FROM (SELECT *, coalesce(z BETWEEN 6 AND 14 AND x < (1 << least(z, 30)) AND y < (1 << least(z, 30)), false) AS ok FROM n)""")
def route_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).withColumn("r", t.parse_route(F.col("path"))).select("event_id", "path", "r.period", *[F.coalesce(f"r.{c}", F.lit(-1)).alias(c) for c in "zxy"])


@query("WITH " + PATHS + """, m AS (SELECT event_id, path, regexp_extract(path, '^/tiles/([^/]+)/([^/]+)/([^/]+)\\.png$', ['z', 'x', 'y']) AS g FROM paths),
    n AS (SELECT event_id, g.z <> '' AS form, regexp_full_match(g.z, '0|[1-9][0-9]*') AND regexp_full_match(g.x, '0|[1-9][0-9]*') AND regexp_full_match(g.y, '0|[1-9][0-9]*') AS canonical, try_cast(g.z AS BIGINT) AS z, try_cast(g.x AS BIGINT) AS x, try_cast(g.y AS BIGINT) AS y FROM m)
    SELECT event_id, CASE WHEN NOT form THEN 'unknown_route' WHEN NOT canonical THEN 'not_canonical' WHEN z NOT BETWEEN 6 AND 14 THEN 'zoom_out_of_range' WHEN x >= (1 << least(z, 30)) OR y >= (1 << least(z, 30)) THEN 'tile_out_of_range' ELSE 'ok' END AS verdict FROM n""")
def route_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("event_id", t.classify_route(F.col("path")).alias("verdict"))


@query("""WITH h AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '*' WHEN 1 THEN '"a-' || (event_id % 3) || '", "b"' WHEN 2 THEN NULL ELSE ' "a-1" ' END AS header FROM events)
    SELECT event_id, coalesce(list_contains(list_transform(string_split(header, ','), lambda x: trim(x)), '*') OR list_contains(list_transform(string_split(header, ','), lambda x: trim(x)), '"a-1"'), false) AS not_modified FROM h""")
def etag_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    header = F.when(e % 4 == 0, "*").when(e % 4 == 1, F.concat(F.lit('"a-'), (e % 3).cast("string"), F.lit('", "b"'))).when(e % 4 == 3, ' "a-1" ')
    return table(spark, sf_dir, "events").select("event_id", f.etag_matches(header, F.lit('"a-1"')).alias("not_modified"))


def _points(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("embedding")[0].cast("double"), F.col("embedding")[1].cast("double")
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", (x * 2000000.0).alias("px"), (y * 2000000.0 + 4800000.0).alias("py"))


POINTS = "points AS (SELECT vec_id, label, CAST(embedding[1] AS DOUBLE) * 2000000.0 AS px, CAST(embedding[2] AS DOUBLE) * 2000000.0 + 4800000.0 AS py FROM embeddings)"


def _tile_sql(axis: str, value: str, zoom: str) -> str:
    shift = f"({value} + 20037508.342789244)" if axis == "x" else f"(20037508.342789244 - {value})"
    return f"least((1 << {zoom}) - 1, greatest(0, CAST(floor({shift} / 40075016.685578488 * (256 * (1 << {zoom})) / 256) AS BIGINT)))"


@query(f"WITH {POINTS}, zooms AS (SELECT CAST(i AS INTEGER) AS z FROM range(6, 15) r(i)) SELECT vec_id, z, {_tile_sql('x', 'px', 'z')} AS x, {_tile_sql('y', 'py', 'z')} AS y FROM points CROSS JOIN zooms")
def point_to_tile(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.explode(F.array(*[F.lit(i) for i in range(t.MIN_ZOOM, t.MAX_ZOOM + 1)])).alias("z")
    return _points(spark, sf_dir).select("vec_id", "px", "py", z).select("vec_id", "z", t.tile_x(F.col("z"), F.col("px")).alias("x"), t.tile_y(F.col("z"), F.col("py")).alias("y"))


BOXES = f"""boxes AS (SELECT label, min(px) AS min_x, min(py) AS min_y, min(px) + 30000.0 AS max_x, min(py) + 20000.0 AS max_y FROM points GROUP BY label),
    spans AS (SELECT label, z, {_tile_sql('x', 'min_x', 'z')} AS x0, {_tile_sql('x', 'max_x', 'z')} AS x1, {_tile_sql('y', 'max_y', 'z')} AS y0, {_tile_sql('y', 'min_y', 'z')} AS y1 FROM boxes CROSS JOIN (SELECT CAST(i AS INTEGER) AS z FROM range(6, 12) r(i))),
    tiles AS (SELECT label, z, x, unnest(range(y0, y1 + 1)) AS y FROM (SELECT label, z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM spans))"""


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = _points(spark, sf_dir).groupBy("label").agg(F.min("px").alias("min_x"), F.min("py").alias("min_y"))
    return low.withColumn("max_x", F.col("min_x") + 30000.0).withColumn("max_y", F.col("min_y") + 20000.0)


def _tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.candidates(_boxes(spark, sf_dir), tuple(range(6, 12))).select("label", "z", "x", "y")


@query(f"WITH {POINTS}, {BOXES} SELECT label, z, x, y FROM tiles")
def tile_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _tiles(spark, sf_dir)


@query(f"""WITH {POINTS}, {BOXES}, d AS (SELECT DISTINCT z, x, y FROM tiles)
    SELECT a.z, a.x, a.y, 'east' AS direction FROM d a JOIN d b ON a.z = b.z AND a.x + 1 = b.x AND a.y = b.y UNION ALL SELECT a.z, a.x, a.y, 'south' FROM d a JOIN d b ON a.z = b.z AND a.x = b.x AND a.y + 1 = b.y""")
def neighbour_tiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.neighbours(_tiles(spark, sf_dir))


@query(f"WITH {POINTS}, {BOXES} SELECT coalesce(z, -1) AS z, count(*) AS tiles, CAST(sum(x + y) AS BIGINT) AS bytes, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y FROM tiles GROUP BY ROLLUP (z)")
def zoom_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.zoom_summary(_tiles(spark, sf_dir).withColumn("size", F.col("x") + F.col("y")), "size").withColumn("z", F.coalesce("z", F.lit(-1)))


@query(f"WITH {POINTS}, {BOXES}, n AS (SELECT z, x, y, label, row_number() OVER w AS rn, count(*) OVER (PARTITION BY z) AS n FROM tiles WINDOW w AS (PARTITION BY z ORDER BY x, y, label)) SELECT z, x, y, label, CASE WHEN rn = 1 THEN 'first' WHEN rn = n THEN 'last' ELSE 'middle' END AS position FROM n WHERE rn = 1 OR rn = n OR rn = n // 2 + 1")
def ordered_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pyramid.first_middle_last(_tiles(spark, sf_dir), "z", ["x", "y", "label"])


@query(f"WITH {POINTS} SELECT label, min(px) AS min_x, min(py) AS min_y, max(px) AS max_x, max(py) AS max_y, count(*) AS n FROM points GROUP BY label")
def bbox_by_zone(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _points(spark, sf_dir).groupBy("label").agg(F.min("px").alias("min_x"), F.min("py").alias("min_y"), F.max("px").alias("max_x"), F.max("py").alias("max_y"), F.count(F.lit(1)).alias("n"))


@query("""SELECT n_regionkey AS zone, CAST(count(*) * 10000 AS DOUBLE) AS area, CAST(200.0 * count(*) + 200.0 AS DOUBLE) AS perimeter FROM nation GROUP BY 1""")
def edge_dissolve_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    # each nation is a box of 100 m, the boxes of a region stand side by side
    i = (F.row_number().over(_by("n_regionkey", "n_nationkey")) - 1).cast("double") * 100.0
    low = F.col("n_regionkey").cast("double") * 1000.0

    def point(x: Column, y: Column) -> Column:
        return F.struct(x.alias("x"), y.alias("y"))

    ring = F.array(point(i, low), point(i + 100.0, low), point(i + 100.0, low + 100.0), point(i, low + 100.0), point(i, low))
    shapes = table(spark, sf_dir, "nation").select(F.col("n_regionkey").alias("zone"), F.array(F.array(ring)).alias("geometry"))
    outline = topology.dissolve(topology.edges(shapes, "zone", "geometry"), "zone")
    return topology.measures(outline, "zone").select("zone", "area", "perimeter")


def _by(group: str, *order: str):
    from pyspark.sql.window import Window

    return Window.partitionBy(group).orderBy(*order)


@query("""SELECT coalesce(CAST(6 + event_id % 9 AS BIGINT), -1) AS z, count(*) FILTER (event_type = 'view') AS view, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, count(*) AS total FROM events GROUP BY ROLLUP (CAST(6 + event_id % 9 AS BIGINT))""")
def outcome_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select((6 + F.col("event_id") % 9).alias("z"), "event_type")
    counts = [F.count_if(F.col("event_type") == e).alias(e) for e in ("view", "click", "error")]
    return rows.rollup("z").agg(*counts, F.count(F.lit(1)).alias("total")).withColumn("z", F.coalesce("z", F.lit(-1)))


@query("""SELECT event_id, coalesce((epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id)) // 1000000, -1) AS gap_seconds FROM events""")
def revisit_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    gap = F.floor((F.col("at") - F.lag("at").over(_by("user_id", "at", "event_id"))) / 1000000)
    return rows.select("event_id", F.coalesce(gap, F.lit(-1)).alias("gap_seconds"))


@query("SELECT n_nationkey, seq, type, length, true AS crc_ok FROM nation CROSS JOIN (VALUES (0, 'IHDR', 13), (1, 'PLTE', 48), (2, 'tRNS', 16), (3, 'IDAT', -1), (4, 'IEND', 0)) c(seq, type, length)")
def chunk_scan_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tile for each nation, encoded, recoloured and scanned again."""
    @F.pandas_udf("binary")
    def paint(keys: pd.Series) -> pd.Series:
        grid = np.add.outer(np.arange(png.SIDE), np.arange(png.SIDE))
        return keys.map(lambda k: png.encode(((grid + k) % 8).astype(np.uint8), bytes(3 * png.COLOURS)))

    colours = F.array_repeat(F.array(F.lit(164), F.lit(204), F.lit(135)), 7)
    tiles = table(spark, sf_dir, "nation").select("n_nationkey", png.recoloured(paint(F.col("n_nationkey")), colours, F.lit("forecast_hatch")).alias("tile"))
    spark.udtf.register("png_chunks", png.chunk_table())
    tiles.createOrReplaceTempView("tessera_tiles")
    return spark.sql("SELECT n_nationkey, c.seq, c.type, CASE WHEN c.type = 'IDAT' THEN -1 ELSE c.length END AS length, c.crc_ok FROM tessera_tiles, LATERAL png_chunks(tile) c")


# more queries, registered as they are imported
from . import contracts, landing, relations, shapes  # noqa: E402, F401
