"""Queries of names, reconciliation and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names as nm
from ..operators import crosswalk, feed, reconcile, rendering
from .base import query, table
from .registry import BOXES, PLACES, POINTS, _asked, _places, _tiles


@query("""SELECT c_custkey, c_nationkey + 40 AS zone, CASE WHEN c_nationkey + 40 BETWEEN 53 AND 59 THEN 'kept' WHEN c_nationkey + 40 = 40 THEN 'outside' ELSE 'invalid' END AS bucket FROM customer""")
def domain_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as places, their nation as zone: seven zones are kept, one is set aside, all others are errors."""
    rows = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_nationkey") + 40).alias("zone"))
    return feed.split_domain(rows, "zone", tuple(range(53, 60)), 40)


ALIASES = """SELECT o_orderkey AS index, CASE WHEN o_orderkey % 7 = 0 THEN 'nobody' WHEN o_orderkey % 11 = 0 THEN 'Supplier#' || lpad(CAST(o_custkey % 9 + 1 AS VARCHAR), 9, '0') ELSE 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') END AS name,
        CASE WHEN o_orderkey % 9 = 0 THEN 'none' ELSE lpad(CAST(o_custkey % 10 + 1 AS VARCHAR), 5, '0') END AS code, CASE WHEN o_orderkey % 13 = 0 THEN ' ' ELSE 'spelling' END AS reason, CASE WHEN o_orderkey % 17 = 0 THEN 'pending' ELSE 'approved' END AS status,
        CASE WHEN o_orderkey % 19 = 0 THEN '2024-5-1' ELSE '2024-05-01' END AS reviewed_at, CASE WHEN o_orderkey % 23 = 0 THEN '' ELSE 'register' END AS basis,
        CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderkey % 31 = 0 THEN 'other' ELSE 'Supplier#' || lpad(CAST(o_custkey % 10 + 1 AS VARCHAR), 9, '0') END AS expected_name_a FROM orders"""


@query("WITH " + PLACES + f""", aliases AS ({ALIASES}), ranked AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY index) AS rn FROM aliases),
    judged AS (SELECT index, CASE WHEN name NOT IN (SELECT c_name FROM customer UNION ALL SELECT s_name FROM supplier) THEN 'unknown_name' WHEN rn > 1 THEN 'duplicate' WHEN name IN (SELECT name_a FROM places) THEN 'redundant' WHEN r.code NOT IN (SELECT code FROM places) THEN 'unknown_code'
        WHEN trim(reason) = '' THEN 'no_reason' WHEN status <> 'approved' OR NOT regexp_full_match(reviewed_at, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') OR basis = '' THEN 'no_review' WHEN expected_name_a IS NULL THEN 'no_expectation' WHEN expected_name_a <> p.name_a THEN 'changed:name_a' END AS problem
        FROM ranked r LEFT JOIN places p ON r.code = p.code)
    SELECT index, problem FROM judged WHERE problem IS NOT NULL""")
def alias_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as entries of an alias file, with planted faults of every kind."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    nine, five = (lambda x: F.lpad(x.cast("string"), 9, "0")), (lambda x: F.lpad(x.cast("string"), 5, "0"))
    aliases = table(spark, sf_dir, "orders").select(
        k.alias("index"), F.when(k % 7 == 0, "nobody").when(k % 11 == 0, F.concat(F.lit("Supplier#"), nine(c % 9 + 1))).otherwise(F.concat(F.lit("Customer#"), nine(c))).alias("name"),
        F.when(k % 9 == 0, "none").otherwise(five(c % 10 + 1)).alias("code"), F.when(k % 13 == 0, " ").otherwise("spelling").alias("reason"), F.when(k % 17 == 0, "pending").otherwise("approved").alias("status"),
        F.when(k % 19 == 0, "2024-5-1").otherwise("2024-05-01").alias("reviewed_at"), F.when(k % 23 == 0, "").otherwise("register").alias("basis"),
        F.when(k % 29 == 0, None).when(k % 31 == 0, "other").otherwise(F.concat(F.lit("Supplier#"), nine(c % 10 + 1))).alias("expected_name_a"),
    )
    places = _places(spark, sf_dir)
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf_dir, "supplier").select("s_name"))
    return crosswalk.alias_problems(aliases, names, places.select(F.col("name_a").alias("name")), places, ["name_a"])


def _published(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = spark.range(20).select(F.concat(F.lit("alias-"), F.col("id").cast("string")).alias("name"), F.lpad(F.col("id").cast("string"), 5, "0").alias("alias_code"))
    places = _places(spark, sf_dir)
    asked = table(spark, sf_dir, "customer").select("c_custkey", (53 + F.col("c_nationkey") % 7).alias("zone")).join(_asked(spark, sf_dir), "c_custkey")
    found = crosswalk.match(asked, places, "code", ["name_a", "name_b", "name_c"], aliases).withColumn("alias_reason", F.when(F.col("method") == "alias", "spelling").otherwise(""))
    reviews = spark.range(30).select(F.concat(F.lit("alias-"), F.col("id").cast("string")).alias("name"), F.concat(F.lit("note "), F.col("id").cast("string")).alias("review_note"))
    own = nm.review_categories(F.col("name"), F.col("c_custkey") % 10 == 0, F.col("method") == "alias")
    return crosswalk.projection(found, places, "code", ["name_a", "name_b", "name_c"], reviews, own)


PUBLISHED = PLACES + """, idx AS (SELECT name, code, string_agg(field, ';' ORDER BY rank) AS fields, min(rank) AS first FROM variants GROUP BY 1, 2),
    hits AS (SELECT name, count(*) AS codes, min(code) AS code, min(fields) AS fields, min(first) AS first FROM idx GROUP BY 1),
    aliases AS (SELECT 'alias-' || i AS name, lpad(CAST(i AS VARCHAR), 5, '0') AS alias_code FROM range(20) r(i)),
    found AS (SELECT c.c_custkey, a.name, CAST(53 + c_nationkey % 7 AS VARCHAR) AS zone, CASE WHEN codes = 1 THEN h.code WHEN codes IS NULL THEN alias_code END AS code,
        CASE WHEN codes > 1 THEN 'ambiguous' WHEN codes = 1 AND first = 0 THEN 'exact_primary' WHEN codes = 1 THEN 'exact_variant' WHEN alias_code IS NOT NULL THEN 'alias' ELSE 'unresolved' END AS match_method,
        CASE WHEN codes = 1 THEN fields WHEN codes IS NULL AND alias_code IS NOT NULL THEN 'alias_file' ELSE '' END AS match_fields
        FROM customer c JOIN asked a USING (c_custkey) LEFT JOIN hits h ON a.name = h.name LEFT JOIN aliases l ON a.name = l.name),
    published AS (SELECT f.name, zone, coalesce(f.code, '') AS code, coalesce(name_a, '') AS name_a, coalesce(name_b, '') AS name_b, coalesce(name_c, '') AS name_c, match_method, match_fields, CASE WHEN match_method = 'alias' THEN 'spelling' ELSE '' END AS alias_reason,
        CASE WHEN f.name LIKE 'alias-%' THEN 'reviewed' ELSE 'automatic' END AS review_status,
        array_to_string(list_filter([CASE WHEN c_custkey % 10 = 0 THEN 'required_sample' END, CASE WHEN contains(f.name, '/') THEN 'bilingual' END, CASE WHEN match_method = 'alias' THEN 'alias' END], lambda x: x IS NOT NULL), ';') AS review_categories,
        CASE WHEN f.name LIKE 'alias-%' THEN 'note ' || substr(f.name, 7) ELSE '' END AS review_note, lower(f.name) AS sort_key FROM found f LEFT JOIN places p ON f.code = p.code)"""


@query("WITH " + PUBLISHED + " SELECT * FROM published")
def published_crosswalk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The crosswalk's 13 published columns and the key that orders them."""
    return _published(spark, sf_dir)


@query("WITH " + PUBLISHED + """ SELECT 'match_methods' AS dimension, match_method AS value, count(*) AS n FROM published GROUP BY 2 UNION ALL SELECT 'review_status', review_status, count(*) FROM published GROUP BY 2
    UNION ALL SELECT 'zone_counts', zone, count(*) FROM published GROUP BY 2 UNION ALL SELECT 'review_categories', c, count(*) FROM (SELECT unnest(string_split(review_categories, ';')) AS c FROM published) WHERE c <> '' GROUP BY 2""")
def crosswalk_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosswalk.statistics(_published(spark, sf_dir))


@query("""SELECT 'S-' || i AS name_b, count(s_suppkey) AS n, CASE count(s_suppkey) WHEN 0 THEN 'none' WHEN 1 THEN 'one' ELSE 'many' END AS status FROM range(60) r(i) LEFT JOIN supplier ON s_suppkey % 40 = i GROUP BY i""")
def sample_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = spark.range(60).select(F.concat(F.lit("S-"), F.col("id").cast("string")).alias("name_b"))
    return reconcile.exactly_one(_places(spark, sf_dir), "name_b", samples)


@query("""WITH a AS (SELECT n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS position, n_nationkey, n_name FROM nation), b AS (SELECT n_regionkey, position, n_nationkey + CASE WHEN n_nationkey = 9 THEN 1 ELSE 0 END AS n_nationkey, CASE WHEN n_nationkey % 5 = 3 THEN lower(n_name) ELSE n_name END AS n_name FROM a WHERE n_regionkey <> 2 OR position < 3)
    SELECT * FROM (SELECT a.n_regionkey, CAST(a.position AS INTEGER) AS position, CASE WHEN b.position IS NULL THEN 'missing' WHEN a.n_nationkey <> b.n_nationkey THEN 'differs:n_nationkey' WHEN a.n_name <> b.n_name THEN 'differs:n_name' END AS problem FROM a LEFT JOIN b ON a.n_regionkey = b.n_regionkey AND a.position = b.position) WHERE problem IS NOT NULL""")
def positional_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region, place by place, against a copy with one shortened list, other names and one other key."""
    nation = table(spark, sf_dir, "nation")
    items = F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("items")
    expected = nation.groupBy("n_regionkey").agg(items)
    changed = F.transform("items", lambda x: F.struct((x["n_nationkey"] + F.when(x["n_nationkey"] == 9, 1).otherwise(0)).alias("n_nationkey"), F.when(x["n_nationkey"] % 5 == 3, F.lower(x["n_name"])).otherwise(x["n_name"]).alias("n_name")))
    stored = expected.select("n_regionkey", F.when(F.col("n_regionkey") == 2, F.slice(changed, 1, 3)).otherwise(changed).alias("items"))
    return reconcile.positional(stored, expected, "n_regionkey", "items", ["n_nationkey", "n_name"])


@query("""WITH a AS (SELECT CASE WHEN page_id % 10 = 4 THEN -page_id ELSE page_id END AS page_id, html FROM pages), b AS (SELECT CASE WHEN page_id % 10 = 5 THEN -page_id ELSE page_id END AS page_id, CASE WHEN page_id % 9 = 0 THEN html || ' ' ELSE html END AS html FROM pages)
    SELECT coalesce(a.page_id, b.page_id) AS page_id, CASE WHEN b.page_id IS NULL THEN 'missing' WHEN a.page_id IS NULL THEN 'extra' WHEN a.html <> b.html THEN 'changed' ELSE 'same' END AS status, coalesce(strlen(a.html), -1) AS stored_bytes, coalesce(strlen(b.html), -1) AS fresh_bytes FROM a FULL JOIN b ON a.page_id = b.page_id""")
def artifact_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as stored artifacts against regenerated ones; some stand under other names on one side, some are changed."""
    pages, k = table(spark, sf_dir, "pages"), F.col("page_id")
    name = lambda rest: F.when(k % 10 == rest, -k).otherwise(k).alias("page_id")
    fresh = pages.select(name(5), F.when(k % 9 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")).alias("html"))
    return reconcile.artifacts(pages.select(name(4), "html"), fresh, "page_id", "html")


@query("""SELECT * FROM (SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'config:missing' WHEN doc_id % 13 = 0 THEN 'config:lang' WHEN doc_id % 17 = 0 THEN 'snapshot:sha256' END AS problem FROM documents) WHERE problem IS NOT NULL""")
def pinned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest of documents against a configuration and a snapshot that depart from it in planted rows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), "lang", "n_chars")
    config = rows.withColumn("lang", F.when(F.col("doc_id") % 13 == 0, "xx").otherwise(F.col("lang")))
    config = config.withColumn("doc_id", F.when(F.col("doc_id") % 19 == 0, -F.col("doc_id") - 1).otherwise(F.col("doc_id")))
    snapshot = rows.withColumn("sha256", F.when(F.col("doc_id") % 17 == 0, "").otherwise(F.col("sha256")))
    return reconcile.pinned(rows, {"config": config, "snapshot": snapshot}, "doc_id", ["sha256", "lang", "n_chars"])


@query("""WITH a AS (SELECT DISTINCT l_partkey AS k FROM lineitem), b AS (SELECT DISTINCT p_partkey + 100 AS k FROM part)
    SELECT (SELECT count(*) FROM a) AS left_n, (SELECT count(*) FROM b) AS right_n, (SELECT count(*) FROM (SELECT k FROM a UNION SELECT k FROM b)) AS union_n, (SELECT count(*) FROM (SELECT k FROM a INTERSECT SELECT k FROM b)) AS both_n,
        (SELECT count(*) FROM (SELECT k FROM a EXCEPT SELECT k FROM b)) AS left_only, (SELECT count(*) FROM (SELECT k FROM b EXCEPT SELECT k FROM a)) AS right_only""")
def code_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.set_relations(table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("k")), table(spark, sf_dir, "part").select((F.col("p_partkey") + 100).alias("k")), "k")


@query("""SELECT source, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS first FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE n_chars > 200) WHERE rn <= 3 GROUP BY source""")
def first_offenders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.first_offenders(table(spark, sf_dir, "documents").where("n_chars > 200"), "source", "doc_id", 3)


@query("""WITH f AS (SELECT max(strlen(text)) AS largest, sum(strlen(text)) AS total, count(*) AS n FROM documents)
    SELECT guard, CAST(value AS BIGINT) AS value, CAST(most AS BIGINT) AS most, value <= most AS passes FROM (SELECT 'largest' AS guard, largest AS value, 1048576 AS most FROM f UNION ALL SELECT 'total', total, 1000000 FROM f UNION ALL SELECT 'count', n, 19000 FROM f)""")
def size_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "documents").select(F.octet_length("text").alias("bytes"))
    return reconcile.guards(files, "bytes", 1_048_576, 1_000_000, 19_000)


HEAD = '{\n  "layer": "customer"\n}\n'


@query("""SELECT c_nationkey, count(*) AS n, CAST(26 + sum(strlen(piece)) AS BIGINT) AS bytes, sha256('{' || chr(10) || '  "layer": "customer"' || chr(10) || '}' || chr(10) || string_agg(piece, '' ORDER BY c_custkey)) AS sha256
    FROM (SELECT c_nationkey, c_custkey, '[' || chr(10) || '  ' || c_custkey || ',' || chr(10) || '  "' || c_name || '",' || chr(10) || '  {' || chr(10) || '    "sha256": "' || sha256(c_mktsegment) || '",' || chr(10) || '    "size_bytes": ' || strlen(c_mktsegment) || chr(10) || '  }' || chr(10) || ']' || chr(10) AS piece FROM customer) GROUP BY c_nationkey""")
def logical_stream_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each nation the logical hash of its customers: a schema header, then rows by code as canonical JSON, bytes as digest and size."""
    piece = reconcile.canonical_array([reconcile.json_value(F.col("c_custkey")), reconcile.json_value(F.col("c_name")), reconcile.json_blob(F.col("c_mktsegment").cast("binary"))])
    return reconcile.stream_hash(table(spark, sf_dir, "customer").withColumn("piece", piece), "c_nationkey", ["c_custkey"], "piece", HEAD)


@query(f"""WITH {POINTS}, {BOXES}, d AS (SELECT DISTINCT z, x, y FROM tiles) SELECT z, count(*) AS tiles, CAST(sum(7 * x + y) AS BIGINT) AS bytes, min(x) AS min_x, max(x) AS max_x, min(y) AS min_y, max(y) AS max_y,
    sha256(string_agg(sha256(x || ':' || y) || '  ' || z || '/' || x || '/' || y || '.png' || chr(10), '' ORDER BY x, y)) AS sha256 FROM d GROUP BY z""")
def zoom_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiles, bytes, bounds and the digest of the ordered inventory lines of each zoom."""
    own = _tiles(spark, sf_dir).select("z", "x", "y").distinct()
    tiles = own.withColumn("sha256", F.sha2(F.concat_ws(":", "x", "y"), 256)).withColumn("bytes", 7 * F.col("x") + F.col("y"))
    return rendering.published_inventory(tiles)


@query("SELECT c_custkey, '| ' || replace(c_name || '|' || c_mktsegment, '|', chr(92) || '|') || ' | ' || c_nationkey || ' |' AS line, format('[{:.3f}, {:.3f}, {:.3f}, {:.3f}]', CAST(c_custkey AS DOUBLE) / 8, CAST(c_nationkey AS DOUBLE) / 4, CAST(c_custkey AS DOUBLE), CAST(c_nationkey AS DOUBLE)) AS box FROM customer")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a Markdown report: cells with escaped bars, and a bounding box."""
    d = lambda c: F.col(c).cast("double")
    line = nm.markdown_row([F.concat_ws("|", "c_name", "c_mktsegment"), F.col("c_nationkey").cast("string")])
    return table(spark, sf_dir, "customer").select("c_custkey", line.alias("line"), nm.bbox_text(d("c_custkey") / 8, d("c_nationkey") / 4, d("c_custkey"), d("c_nationkey")).alias("box"))

