from pyspark.sql import functions as F

from tessera.functions import names
from tessera.operators import crosswalk, reconcile

FIELDS = ["name_a", "name_b", "name_c", "names_all"]


def places(spark):
    return spark.createDataFrame([("00001", "Norvik", "Norvik", "Norvik", "Norvik"), ("00002", "Belport", "Belporte", "Belport", "Belport/Belporte"), ("00003", "Quimra", "Quimra", None, "Quimra")], ["place_code", *FIELDS])


def test_match_methods(spark):
    asked = spark.createDataFrame([("Norvik",), ("Belport/Belporte",), ("Quimrah",), ("Nowhere",)], "name string")
    aliases = spark.createDataFrame([("Quimrah", "00003"), ("Norvik", "00003")], "name string, alias_code string")
    got = {r["name"]: (r["code"], r["method"], r["match_fields"]) for r in crosswalk.match(asked, places(spark), "place_code", FIELDS, aliases).collect()}
    assert got == {"Norvik": ("00001", "exact_primary", ";".join(FIELDS)), "Belport/Belporte": ("00002", "exact_variant", "names_all"), "Quimrah": ("00003", "alias", "alias_file"), "Nowhere": (None, "unresolved", "")}


def test_two_codes_are_ambiguous_even_with_an_alias(spark):
    table = places(spark).union(spark.createDataFrame([("00004", "Quimra", "x", "y", "z")], ["place_code", *FIELDS]))
    got = crosswalk.match(spark.createDataFrame([("Quimra",)], "name string"), table, "place_code", FIELDS, spark.createDataFrame([("Quimra", "00003")], "name string, alias_code string")).collect()[0]
    assert (got["method"], got["code"]) == ("ambiguous", None)


def test_suggestions_and_categories(spark):
    got = crosswalk.suggest(spark.createDataFrame([("BELPORT / other",)], "name string"), places(spark), "place_code", FIELDS).collect()
    assert got[0]["candidates"] == ["00002"]
    rows = spark.createDataFrame([("Storr, el/x", True, False), ("Torra, La", False, True), ("Plain", False, False), ("A,elx", False, False)], "n string, s boolean, a boolean")
    assert [r[0] for r in rows.select(names.review_categories(F.col("n"), F.col("s"), F.col("a"))).collect()] == [["required_sample", "bilingual", "postposed_article"], ["postposed_article", "alias"], [], []]
    folded = spark.createDataFrame([("STRAßE  ’a / B",)], "n string").select(names.suggestion_key_unicode(F.col("n"))).collect()[0][0]
    assert folded == "strasse 'a/b"


def test_bijection_and_reviews(spark):
    left = spark.createDataFrame([("a",), ("b",), ("b",), ("x",)], "k string")
    right = spark.createDataFrame([("a",), ("b",), ("c",)], "k string")
    assert {(r["k"], r["problem"]) for r in crosswalk.bijection(left, right, "k").collect()} == {("b", "duplicate"), ("x", "extra"), ("c", "missing")}
    required = spark.createDataFrame([("a", "1", None), ("b", "2", "n"), ("c", "3", "m")], "k string, code string, note string")
    reviews = spark.createDataFrame([("a", "1", None), ("b", "2", "other"), ("d", "4", "m")], "k string, code string, note string")
    assert {(r["k"], r["problem"]) for r in crosswalk.review_problems(required, reviews, "k", ["code", "note"]).collect()} == {("b", "differs:note"), ("c", "missing"), ("d", "extra")}


def test_logical_hash_ignores_order_and_partitions(spark):
    rows = spark.createDataFrame([(i, f"n{i}", None if i % 3 else i) for i in range(50)], "k long, a string, b long")
    first = reconcile.logical_hash(rows, ["k"], ["k", "a", "b"]).collect()
    assert first == reconcile.logical_hash(rows.orderBy(F.rand(1)).repartition(7), ["k"], ["k", "a", "b"]).collect()
    assert first != reconcile.logical_hash(rows.withColumn("b", F.coalesce("b", F.lit(0))), ["k"], ["k", "a", "b"]).collect()
    assert reconcile.logical_hash(rows.where("false"), ["k"], ["k", "a", "b"]).collect()[0]["n"] == 0
