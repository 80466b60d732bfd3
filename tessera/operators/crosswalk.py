"""Crosswalk of names to codes: literal variants, reviewed aliases, bijection, review coverage, suggestions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.names import sort_key, suggestion_keys


def variants(table: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """name, code, fields (in their declared order): every name that a row has in some field."""
    ranked = F.explode(F.array(*[F.struct(F.lit(i).alias("rank"), F.lit(c).alias("field"), F.col(c).alias("name")) for i, c in enumerate(fields)]))
    rows = table.select(F.col(code).alias("code"), ranked.alias("v")).where("v.name <> ''")
    return rows.groupBy("v.name", "code").agg(F.transform(F.array_sort(F.collect_list(F.struct("v.rank", "v.field"))), lambda x: x["field"]).alias("fields"))


def match(names: DataFrame, table: DataFrame, code: str, fields: list[str], aliases: DataFrame) -> DataFrame:
    """names (name, ...) with code, method and match_fields.

    Method: exact_primary or exact_variant if one code has the name, ambiguous if several have, whatever the aliases say; else
    alias (name, alias_code), else unresolved. Ambiguous and unresolved names have no code.
    """
    index = variants(table, code, fields)
    hits = index.groupBy("name").agg(F.count(F.lit(1)).alias("codes"), F.min(F.struct("code", "fields")).alias("hit"))
    joined = names.join(hits, "name", "left").join(aliases.select("name", "alias_code"), "name", "left")
    exact = F.when(F.array_contains("hit.fields", fields[0]), "exact_primary").otherwise("exact_variant")
    method = F.when(F.col("codes") > 1, "ambiguous").when(F.col("codes") == 1, exact).when(F.col("alias_code").isNotNull(), "alias").otherwise("unresolved")
    return joined.select(
        *names.columns, F.when(F.col("codes") == 1, F.col("hit.code")).when(F.col("codes").isNull(), F.col("alias_code")).alias("code"), method.alias("method"),
        F.when(F.col("codes") == 1, F.array_join("hit.fields", ";")).when(method == "alias", "alias_file").otherwise("").alias("match_fields"),
    )


def suggest(names: DataFrame, table: DataFrame, code: str, fields: list[str]) -> DataFrame:
    """name and candidates: codes that share a suggestion key. For reports only, never assigned."""
    index = variants(table, code, fields).select("code", F.explode(suggestion_keys(F.col("name"))).alias("key")).distinct()
    asked = names.select("name", F.explode(suggestion_keys(F.col("name"))).alias("key"))
    return asked.join(index, "key").groupBy("name").agg(F.array_sort(F.collect_set("code")).alias("candidates"))


def bijection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """key and problem (duplicate, missing, extra) where left isn't each of right exactly once."""
    a = left.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = a.join(right.select(key).distinct().withColumn("there", F.lit(True)), key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("there").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def review_problems(required: DataFrame, reviews: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """key and problem: required without review, review not required, or the first compared column that differs."""
    a, b = required.alias("a"), reviews.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    differs = F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"differs:{c}")) for c in compared])
    problem = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "extra").otherwise(differs)
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), problem.alias("problem")).where("problem is not null")


def alias_problems(aliases: DataFrame, names: DataFrame, exact: DataFrame, targets: DataFrame, expected: list[str]) -> DataFrame:
    """index and the first problem of each alias (index, name, code, reason, status, reviewed_at, basis, expected_<c>...).

    names: name of all sources; exact: name of those that match by themselves; targets: code and the expected columns. In order: unknown_name,
    duplicate (an earlier alias of the name), redundant, unknown_code, no_reason, no_review, no_expectation, changed:<column>.
    """
    earlier = F.row_number().over(Window.partitionBy("name").orderBy("index")) > 1
    rows = aliases.withColumn("_again", earlier).join(names.select("name", F.lit(True).alias("_known")).distinct(), "name", "left")
    rows = rows.join(exact.select("name", F.lit(True).alias("_exact")).distinct(), "name", "left")
    rows = rows.join(targets.select("code", F.lit(True).alias("_there"), *[F.col(c).alias(f"_{c}") for c in expected]), "code", "left")
    reviewed = (F.col("status") == "approved") & F.col("reviewed_at").rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}\z") & (F.trim("basis") != "")
    pins = [F.col(f"expected_{c}") for c in expected]
    problem = (
        F.when(F.col("_known").isNull(), "unknown_name").when(F.col("_again"), "duplicate").when(F.col("_exact"), "redundant").when(F.col("_there").isNull(), "unknown_code")
        .when(F.trim(F.coalesce("reason", F.lit(""))) == "", "no_reason").when(~F.coalesce(reviewed, F.lit(False)), "no_review").when(F.coalesce(*pins).isNull(), "no_expectation")
    )
    for c in expected:
        problem = problem.when(F.col(f"expected_{c}").isNotNull() & ~F.col(f"expected_{c}").eqNullSafe(F.col(f"_{c}")), f"changed:{c}")
    return rows.select("index", problem.alias("problem")).where("problem is not null")


def projection(matched: DataFrame, table: DataFrame, code: str, fields: list[str], reviews: DataFrame, categories) -> DataFrame:
    """The published crosswalk, all columns text: name, zone, code, the table's fields, match_method, match_fields, alias_reason,
    review_status, review_categories, review_note; sort_key orders it, with the name for ties.

    matched: the rows of match() with zone and alias_reason; categories: review categories of a row, an array column of matched.
    """
    own = table.select(F.col(code).alias("code"), *fields)
    noted = reviews.select("name", F.lit(True).alias("_reviewed"), "review_note")
    rows = matched.withColumn("_categories", categories).join(own, "code", "left").join(noted, "name", "left")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("name", "zone", "code", *fields, "method", "match_fields", "alias_reason")]
    return rows.select(
        *[c.alias("match_method") if i == 3 + len(fields) else c for i, c in enumerate(text)], F.when(F.col("_reviewed"), "reviewed").otherwise("automatic").alias("review_status"),
        F.array_join("_categories", ";").alias("review_categories"), F.coalesce("review_note", F.lit("")).alias("review_note"), sort_key(F.col("name")).alias("sort_key"),
    )


def statistics(rows: DataFrame) -> DataFrame:
    """dimension, value, n: the published rows by match method, review status, zone and review category, in one pass."""
    one = F.array(*[F.struct(F.lit(d).alias("dimension"), F.col(c).alias("value")) for d, c in (("match_methods", "match_method"), ("review_status", "review_status"), ("zone_counts", "zone"))])
    more = F.transform(F.filter(F.split("review_categories", ";"), lambda x: x != ""), lambda x: F.struct(F.lit("review_categories").alias("dimension"), x.alias("value")))
    return rows.select(F.explode(F.concat(one, more)).alias("d")).groupBy("d.dimension", "d.value").agg(F.count(F.lit(1)).alias("n"))
