"""Feed ingestion: strict typing of JSON, coded violations, catalogue join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import feed as f


class FeedError(ValueError):
    """A rejected document, with the code of its first violation."""

    def __init__(self, code: str, path: str):
        super().__init__(f"{code} at {path}")
        self.code, self.path = code, path


def strict_int(value: Column, path: str) -> Column:
    """Integer at a path of a VARIANT: a JSON number with no fraction, such as 9 or 9.0; text and booleans are null."""
    own = F.variant_get(value, path, "variant")
    kind = F.schema_of_variant(own)
    number = F.try_variant_get(value, path, "double")
    return F.when(kind.rlike(r"^(BIGINT|DECIMAL|DOUBLE|FLOAT)") & (number == F.floor(number)), number.cast("long"))


def strict_string(value: Column, path: str) -> Column:
    """Text at a path of a VARIANT; numbers and booleans are null."""
    return F.when(F.schema_of_variant(F.variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def items(value: Column, path: str) -> Column:
    """The array at a path as an array of VARIANT; null if it is none."""
    return F.when(F.schema_of_variant(F.variant_get(value, path, "variant")).startswith("ARRAY"), F.try_variant_get(value, path, "array<variant>"))


def first_violation(rules: list[tuple[Column, str, Column]]) -> Column:
    """struct(rank, code, path) of the first rule that fails, null if none; rules: (holds, code, path) in order of rank."""
    failed = [F.when(~F.coalesce(ok, F.lit(False)), F.struct(F.lit(i).alias("rank"), F.lit(code).alias("code"), path.alias("path"))) for i, (ok, code, path) in enumerate(rules)]
    return F.coalesce(*failed)


def read_zones(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Feed documents (doc, body) to zone rows and first violations.

    Returns (zones: doc, time, index, zone_id, situation_id, forecast_id; violations: doc, code, path). Violations come in the
    order of the document: its time, then each zone's fields, repetition and membership by position, then the whole set. Other
    fields are dropped.
    """
    parsed = docs.select("doc", F.try_parse_json("body").alias("v"))
    held = parsed.select("doc", strict_string(F.col("v"), "$.time").alias("time"), items(F.col("v"), "$.z1").alias("z1"))
    head = first_violation([
        (F.col("time").isNotNull(), "INVALID_REQUIRED_FIELD", F.lit("$.time")),
        (f.valid_local_timestamp(F.col("time")), "INVALID_SOURCE_TIMESTAMP", F.lit("$.time")),
        (F.col("z1").isNotNull(), "INVALID_REQUIRED_FIELD", F.lit("$.z1")),
    ])
    rows = held.select("doc", "time", F.posexplode("z1").alias("index", "z"))
    rows = rows.select("doc", "time", "index", strict_int(F.col("z"), "$.id").alias("zone_id"), strict_int(F.col("z"), "$.nact").alias("situation_id"), strict_int(F.col("z"), "$.npre").alias("forecast_id"))
    from pyspark.sql.window import Window

    earlier = F.count(F.lit(1)).over(Window.partitionBy("doc", "zone_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("earlier", earlier)
    at = F.concat(F.lit("$.z1["), F.col("index"), F.lit("]"))
    by_row = first_violation([
        (F.col("zone_id").isNotNull(), "INVALID_REQUIRED_FIELD", F.concat(at, F.lit(".id"))),
        (F.col("situation_id").isNotNull(), "INVALID_REQUIRED_FIELD", F.concat(at, F.lit(".nact"))),
        (F.col("forecast_id").isNotNull(), "INVALID_REQUIRED_FIELD", F.concat(at, F.lit(".npre"))),
        (F.col("earlier") == 0, "DUPLICATE_ZONE_ID", F.concat(at, F.lit(".id"))),
        (F.col("zone_id").isin(*f.ZONES), "INVALID_ZONE_SET", F.concat(at, F.lit(".id"))),
    ])
    first = rows.withColumn("bad", by_row).groupBy("doc").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("index", "bad"))).alias("worst"), F.array_sort(F.collect_set("zone_id")).alias("have"), F.count(F.lit(1)).alias("n"))
    complete = (F.col("have") == F.array(*[F.lit(z).cast("long") for z in f.ZONES])) & (F.col("n") == len(f.ZONES))
    joined = held.withColumn("head", head).join(first, "doc", "left")
    code = F.coalesce("head.code", "worst.bad.code", F.when(~F.coalesce(complete, F.lit(False)), "INVALID_ZONE_SET"))
    path = F.coalesce("head.path", "worst.bad.path", F.lit("$.z1"))
    violations = joined.select("doc", code.alias("code"), path.alias("path")).where("code is not null")
    return rows.drop("earlier"), violations


def read_catalogue(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Situation catalogues (doc, body) to (situations: doc, situation_id, level; violations: doc, code, path).

    Rows of other advisories are skipped unless they reuse one of the nine ids.
    """
    from pyspark.sql.window import Window

    held = docs.select("doc", items(F.try_parse_json("body"), "$.SITUACION").alias("list"))
    rows = held.select("doc", F.posexplode("list").alias("index", "s")).select(
        "doc", "index", strict_int(F.col("s"), "$.ID_SITUACION").alias("situation_id"), strict_int(F.col("s"), "$.ID_AVISO").alias("advisory"), strict_string(F.col("s"), "$.ACTIVO").alias("active")
    )
    rows = rows.withColumn("earlier", F.count(F.lit(1)).over(Window.partitionBy("doc", "situation_id").orderBy("index").rowsBetween(Window.unboundedPreceding, -1)))
    at = F.concat(F.lit("$.SITUACION["), F.col("index"), F.lit("]"))
    own, known = F.col("advisory") == f.ADVISORY, F.col("situation_id").isin(*f.SITUATIONS)
    bad = first_violation([
        (F.col("situation_id").isNotNull() & F.col("advisory").isNotNull() & F.col("active").isNotNull(), "INVALID_REQUIRED_FIELD", at),
        (F.col("earlier") == 0, "DUPLICATE_SITUATION_ID", at),
        (own | ~known, "SITUATION_WRONG_ADVISORY", at),
        (~own | known, "UNKNOWN_SITUATION_ID", at),
        (~own | (F.col("active") == "S"), "SITUATION_INACTIVE", at),
    ])
    rows = rows.withColumn("bad", bad)
    first = rows.groupBy("doc").agg(F.min(F.when(F.col("bad").isNotNull(), F.struct("index", "bad"))).alias("worst"), F.count_if(own & known & (F.col("active") == "S")).alias("n"))
    joined = held.join(first, "doc", "left")
    code = F.coalesce(F.when(F.col("list").isNull(), "INVALID_REQUIRED_FIELD"), F.col("worst.bad.code"), F.when(F.coalesce("n", F.lit(0)) != len(f.SITUATIONS), "INVALID_SITUATION_CATALOG"))
    violations = joined.select("doc", code.alias("code"), F.coalesce("worst.bad.path", F.lit("$.SITUACION")).alias("path")).where("code is not null")
    situations = rows.where(own & known & F.col("bad").isNull()).select("doc", "situation_id", f.level(F.col("situation_id")).alias("level"))
    return situations, violations


def normalise(zones: DataFrame, situations: DataFrame) -> DataFrame:
    """Zone rows with levels of the current and the forecast situation; a null level is an unknown situation.

    situations: situation_id, level, nine rows at most, so it is broadcast.
    """
    current = F.broadcast(situations.select(F.col("situation_id"), F.col("level")))
    forecast = F.broadcast(situations.select(F.col("situation_id").alias("forecast_id"), F.col("level").alias("forecast_level")))
    out = zones.join(current, "situation_id", "left").join(forecast, "forecast_id", "left")
    return out.withColumn("forest_access", F.when(F.col("level").isNotNull(), f.access(F.col("level")))).withColumn("forecast_date", f.next_date(f.source_date(F.col("time"))))


def unresolved(normalised: DataFrame) -> DataFrame:
    """doc, code, index of the first situation without a level: all current ones are looked up before the forecast's."""
    bad = normalised.select("doc", F.explode(F.array_compact(F.array(
        F.when(F.col("level").isNull(), F.struct(F.lit(0).alias("rank"), "index", F.lit("UNKNOWN_CURRENT_SITUATION").alias("code"))),
        F.when(F.col("forecast_level").isNull(), F.struct(F.lit(1).alias("rank"), "index", F.lit("UNKNOWN_FORECAST_SITUATION").alias("code"))),
    ))).alias("b"))
    return bad.groupBy("doc").agg(F.min("b").alias("b")).select("doc", "b.code", "b.index")


def snapshots(normalised: DataFrame) -> DataFrame:
    """A row for each document: doc, source_date, current, forecast (by zone), snapshot_id."""
    current = F.struct("zone_id", "level", "situation_id", "forest_access")
    ahead = F.struct("zone_id", F.col("forecast_level").alias("level"), F.col("forecast_id").alias("situation_id"))
    grouped = normalised.groupBy("doc", f.source_date(F.col("time")).alias("source_date")).agg(F.array_sort(F.collect_list(current)).alias("current"), F.array_sort(F.collect_list(ahead)).alias("forecast"))
    return grouped.withColumn("snapshot_id", f.snapshot_id(F.col("source_date"), F.col("current"), F.col("forecast")))


def require_valid(*violations: DataFrame) -> None:
    """Raise the first violation, if any; the rows that reach the driver are at most one."""
    for bad in reduce(DataFrame.unionByName, [v.select("doc", "code", "path") for v in violations]).orderBy("doc").limit(1).collect():
        raise FeedError(bad["code"], bad["path"])


#: Codes that may leave the service; the reason of any other failure stays inside.
PUBLIC_CODES = (
    "INVALID_REQUIRED_FIELD", "INVALID_SOURCE_TIMESTAMP", "DUPLICATE_ZONE_ID", "INVALID_ZONE_SET", "DUPLICATE_SITUATION_ID", "SITUATION_WRONG_ADVISORY", "UNKNOWN_SITUATION_ID", "SITUATION_INACTIVE",
    "INVALID_SITUATION_CATALOG", "UNKNOWN_CURRENT_SITUATION", "UNKNOWN_FORECAST_SITUATION", "INVALID_JSON", "INVALID_PERSISTED_STATE", "INCOMPATIBLE_SCHEMA_VERSION",
)


def safe_error(code: Column) -> Column:
    """The code of an error as it may be logged: a known one, else UNEXPECTED_ERROR."""
    return F.when(code.isin(*PUBLIC_CODES), code).otherwise("UNEXPECTED_ERROR")


def split_domain(rows: DataFrame, column: str, allowed: tuple[int, ...], outside: int) -> DataFrame:
    """rows with bucket: kept for allowed values, outside for the one that is set aside, invalid for all others and null."""
    value = F.col(column)
    return rows.withColumn("bucket", F.when(value.isin(*allowed), "kept").when(value == outside, "outside").otherwise("invalid"))
