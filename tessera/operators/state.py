"""Published state: what a candidate does to the state that was there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import feed as f


def outcomes(candidates: DataFrame, key: list[str], order: list[str], snapshot: str) -> DataFrame:
    """The candidates with outcome: unchanged if the one before of the same key has the same snapshot, else published.

    Older source times publish like others; a null snapshot equals none.
    """
    before = F.lag(snapshot).over(Window.partitionBy(*key).orderBy(*order))
    return candidates.withColumn("outcome", F.when(before == F.col(snapshot), "unchanged").otherwise("published"))


def current(candidates: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The last candidate of each key, by order."""
    names = [c for c in candidates.columns if c not in key]
    last = F.max_by(F.struct(*names), F.struct(*order))
    return candidates.groupBy(*key).agg(last.alias("s")).select(*key, "s.*")


def valid_zones(zones: Column, with_access: bool) -> Column:
    """Whether zone i is 53 + i, its level follows from its situation, and its access from its level."""

    def ok(z: Column, i: Column) -> Column:
        good = (z["zone_id"] == i + f.ZONES[0]) & (z["level"] == f.level(z["situation_id"]))
        return good & (z["forest_access"] == f.access(z["level"])) if with_access else good

    return F.coalesce((F.size(zones) == len(f.ZONES)) & F.forall(F.transform(zones, ok), lambda x: x), F.lit(False))


def violations(states: DataFrame) -> DataFrame:
    """States (key, version, source_time, retrieved_at, source_times, current, forecast, forecast_date, snapshot_id) with code,
    null if valid. Versions 1, without forecast, and 2 can be read; the snapshot is computed again."""
    known = F.col("version").isin(1, 2)
    date = f.source_date(F.col("source_time"))
    again = F.when(F.col("version") == 1, f.snapshot_id(date, F.col("current"))).otherwise(f.snapshot_id(date, F.col("current"), F.col("forecast")))
    good = (
        f.valid_local_timestamp(F.col("source_time")) & f.valid_instant(F.col("retrieved_at")) & (F.col("retrieved_at") == F.array_max("source_times")) & valid_zones(F.col("current"), True)
        & F.when(F.col("version") == 1, F.col("forecast").isNull()).otherwise(valid_zones(F.col("forecast"), False) & (F.col("forecast_date") == f.next_date(date))) & (F.col("snapshot_id") == again)
    )
    code = F.when(~F.coalesce(known, F.lit(False)), "INCOMPATIBLE_SCHEMA_VERSION").when(~F.coalesce(good, F.lit(False)), "INVALID_PERSISTED_STATE")
    return states.withColumn("code", code)


def tile_states(states: DataFrame, now: Column, period: Column) -> DataFrame:
    """What to paint for a state: tag, whether it is stale, its date, style and the seven colours."""
    zones = F.when(period == "current", F.col("current")).otherwise(F.transform("forecast", lambda z: F.struct(z["zone_id"].alias("zone_id"), z["level"].alias("level"), z["situation_id"].alias("situation_id"), F.lit(None).cast("string").alias("forest_access"))))
    missing = zones.isNull()
    rgb = F.create_map(*[x for k, v in f.LEVEL_RGB.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    grey = F.array(*map(F.lit, f.STALE_RGB))
    old = missing | f.stale(F.col("source_time"), now)
    today = f.local_date(now)
    return states.select(
        "*", f.cache_tag(F.when(~missing, F.col("snapshot_id")), period, old, today).alias("cache_tag"), old.alias("stale"),
        F.when(period == "current", F.coalesce(f.source_date(F.col("source_time")), today)).otherwise(F.coalesce("forecast_date", f.next_date(today))).alias("valid_date"),
        F.when(period == "current", "solid").otherwise("forecast_hatch").alias("style"),
        F.when(missing, F.array_repeat(grey, len(f.ZONES))).otherwise(F.transform(zones, lambda z: F.element_at(rgb, z["level"]))).alias("colors"),
    )


def read_back(stored: DataFrame, schema: str) -> DataFrame:
    """Stored states (key, body) as key, state (of schema) and code: null bodies are no state, others that are no JSON object INVALID_JSON."""
    parsed = F.from_json("body", schema, {"mode": "PERMISSIVE"})
    whole = F.schema_of_variant(F.try_parse_json("body")).startswith("OBJECT")
    return stored.select("key", F.when(F.coalesce(whole, F.lit(False)), parsed).alias("state"), F.when(F.col("body").isNotNull() & ~F.coalesce(whole, F.lit(False)), "INVALID_JSON").alias("code"))


def documents(states: DataFrame, now: Column) -> DataFrame:
    """What the status and health routes answer for states (key, version, source_time, snapshot_id, forecast_date, code; version null
    where nothing was published): health_status, status_status, reason, is_stale, health and status as JSON.

    A state that can't be read is unavailable, one of another local date than now's is stale; a first version has no forecast.
    """
    date, today = f.source_date(F.col("source_time")), f.local_date(now)
    reason = F.when(F.col("code") == "INCOMPATIBLE_SCHEMA_VERSION", "incompatible_schema_version").when(F.col("code").isNotNull(), "invalid_persisted_state").when(F.col("version").isNull(), "not_published")
    old = f.stale(F.col("source_time"), now)
    ahead = F.when(F.col("version") == 2, F.col("forecast_date"))
    gone = F.to_json(F.struct(F.lit(False).alias("ok"), F.lit("unavailable").alias("status"), reason.alias("reason")))
    health = F.struct((~old).alias("ok"), F.when(old, "stale").otherwise("current").alias("status"), F.col("snapshot_id").alias("snapshotId"), date.alias("sourceDate"), ahead.alias("forecastValidDate"), today.alias("currentDateMadrid"))
    next_day = F.when(F.col("version") == 2, F.struct(ahead.alias("validDate"), old.alias("isStale")))
    status = F.struct(F.col("version").alias("schemaVersion"), F.col("snapshot_id").alias("snapshotId"), old.alias("isStale"), next_day.alias("forecastNextDay"))
    whole = {"ignoreNullFields": "false"}
    return states.select(
        "key", F.when(reason.isNotNull() | old, 503).otherwise(200).alias("health_status"), F.when(reason.isNotNull(), 503).otherwise(200).alias("status_status"), F.coalesce(reason, F.lit("")).alias("reason"),
        F.when(reason.isNotNull(), gone).otherwise(F.to_json(health, whole)).alias("health"), F.when(reason.isNotNull(), gone).otherwise(F.to_json(status, whole)).alias("status"),
    )


def client_accepts(version: Column, current: Column, forecast: Column) -> Column:
    """Whether the map shows a status: second version, seven zones in order, levels 1 to 3, also of the forecast."""

    def good(zones: Column) -> Column:
        return (F.size(zones) == len(f.ZONES)) & F.forall(F.transform(zones, lambda z, i: (z["zone_id"] == i + f.ZONES[0]) & z["level"].between(1, 3)), lambda x: x)

    return F.coalesce((version == 2) & good(current) & good(forecast), F.lit(False))
