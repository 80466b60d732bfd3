import json

import pytest
from pyspark.sql import functions as F

from tessera.functions import feed as f
from tessera.operators import feed, state

ROWS = [(59, 9, 4), (53, 1, 1), (57, 5, 5), (55, 3, 3), (58, 7, 7), (54, 2, 2), (56, 4, 4)]


def body(rows=ROWS, time="2026-07-18 00:01:41.0", **more):
    return json.dumps({"time": time, "z1": [dict(zip(("id", "nact", "npre"), r)) for r in rows], "desEs": "<p>x</p>"} | more)


def catalogue(**change):
    rows = [{"ID_SITUACION": 10, "ID_AVISO": 1, "ACTIVO": "S"}, {"ID_SITUACION": 14, "ID_AVISO": 2, "ACTIVO": "S"}]
    return rows + [{"ID_SITUACION": i, "ID_AVISO": 3, "ACTIVO": "S"} | change.get(str(i), {}) for i in range(1, 10)]


def docs(spark, *bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "doc long, body string")


def codes(violations):
    return {r["doc"]: r["code"] for r in violations.collect()}


def test_feed_to_levels_and_snapshot(spark):
    zones, bad = feed.read_zones(docs(spark, body()))
    situations, wrong = feed.read_catalogue(docs(spark, json.dumps({"SITUACION": catalogue()})))
    assert bad.count() == wrong.count() == 0
    out = feed.normalise(zones, situations)
    rows = {r["zone_id"]: r for r in out.collect()}
    assert [rows[z]["level"] for z in f.ZONES] == [1, 1, 1, 2, 2, 3, 3]
    assert [rows[z]["forecast_level"] for z in f.ZONES] == [1, 1, 1, 2, 2, 3, 2]
    assert {r["forecast_date"] for r in rows.values()} == {"2026-07-19"}
    assert rows[58]["forest_access"] == "closed_by_mvp_rule"
    assert feed.unresolved(out).count() == 0
    snap = feed.snapshots(out).collect()[0]
    assert snap["source_date"] == "2026-07-18" and snap["snapshot_id"].startswith("sha256:")


def test_published_snapshot_vector(spark):
    levels = [(53, 2), (54, 2), (55, 2), (56, 3), (57, 2), (58, 3), (59, 2)]
    zones = F.array(*[F.struct(F.lit(z).alias("zone_id"), F.lit(v).alias("level")) for z, v in levels])
    got = spark.range(1).select(f.snapshot_id(F.lit("2026-07-18"), zones).alias("s")).collect()[0]["s"]
    assert got == "sha256:2542366c8bfa830253174262d41d7855d64f36a2e85cdc47e7ccde45fa308588"


def test_feed_violations(spark):
    cases = {
        "DUPLICATE_ZONE_ID": body([(53, 1, 1) if r[0] == 54 else r for r in ROWS]),
        "INVALID_ZONE_SET": body([(60, 2, 2) if r[0] == 54 else r for r in ROWS]),
        "INVALID_SOURCE_TIMESTAMP": body(time="2026-02-30 00:00:00"),
    }
    bodies = [*cases.values(), body(ROWS[:-1]), body(time=None), body([("53", 1, 1), *ROWS]), body([(53.0 if r[0] == 53 else r[0], r[1], r[2]) for r in ROWS]), body([(True, 1, 1), *ROWS]), "not json", "{}"]
    _, bad = feed.read_zones(docs(spark, *bodies))
    got = codes(bad)
    assert [got[i] for i in range(3)] == list(cases)
    assert got[3] == "INVALID_ZONE_SET" and got[4] == got[5] == got[7] == got[8] == got[9] == "INVALID_REQUIRED_FIELD"
    assert 6 not in got


def test_unknown_situations_come_current_first(spark):
    zones, _ = feed.read_zones(docs(spark, body([(z, 99 if z == 57 else s, 99 if z == 59 else n) for z, s, n in ROWS]), body([(z, s, 99 if z == 54 else n) for z, s, n in ROWS])))
    levels = spark.range(1, 10).select(F.col("id").alias("situation_id"), f.level(F.col("id")).alias("level"))
    got = codes(feed.unresolved(feed.normalise(zones, levels)))
    assert got == {0: "UNKNOWN_CURRENT_SITUATION", 1: "UNKNOWN_FORECAST_SITUATION"}


def test_catalogue_violations(spark):
    cases = [
        ("SITUATION_WRONG_ADVISORY", catalogue(**{"5": {"ID_AVISO": 1}})), ("SITUATION_INACTIVE", catalogue(**{"8": {"ACTIVO": "N"}})),
        ("UNKNOWN_SITUATION_ID", [*catalogue(), {"ID_SITUACION": 99, "ID_AVISO": 3, "ACTIVO": "S"}]), ("DUPLICATE_SITUATION_ID", [*catalogue(), {"ID_SITUACION": 3, "ID_AVISO": 3, "ACTIVO": "S"}]),
        ("INVALID_SITUATION_CATALOG", [r for r in catalogue() if r["ID_SITUACION"] != 2]), ("INVALID_REQUIRED_FIELD", catalogue(**{"1": {"ACTIVO": None}})),
    ]
    _, bad = feed.read_catalogue(docs(spark, *[json.dumps({"SITUACION": c}) for _, c in cases]))
    assert [codes(bad)[i] for i in range(len(cases))] == [c for c, _ in cases]
    with pytest.raises(feed.FeedError) as error:
        feed.require_valid(bad)
    assert error.value.code == "SITUATION_WRONG_ADVISORY"


def test_dates(spark):
    rows = spark.createDataFrame([("2026-02-28", "2026-01-10 22:59:59.999"), ("2026-12-31", "2026-01-10 23:00:00"), ("2024-02-28", "2026-07-10 21:59:59.999"), ("2026-07-18", "2026-07-10 22:00:00")], "d string, t string")
    got = rows.select(f.next_date(F.col("d")).alias("n"), f.local_date(F.to_timestamp("t")).alias("l")).collect()
    assert [r["n"] for r in got] == ["2026-03-01", "2027-01-01", "2024-02-29", "2026-07-19"]
    assert [r["l"] for r in got] == ["2026-01-10", "2026-01-11", "2026-07-10", "2026-07-11"]
    texts = ["2026-07-18 00:01:41.0", "2026-07-18 00:01:41", "0050-01-01 00:00:00", "2026-07-18 24:00:00", "2026-07-18 00:00:60", "2026-07-18 00:00:00.1234", "2026-07-18 00:00:00\n", "2026-02-29 00:00:00", None]
    ok = spark.createDataFrame([(t,) for t in texts], "t string").select(f.valid_local_timestamp(F.col("t")).alias("v")).collect()
    assert [r["v"] for r in ok] == [True, True, False, False, False, False, False, False, False]


def test_state_versions_and_tile_states(spark):
    now = F.to_timestamp(F.lit("2026-07-18 08:00:00"))
    zones, _ = feed.read_zones(docs(spark, body()))
    situations = spark.range(1, 10).select(F.col("id").alias("situation_id"), f.level(F.col("id")).alias("level"))
    snap = feed.snapshots(feed.normalise(zones, situations))
    full = snap.select(
        F.lit(1).alias("key"), F.lit(2).alias("version"), F.lit("2026-07-18 00:01:41.0").alias("source_time"), F.lit("2026-07-18T08:00:01.000Z").alias("retrieved_at"),
        F.array(F.lit("2026-07-18T08:00:00.000Z"), F.lit("2026-07-18T08:00:01.000Z")).alias("source_times"), "current", "forecast", F.lit("2026-07-19").alias("forecast_date"), "snapshot_id",
    )
    other = full.withColumn("version", F.lit(3)).union(full.withColumn("snapshot_id", F.lit("sha256:0"))).union(full.withColumn("current", F.reverse("current"))).union(full.withColumn("source_time", F.lit("2026-07-19 00:00:00")))
    assert [r["code"] for r in state.violations(full.union(other)).collect()] == [None, "INCOMPATIBLE_SCHEMA_VERSION", "INVALID_PERSISTED_STATE", "INVALID_PERSISTED_STATE", "INVALID_PERSISTED_STATE"]
    tile = state.tile_states(full, now, F.lit("forecast_next_day")).collect()[0]
    assert not tile["stale"] and tile["valid_date"] == "2026-07-19" and tile["style"] == "forecast_hatch" and tile["colors"][5] == [0xE8, 0x3D, 0x35]
    old = state.tile_states(full.withColumn("forecast", F.lit(None).cast(full.schema["forecast"].dataType)), F.to_timestamp(F.lit("2026-07-20 08:00:00")), F.lit("forecast_next_day")).collect()[0]
    assert old["stale"] and old["cache_tag"] == "unavailable:forecast_next_day:2026-07-20" and old["colors"] == [[128, 128, 128]] * 7


def test_outcomes_match_as_stream(spark, tmp_path):
    from tessera.streaming import publish

    rows = [(k, i, "abc"[(i + k) // 4 % 3]) for k in range(4) for i in range(30)]
    held = spark.createDataFrame(rows, "key long, seq long, snapshot string")
    batch = {(r["key"], r["seq"]): r["outcome"] for r in state.outcomes(held, ["key"], ["seq"], "snapshot").collect()}
    for part, (a, b) in enumerate(((0, 12), (12, 30))):
        held.where(f"seq >= {a} and seq < {b}").write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema(held.schema).parquet(str(tmp_path / "in"))
        publish.run_available(stream, str(tmp_path / "state"), str(tmp_path / "out"))
    got = {(r["key"], r["seq"]): r["outcome"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == batch and set(batch.values()) == {"published", "unchanged"}
