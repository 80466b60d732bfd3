import json

import pytest
from pyspark.sql import functions as F

from tessera.sources import files, sinks


def test_control_table_keeps_text_and_header(spark, tmp_path):
    path = tmp_path / "r.csv"
    path.write_text("name,code,note\nAdemuz,00001,\nAlfarp,00003,\"a,b\"\n")
    rows = files.control_table(spark, str(path), ["name", "code", "note"]).collect()
    assert [tuple(r) for r in rows] == [("Ademuz", "00001", ""), ("Alfarp", "00003", "a,b")]
    with pytest.raises(files.ContractError):
        files.control_table(spark, str(path), ["code", "name", "note"])
    assert files.control_table(spark, str(path), ["note", "code"], exact=False).columns == ["note", "code"]


def test_inventory_and_binaries(spark, tmp_path):
    (tmp_path / "t" / "6").mkdir(parents=True)
    (tmp_path / "t" / "6" / "a.png").write_bytes(b"abc")
    got = files.binaries(spark, str(tmp_path / "t")).collect()[0]
    assert (got["path"], got["length"]) == ("6/a.png", 3)
    listing = tmp_path / "inv.txt"
    listing.write_text(f"{got['sha256']}  6/a.png\n")
    assert [tuple(r) for r in files.inventory(spark, str(listing)).collect()] == [(got["sha256"], "6/a.png")]
    listing.write_text(f"{got['sha256']} 6/a.png\n")
    with pytest.raises(files.ContractError):
        files.inventory(spark, str(listing))


def test_zip_members(spark):
    content = sinks.zip_bytes([("items.json", b"{}"), ("icons/a.png", b"x" * 100)])
    assert content == sinks.zip_bytes([("items.json", b"{}"), ("icons/a.png", b"x" * 100)])
    spark.udtf.register("zip_members", files.zip_members())
    spark.createDataFrame([(content,), (b"no zip",)], "c binary").createOrReplaceTempView("zips")
    got = [(r["seq"], r["name"], r["problem"]) for r in spark.sql("SELECT m.* FROM zips, LATERAL zip_members(c, 50) m").collect()]
    assert sorted(got, key=str) == sorted([(0, "items.json", None), (1, "icons/a.png", "too_large"), (-1, None, "not_a_zip")], key=str)


def test_promote_once(spark, tmp_path):
    rows = spark.createDataFrame([("a", b"1"), ("a", b"1"), ("b", b"2")], "source string, content binary")
    root = str(tmp_path / "snapshots")
    assert sorted(r["new"] for r in sinks.promote(rows, root).collect()) == [True, True]
    assert sorted(r["new"] for r in sinks.promote(rows, root).collect()) == [False, False]
    assert spark.read.parquet(root).count() == 2


def test_artifacts(spark, tmp_path):
    sinks.atomic_write(str(tmp_path / "x.json"), sinks.json_bytes({"b": 1, "a": "é"}))
    assert (tmp_path / "x.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n' and [p.name for p in tmp_path.iterdir()] == ["x.json"]
    with pytest.raises(ValueError):
        sinks.json_bytes({"a": float("nan")})
    rows = spark.createDataFrame([("b", None), ("a", 1)], "k string, v long")
    assert sinks.csv_bytes(rows, ["k", "v"], ["k"]) == b"k,v\na,1\nb,\n"
    with pytest.raises(ValueError):
        sinks.csv_bytes(rows, ["k"], ["k"])


def test_json_rows_fail_fast(spark, tmp_path):
    path = tmp_path / "m.json"
    path.write_text(json.dumps([{"a": "x", "z": 53}, {"a": "y", "z": 54}]))
    assert files.json_rows(spark, str(path), "a string, z int").agg(F.sum("z")).collect()[0][0] == 107
    path.write_text(json.dumps([{"a": "x", "z": "oops"}]))
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|parse"):
        files.json_rows(spark, str(path), "a string, z int").collect()
