import json

import pytest

from tessera import __main__ as command
from tessera.functions import tiles
from tessera.operators.feed import FeedError
from tessera.sources import files, gpkg
from tests.test_feed import ROWS, body, catalogue
from tests.test_geometry import box


def test_publish_keeps_the_last_valid_state(spark, tmp_path):
    state, feed, situations = str(tmp_path / "state"), tmp_path / "feed.json", tmp_path / "cat.json"
    situations.write_text(json.dumps({"SITUACION": catalogue()}))
    feed.write_text(body())
    assert command.publish(spark, str(feed), str(situations), state) == "published"
    # another situation of the same level is the same snapshot
    feed.write_text(body([(z, 2 if z == 53 else s, n) for z, s, n in ROWS]))
    assert command.publish(spark, str(feed), str(situations), state) == "unchanged"
    feed.write_text(body([(z, 99, n) for z, s, n in ROWS]))
    with pytest.raises(FeedError) as error:
        command.publish(spark, str(feed), str(situations), state)
    assert error.value.code == "UNKNOWN_CURRENT_SITUATION" and spark.read.parquet(state).count() == 1
    feed.write_text(body([(z, s, 4 if z == 53 else n) for z, s, n in ROWS]))
    assert command.publish(spark, str(feed), str(situations), state) == "published" and spark.read.parquet(state).count() == 2


def test_tiles_and_inventory_commands(spark, tmp_path, capsys):
    span = tiles.WORLD / 2**8
    left, top = -tiles.HALF_WORLD + 126 * span, tiles.HALF_WORLD - 97 * span
    rows = [([[box(left + 0.2 * span, top - 0.8 * span, left + 0.8 * span, top - 0.2 * span)]], 53)]
    gpkg.write_layer(rows, str(tmp_path / "z.gpkg"), "zones", 3857, [("zone_id", "INTEGER")], "2026-07-18T00:00:00Z")
    assert command.main(["tiles", str(tmp_path / "z.gpkg"), "zones", str(tmp_path / "out"), "8"]) == 0
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r["z"], r["x"], r["y"]) for r in got] == [(8, 126, 97)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "97.png").write_bytes(bytes(got[0]["content"]))
    (tmp_path / "list").write_text(f"{got[0]['sha256']}  97.png\n")
    assert command.main(["inventory", str(tmp_path / "list"), str(tmp_path / "files")]) == 0
    (tmp_path / "files" / "98.png").write_bytes(b"x")
    assert command.main(["inventory", str(tmp_path / "list"), str(tmp_path / "files")]) == 1
    assert "extra  98.png" in capsys.readouterr().out
    assert files.binaries(spark, str(tmp_path / "files"), content=False).columns == ["path", "length"]
    assert command.main([]) == 2
