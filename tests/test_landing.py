"""Sources with limits, contracts of files, artifacts, gates."""

import datetime
import http.server
import json
import os
import threading

import pytest
from pyspark.sql import functions as F

from tessera.operators import gates
from tessera.sources import files, geojson, gpkg, http as sources, sinks

NOW = datetime.datetime(2024, 5, 1, 10, 0, 0, 250_000, datetime.timezone.utc)


def answers(*given):
    left = list(given)

    def fetch(url, timeout):
        got = left.pop(0)
        if isinstance(got, Exception):
            raise got
        return got

    return fetch, left


@pytest.mark.parametrize("given, code", [
    ([(200, "application/json; charset=utf-8", "u2", b'{"a":1}')], None),
    ([(503, "", "u", b""), (200, "application/json", "u2", b"[]")], None),
    ([TimeoutError(), (200, "Application/JSON", "u2", b"1")], None),
    ([TimeoutError(), TimeoutError()], "SOURCE_TIMEOUT"),
    ([ConnectionResetError(), OSError()], "SOURCE_NETWORK_ERROR"),
    ([(429, "", "u", b""), (500, "", "u", b"")], "SOURCE_HTTP_STATUS"),
    ([(404, "", "u", b"")], "SOURCE_HTTP_STATUS"),
    ([(200, "text/html", "u", b"{}")], "SOURCE_CONTENT_TYPE"),
    ([(200, "application/json", "u", b"{")], "SOURCE_INVALID_JSON"),
    ([(200, "application/json", "u", b"\xff")], "SOURCE_INVALID_JSON"),
])
def test_documents_are_tried_again(given, code):
    fetch, left = answers(*given)
    waits = []
    if code is None:
        got = sources.document("feed", "u", fetch, lambda: NOW, waits.append)
        assert (got.attempts, got.requested_url, got.response_url, got.retrieved_at) == (len(given), "u", "u2", "2024-05-01T10:00:00.250Z")
    else:
        with pytest.raises(sources.SourceError) as error:
            sources.document("feed", "u", fetch, lambda: NOW, waits.append)
        assert (error.value.code, error.value.source) == (code, "feed")
    assert not left and waits == [0.2] * (len(given) - 1)


class Pages(http.server.BaseHTTPRequestHandler):
    def do_GET(self):
        self.send_response(404 if self.path == "/none" else 200)
        self.send_header("Content-Type", "application/json")
        self.end_headers()
        self.wfile.write({"/json": b'{"a":1}', "/long": b"x" * 5000}.get(self.path, b""))

    def log_message(self, *args):
        pass


@pytest.fixture
def server():
    own = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Pages)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()


def test_files_are_downloaded_within_limits(server, tmp_path):
    target = str(tmp_path / "a.json")
    got = sources.download(f"{server}/json", target, 1000)
    assert got["size_bytes"] == 7 and open(target, "rb").read() == b'{"a":1}' and got["content_type"] == "application/json"
    for path, code in (("long", "SOURCE_TOO_LARGE"), ("empty", "SOURCE_EMPTY")):
        with pytest.raises(sources.SourceError, match=code):
            sources.download(f"{server}/{path}", str(tmp_path / "b"), 1000)
    assert os.listdir(tmp_path) == ["a.json"]
    assert sources.document("x", f"{server}/json").body == '{"a":1}'
    with pytest.raises(sources.SourceError, match="SOURCE_HTTP_STATUS"):
        sources.document("x", f"{server}/none")


def test_json_arrays_are_strict(spark, tmp_path):
    fields = {"a": "int", "b": "string"}

    def read(name, text):
        (tmp_path / name).write_text(text)
        return files.json_array(spark, str(tmp_path / name), fields)

    assert [(r["index"], r["a"], r["b"]) for r in read("good", '[\n {"a": 1.0, "b": "x", "c": 2},\n {"b": "y", "a": 2}\n]').collect()] == [(0, 1, "x"), (1, 2, "y")]
    assert read("empty", "[]").collect() == []
    for name, text, problem in (("object", "{}", "no array"), ("cut", "[", "no array"), ("type", '[{"a":1,"b":"x"},{"a":"1","b":"x"}]', "row 1, field a"), ("lack", '[{"a":1}]', "row 0, field b"), ("row", "[1]", "row 0, field a")):
        with pytest.raises(files.ContractError, match=problem):
            read(name, text)


def test_documents_are_whole(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n"a":\n1}\n')
    assert [r["body"] for r in files.documents(spark, str(tmp_path)).collect()] == ['{\n"a":\n1}\n']


def test_configurations_and_inventories(spark, tmp_path):
    assert files.config('{"schema_version": 1, "a": 2}', 1, ["a"], exact=True)["a"] == 2
    for body, exact in (("{", False), ("[]", False), ('{"schema_version": true, "a": 1}', False), ('{"schema_version": 1}', False), ('{"schema_version": 1, "a": 1, "b": 1}', True)):
        with pytest.raises(files.ContractError):
            files.config(body, 1, ["a"], exact)
    (tmp_path / "list").write_text("0" * 64 + "  a\n")
    assert files.inventory(spark, str(tmp_path / "list"), lines=1).count() == 1
    with pytest.raises(files.ContractError, match="1 lines"):
        files.inventory(spark, str(tmp_path / "list"), lines=2)


def test_artifacts(spark, tmp_path):
    made = {"a/x.json": sinks.json_bytes({"b": 1}), "y.txt": b"y"}
    assert set(sinks.build(made, str(tmp_path))) == set(made) and sinks.validate(made, str(tmp_path)) == []
    assert sinks.validate(made | {"y.txt": b"z", "w": b""}, str(tmp_path)) == ["y.txt", "w"]
    for others in (0, 90, 9_960, 10**12):
        data = sinks.self_sized({"name": "x"}, others)
        assert json.loads(data)["total_bytes"] == others + len(data)
    target = str(tmp_path / "tiles")
    sinks.swap_folder(target, lambda f: open(f"{f}/1.png", "wb").close())
    assert os.listdir(target) == ["1.png"]
    with pytest.raises(FileExistsError):
        sinks.swap_folder(target, lambda f: None)
    with pytest.raises(ZeroDivisionError):
        sinks.swap_folder(str(tmp_path / "other"), lambda f: 1 / 0)
    assert sorted(os.listdir(tmp_path)) == ["a", "tiles", "y.txt"]
    rows = spark.range(2000).select((F.col("id") * 7 % 2000).alias("k"), F.lit('a"b').alias("t"))
    sinks.write_csv(rows, ["k", "t"], ["k"], str(tmp_path / "csv"))
    parts = sorted(p for p in os.listdir(tmp_path / "csv") if p.startswith("part"))
    lines = [x for p in parts for x in (tmp_path / "csv" / p).read_text().splitlines()[1:]]
    assert lines == [f'{k},"a""b"' for k in range(2000)]


def test_gates_stop_at_the_first_problem(spark):
    built = []

    def stage(name, n):
        return name, lambda: built.append(name) or spark.range(n)

    assert gates.run([stage("a", 0), stage("b", 0)]) == ["a", "b"]
    with pytest.raises(gates.GateError, match="d: "):
        gates.run([stage("c", 0), stage("d", 2), stage("e", 0)])
    assert built == ["a", "b", "c", "d"]


def test_layers_are_recorded(spark, tmp_path):
    path = str(tmp_path / "a.gpkg")
    square = [[[(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 0.0)]]]
    gpkg.write_layer([(square, 2, "b"), (square, 1, "a")], path, "zones", 25830, [("code", "INTEGER"), ("name", "TEXT")], "2024-01-01T00:00:00.000Z")
    assert gpkg.record(path, "zones", 25830, ("code",)) == {"problems": [], "layer": "zones", "rows": 2, "columns": ["fid", "geom", "code", "name"], "srs_id": 25830}
    assert [tuple(r) for r in gpkg.attributes(spark, path, "zones", ["code", "name"], "code", 2).collect()] == [(1, "a"), (2, "b")]
    with pytest.raises(ValueError, match="expected 3"):
        gpkg.attributes(spark, path, "zones", ["code", "name"], "code", 3)
    (tmp_path / "b.gpkg").write_bytes(b"no database at all")
    assert gpkg.record(str(tmp_path / "b.gpkg"), "zones", 25830, ()) == {"problems": ["magic"]}


def test_collections_hold_their_contract():
    own = {"type": "FeatureCollection", "bbox": [0, 0, 1, 1], "features": [{"id": i, "bbox": [0, 0, 1, 1]} for i in (53, 54)]}
    assert geojson.contract(own, [53, 54]) == []
    assert geojson.contract(own | {"type": "x", "crs": None, "bbox": []}, [54, 53]) == ["type", "crs", "ids", "bbox"]


def test_cycles_keep_the_last_state():
    from tessera.streaming import publish

    logged, states = [], []
    assert publish.cycle(lambda: 5, lambda v: states.append(v) or "published", logged.append) == "published"
    assert publish.cycle(lambda: publish.paired(lambda: 1, lambda: 1 / 0), states.append, logged.append) == "failed"
    fetch, _ = answers((404, "", "u", b""))
    assert publish.cycle(lambda: sources.document("feed", "u", fetch), states.append, logged.append) == "failed"
    assert states == [5] and [e.get("code") for e in logged] == [None, "UNEXPECTED_ERROR", "SOURCE_HTTP_STATUS"]
    assert publish.paired(lambda: 1, lambda: "b") == (1, "b")


def test_local_commands(server, tmp_path, capsys):
    import numpy as np

    from tessera import __main__ as command
    from tessera.functions import png

    assert command.main(["download", f"{server}/json", str(tmp_path / "a"), "100"]) == 0 and '"size_bytes": 7' in capsys.readouterr().out
    assert command.main(["download", f"{server}/long", str(tmp_path / "b"), "100"]) == 1 and "SOURCE_TOO_LARGE" in capsys.readouterr().err
    assert command.main(["inspect", str(tmp_path / "a"), "zones", "25830"]) == 1 and "magic" in capsys.readouterr().out
    (tmp_path / "t.png").write_bytes(png.encode(np.zeros((256, 256), np.uint8), bytes(48)))
    assert command.main(["recolor", str(tmp_path / "t.png"), str(tmp_path / "u.png"), *["#0A0B0C"] * 7]) == 0
    assert png.check((tmp_path / "u.png").read_bytes())[b"PLTE"][3:6] == bytes([10, 11, 12])
    assert command.main(["recolor", str(tmp_path / "t.png"), str(tmp_path / "v.png"), "0A0B0C"]) == 1 and command.main([]) == 2
