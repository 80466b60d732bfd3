"""Batch data source over SQLite and GeoPackage files, read-only, split by ranges of rowid.

Options: path, table, columns (comma-separated, in order), partitions. Register with spark.dataSource.register(GeoPackageSource).
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

# Spark types of declared SQL types; geometry columns are blobs.
TYPES = {"INTEGER": "bigint", "INT": "bigint", "MEDIUMINT": "bigint", "SMALLINT": "bigint", "TINYINT": "bigint", "BOOLEAN": "boolean", "REAL": "double", "DOUBLE": "double", "FLOAT": "double", "TEXT": "string", "DATE": "string", "DATETIME": "string"}
APPLICATION_ID = 0x47504B47
CATALOGUE = ("gpkg_spatial_ref_sys", "gpkg_contents", "gpkg_geometry_columns")


def connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def quote(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def columns(path: str, table: str) -> dict[str, str]:
    """Declared columns of a table and their Spark types."""
    with connect(path) as db:
        rows = db.execute(f"PRAGMA table_info({quote(table)})").fetchall()
    if not rows:
        raise ValueError(f"no table {table}")
    return {r[1]: TYPES.get(r[2].upper().partition("(")[0], "binary") for r in rows}


def inspect(path: str, layer: str, srs: int, required: tuple[str, ...]) -> list[str]:
    """What is wrong with a GeoPackage layer: file, catalogue tables, its entry, reference system and columns."""
    wrong = []
    with connect(path) as db:
        if db.execute("PRAGMA integrity_check").fetchone()[0] != "ok":
            wrong.append("integrity")
        if db.execute("PRAGMA application_id").fetchone()[0] != APPLICATION_ID:
            wrong.append("application_id")
        there = {r[0] for r in db.execute("SELECT name FROM sqlite_master WHERE type = 'table'")}
        wrong += [f"table:{t}" for t in (*CATALOGUE, layer) if t not in there]
        if not wrong:
            if db.execute("SELECT count(*) FROM gpkg_contents WHERE table_name = ? AND data_type = 'features' AND srs_id = ?", (layer, srs)).fetchone()[0] != 1:
                wrong.append("contents")
            if db.execute("SELECT count(*) FROM gpkg_geometry_columns WHERE table_name = ? AND geometry_type_name = 'MULTIPOLYGON' AND srs_id = ?", (layer, srs)).fetchone()[0] != 1:
                wrong.append("geometry_columns")
            if db.execute("SELECT count(*) FROM gpkg_spatial_ref_sys WHERE srs_id = ?", (srs,)).fetchone()[0] != 1:
                wrong.append("spatial_ref_sys")
    if f"table:{layer}" not in wrong:
        wrong += [f"column:{c}" for c in required if c not in columns(path, layer)]
    return wrong


def is_sqlite(path: str) -> bool:
    """Whether a file begins as SQLite files do."""
    with open(path, "rb") as held:
        return held.read(16) == b"SQLite format 3\0"


def record(path: str, layer: str, srs: int, required: tuple[str, ...]) -> dict[str, object]:
    """What an inspection found: problems, rows, columns and reference system of a layer; a file that is no SQLite has nothing else."""
    if not is_sqlite(path):
        return {"problems": ["magic"]}
    wrong = inspect(path, layer, srs, required)
    if wrong:
        return {"problems": wrong}
    with connect(path) as db:
        rows = db.execute(f"SELECT count(*) FROM {quote(layer)}").fetchone()[0]
    return {"problems": [], "layer": layer, "rows": rows, "columns": list(columns(path, layer)), "srs_id": srs}


def attributes(spark, path: str, layer: str, names: list[str], code: str, count: int):
    """The named columns of a layer in order of its code; another number of rows, a blank value or a code twice is a ValueError."""
    from pyspark.sql import functions as F

    spark.dataSource.register(GeoPackageSource)
    rows = spark.read.format("gpkg").option("path", path).option("table", layer).option("columns", ",".join(names)).load()
    blank = [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(c) for c in names]
    found = rows.agg(F.count(F.lit(1)).alias("_n"), F.count_distinct(code).alias("_codes"), *blank).head()
    if found["_n"] != count or found["_codes"] != count or any(found[c] for c in names):
        raise ValueError(f"{found['_n']} rows, {found['_codes']} codes, expected {count}; blank: {[c for c in names if found[c]]}")
    return rows.orderBy(code)


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        self.low, self.high = low, high


class _Reader(DataSourceReader):
    def __init__(self, path: str, table: str, names: list[str], parts: int):
        self.path, self.table, self.names, self.parts = path, table, names, parts

    def partitions(self) -> list[InputPartition]:
        with connect(self.path) as db:
            low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {quote(self.table)}").fetchone()
        if low is None:
            return [_Range(0, 0)]
        step = max(1, -(-(high - low + 1) // self.parts))
        return [_Range(a, a + step) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        own = ", ".join(map(quote, self.names))
        with connect(self.path) as db:
            yield from db.execute(f"SELECT {own} FROM {quote(self.table)} WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))


class GeoPackageSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def _names(self) -> list[str]:
        declared = columns(self.options["path"], self.options["table"])
        asked = [c.strip() for c in self.options["columns"].split(",")] if "columns" in self.options else list(declared)
        if missing := [c for c in asked if c not in declared]:
            raise ValueError(f"no columns {missing}")
        return asked

    def schema(self) -> str:
        declared = columns(self.options["path"], self.options["table"])
        return ", ".join(f"`{c}` {declared[c]}" for c in self._names())

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self.options["table"], [f.name for f in schema.fields], int(self.options.get("partitions", "8")))


def write_layer(rows: list[tuple], path: str, layer: str, srs: int, fields: list[tuple[str, str]], timestamp: str) -> None:
    """A GeoPackage with one MULTIPOLYGON layer from a few collected rows (geometry parts, then the fields' values).

    fields: (name, SQL type). The bytes follow from the rows and the timestamp: fixed page size, vacuumed. The file must not exist.
    """
    import os
    import struct

    from ..functions.geometry import encode_wkb

    if os.path.exists(path):
        raise FileExistsError(path)
    flat = [p for shape, *_ in rows for part in shape for ring in part for p in ring]
    box = (min(x for x, _ in flat), min(y for _, y in flat), max(x for x, _ in flat), max(y for _, y in flat)) if flat else (None,) * 4
    with sqlite3.connect(path) as db:
        db.executescript(f"""
            PRAGMA page_size = 4096; PRAGMA application_id = {APPLICATION_ID}; PRAGMA user_version = 10300;
            CREATE TABLE gpkg_spatial_ref_sys (srs_name TEXT NOT NULL, srs_id INTEGER PRIMARY KEY, organization TEXT NOT NULL, organization_coordsys_id INTEGER NOT NULL, definition TEXT NOT NULL, description TEXT);
            CREATE TABLE gpkg_contents (table_name TEXT PRIMARY KEY, data_type TEXT NOT NULL, identifier TEXT, description TEXT, last_change DATETIME NOT NULL, min_x DOUBLE, min_y DOUBLE, max_x DOUBLE, max_y DOUBLE, srs_id INTEGER);
            CREATE TABLE gpkg_geometry_columns (table_name TEXT PRIMARY KEY, column_name TEXT NOT NULL, geometry_type_name TEXT NOT NULL, srs_id INTEGER NOT NULL, z TINYINT NOT NULL, m TINYINT NOT NULL);
        """)
        db.execute("INSERT INTO gpkg_spatial_ref_sys VALUES (?, ?, 'EPSG', ?, 'undefined', NULL)", (f"EPSG:{srs}", srs, srs))
        db.execute("INSERT INTO gpkg_contents VALUES (?, 'features', ?, '', ?, ?, ?, ?, ?, ?)", (layer, layer, timestamp, *box, srs))
        db.execute("INSERT INTO gpkg_geometry_columns VALUES (?, 'geom', 'MULTIPOLYGON', ?, 0, 0)", (layer, srs))
        declared = "".join(f", {quote(n)} {t}" for n, t in fields)
        db.execute(f"CREATE TABLE {quote(layer)} (fid INTEGER PRIMARY KEY, geom MULTIPOLYGON{declared})")
        marks = ", ".join("?" * (len(fields) + 1))
        names = ", ".join(["geom", *[quote(n) for n, _ in fields]])
        db.executemany(f"INSERT INTO {quote(layer)} ({names}) VALUES ({marks})", [(b"GP\0\1" + struct.pack("<i", srs) + encode_wkb(shape), *own) for shape, *own in rows])
    with sqlite3.connect(path) as db:
        db.execute("VACUUM")
