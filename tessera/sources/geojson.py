"""GeoJSON feature collections: one feature a row, a driver-side file for a few zones, and the contract both hold to."""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import geometry as g


def rounded(value: float, digits: int) -> float:
    """Rounded as Python rounds, half to even on the binary value, without a negative zero."""
    return round(value, digits) + 0.0


def feature(key: Column, parts: Column, properties: Column, digits: int = 9) -> Column:
    """A Feature as compact JSON: id, bbox, MultiPolygon in rounded degrees, properties (a JSON object as text)."""

    @F.arrow_udf("string")
    def write(ids: pa.Array, shapes: pa.Array, given: pa.Array) -> pa.Array:
        out = []
        for i, shape, own in zip(ids.to_pylist(), shapes.to_pylist(), given.to_pylist(), strict=True):
            rings = [[[[rounded(p["x"], digits), rounded(p["y"], digits)] for p in ring] for ring in part] for part in shape]
            flat = [p for part in rings for ring in part for p in ring]
            box = [min(p[0] for p in flat), min(p[1] for p in flat), max(p[0] for p in flat), max(p[1] for p in flat)]
            out.append(json.dumps({"type": "Feature", "id": i, "bbox": box, "geometry": {"type": "MultiPolygon", "coordinates": rings}, "properties": json.loads(own)}, ensure_ascii=False, separators=(",", ":")))
        return pa.array(out, pa.string())

    return write(key, parts, properties)


def collection(features: DataFrame, key: str, column: str, most: int = 1000) -> bytes:
    """A FeatureCollection of a few features in order of key, with the overall bbox and no crs; more than `most` are an error: write_lines
    takes any number."""
    rows = features.select(key, column).orderBy(key).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError("too many features for one file")
    held = [json.loads(r[column]) for r in rows]
    boxes = [f["bbox"] for f in held]
    box = [min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)] if boxes else []
    return (json.dumps({"type": "FeatureCollection", "bbox": box, "features": held}, ensure_ascii=False, separators=(",", ":")) + "\n").encode()


def violations(shapes: DataFrame, key: str, parts: str) -> DataFrame:
    """key and problem of shapes in degrees: range, not_finite, open_ring, short_ring, shell_clockwise, hole_counter_clockwise."""
    rings = shapes.select(key, F.posexplode(parts).alias("part", "rings")).select(key, "part", F.posexplode("rings").alias("ring", "r"))
    points = F.col("r")
    area = g.signed_area(points)
    finite = F.forall(points, lambda p: ~(F.isnan(p["x"]) | F.isnan(p["y"])) & (F.abs(p["x"]) < float("inf")) & (F.abs(p["y"]) < float("inf")))
    inside = F.forall(points, lambda p: p["x"].between(-180.0, 180.0) & p["y"].between(-90.0, 90.0))
    problem = (
        F.when(F.size(points) < 4, "short_ring").when(~finite, "not_finite").when(~inside, "range").when(points[0] != F.element_at(points, -1), "open_ring")
        .when((F.col("ring") == 0) & (area <= 0), "shell_clockwise").when((F.col("ring") > 0) & (area >= 0), "hole_counter_clockwise")
    )
    return rings.select(key, "part", "ring", problem.alias("problem")).where("problem is not null")


def write_lines(features: DataFrame, key: str, column: str, path: str) -> None:
    """Any number of features as GeoJSON lines, in parts whose names sort as the keys do."""
    features.select(key, column).repartitionByRange(key).sortWithinPartitions(key).select(column).write.text(path)


def contract(document: dict, ids: list[int]) -> list[str]:
    """What a FeatureCollection breaks: its type, an own reference system, the features' ids and their order, bounding boxes."""
    wrong = [] if document.get("type") == "FeatureCollection" else ["type"]
    if "crs" in document:
        wrong.append("crs")
    features = document.get("features") or []
    if [f.get("id") for f in features] != ids:
        wrong.append("ids")
    if any(len(f.get("bbox") or []) != 4 for f in features) or len(document.get("bbox") or []) != 4:
        wrong.append("bbox")
    return wrong
