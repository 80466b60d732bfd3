"""Multipolygons as array<array<array<struct<x,y>>>> (parts, rings, vertices) and columns over them."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

POINT = T.StructType([T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])
RING = T.ArrayType(POINT)
MULTIPOLYGON = T.ArrayType(T.ArrayType(RING))
#: Bytes of the envelope that follows the header, by the flags' indicator.
ENVELOPE = (0, 32, 48, 48, 64)


class GeometryError(ValueError):
    """A blob that isn't the geometry it should be."""


def decode_blob(blob: bytes, srs: int) -> list[list[list[tuple[float, float]]]]:
    """A GeoPackage geometry blob with a MULTIPOLYGON of this reference system as parts of rings of vertices."""
    if len(blob) < 8 or blob[:2] != b"GP" or blob[2] != 0:
        raise GeometryError("not a GeoPackage geometry")
    flags = blob[3]
    kind = flags >> 1 & 7
    if flags & 0x20 or flags & 0x10 or kind >= len(ENVELOPE):
        raise GeometryError("extended, empty or malformed geometry")
    if struct.unpack_from("<i" if flags & 1 else ">i", blob, 4)[0] != srs:
        raise GeometryError("other reference system")
    return decode_wkb(memoryview(blob)[8 + ENVELOPE[kind] :])


def decode_wkb(data: memoryview | bytes) -> list[list[list[tuple[float, float]]]]:
    at = 0

    def head(code: int) -> str:
        nonlocal at
        order = "<" if data[at] == 1 else ">"
        if data[at] not in (0, 1) or struct.unpack_from(f"{order}I", data, at + 1)[0] != code:
            raise GeometryError("other geometry type")
        at += 5
        return order

    def count(order: str) -> int:
        nonlocal at
        n = struct.unpack_from(f"{order}I", data, at)[0]
        at += 4
        return n

    try:
        parts = []
        for _ in range(count(head(6))):
            order = head(3)
            rings = []
            for _ in range(count(order)):
                n = count(order)
                flat = struct.unpack_from(f"{order}{2 * n}d", data, at)
                at += 16 * n
                rings.append(list(zip(flat[::2], flat[1::2], strict=True)))
            parts.append(rings)
    except (struct.error, IndexError) as error:
        raise GeometryError("truncated geometry") from error
    if not parts:
        raise GeometryError("no parts")
    return parts


def encode_wkb(parts: list[list[list[tuple[float, float]]]]) -> bytes:
    out = [struct.pack("<BII", 1, 6, len(parts))]
    for rings in parts:
        out.append(struct.pack("<BII", 1, 3, len(rings)))
        for ring in rings:
            out.append(struct.pack(f"<I{2 * len(ring)}d", len(ring), *[c for p in ring for c in p]))
    return b"".join(out)


ARROW = pa.list_(pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def from_blob(blob: Column, srs: int) -> Column:
    """MULTIPOLYGON of a GeoPackage blob, in Arrow batches; a malformed blob fails the job."""

    @F.arrow_udf(MULTIPOLYGON)
    def decode(blobs: pa.Array) -> pa.Array:
        return pa.array([None if b is None else [[[{"x": x, "y": y} for x, y in ring] for ring in part] for part in decode_blob(b, srs)] for b in blobs.to_pylist()], ARROW)

    return decode(blob)


def to_wkb(parts: Column) -> Column:
    """ISO WKB of a MULTIPOLYGON, in Arrow batches."""

    @F.arrow_udf("binary")
    def encode(rows: pa.Array) -> pa.Array:
        return pa.array([None if m is None else encode_wkb([[[(p["x"], p["y"]) for p in ring] for ring in part] for part in m]) for m in rows.to_pylist()], pa.binary())

    return encode(parts)


def signed_area(ring: Column) -> Column:
    """Positive for rings that go counter-clockwise; open and closed rings alike."""
    following = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    cross = F.zip_with(ring, following, lambda a, b: a["x"] * b["y"] - b["x"] * a["y"])
    return F.aggregate(cross, F.lit(0.0), lambda acc, v: acc + v) / 2


def part_count(parts: Column) -> Column:
    return F.size(parts)


def hole_count(parts: Column) -> Column:
    return F.aggregate(parts, F.lit(0), lambda acc, p: acc + F.size(p) - 1)


def bbox(parts: Column) -> Column:
    points = F.flatten(F.flatten(parts))
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("min_x"), F.array_min(ys).alias("min_y"), F.array_max(xs).alias("max_x"), F.array_max(ys).alias("max_y"))


def canonical_ring(ring: Column, ccw: bool) -> Column:
    """The ring without its closing vertex and consecutive repeats, turned as asked, from its least vertex on, and closed again."""
    opened = F.filter(ring, lambda p, i: (i == 0) | (p != F.get(ring, i - 1)))
    opened = F.when((F.size(opened) > 1) & (opened[0] == F.element_at(opened, -1)), F.slice(opened, F.lit(1), F.size(opened) - 1)).otherwise(opened)
    turned = F.when((signed_area(opened) > 0) == F.lit(ccw), opened).otherwise(F.reverse(opened))

    def rotated(r: Column) -> Column:
        start = F.array_position(r, F.array_min(r)).cast("int")
        return F.concat(F.slice(r, start, F.size(r)), F.slice(r, F.lit(1), start))

    return F.transform(F.array(turned), rotated)[0]


def canonical(parts: Column) -> Column:
    """Shells counter-clockwise and holes clockwise, each from its least vertex; holes and parts in order."""

    def part(rings: Column) -> Column:
        holes = F.array_sort(F.transform(F.slice(rings, F.lit(2), F.size(rings)), lambda r: canonical_ring(r, False)))
        return F.concat(F.array(canonical_ring(rings[0], True)), holes)

    return F.array_sort(F.transform(parts, part))


def promoted(polygon: Column) -> Column:
    """A polygon (rings) as multipolygon of one part; null and empty ones, and rings of under four vertices, are an error."""
    good = polygon.isNotNull() & (F.size(polygon) > 0) & F.forall(polygon, lambda r: F.size(r) >= 4)
    return F.when(F.coalesce(good, F.lit(False)), F.array(polygon)).otherwise(F.raise_error(F.lit("empty or malformed polygon")))


def flattened(collections: Column) -> Column:
    """The parts of an array of multipolygons, empty ones left out."""
    return F.filter(F.flatten(F.filter(collections, lambda m: m.isNotNull())), lambda p: F.size(p) > 0)


def rounded(value: Column, digits: int) -> Column:
    """A coordinate to so many digits, without a negative zero; half a unit goes by the binary value, in Arrow batches."""

    @F.arrow_udf("double")
    def clean(values: pa.Array) -> pa.Array:
        return pa.array([None if v is None else round(v, digits) + 0.0 for v in values.to_pylist()], pa.float64())

    return clean(value)
