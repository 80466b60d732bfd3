"""Tiles of zones: rendering by tile, checks of the pyramid, recolouring."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import png
from ..functions import tiles as t
from .reconcile import stream_hash

TILE = "z int, x long, y long, content binary, sha256 string, bytes long, indices array<int>"


def render(outline: DataFrame, tiles: DataFrame, zone: str, palette: bytes = bytes(3 * png.COLOURS)) -> DataFrame:
    """A row (TILE) for each of the tiles z, x, y: its PNG and the indices in it.

    outline: edges (zone 53 to 59, ax..by) of the dissolved zones. A tile needs the edges that its rows of pixels meet, all those to
    its left included, so edges are sent to the tile rows (z, y) they cross and tiles to theirs; one task's group is one row of tiles.
    """
    zooms = [r["z"] for r in tiles.select("z").distinct().collect()]
    if not zooms:
        return tiles.sparkSession.createDataFrame([], TILE)
    by_zoom = outline.select("*", F.explode(F.array(*[F.lit(int(z)) for z in zooms])).alias("z"))
    # one pixel more at either side, for borders
    reach = F.lit(2 * t.WORLD / t.TILE_SIZE) / t.extent(F.col("z"))
    rows = F.sequence(t.tile_y(F.col("z"), F.greatest("ay", "by") + reach), t.tile_y(F.col("z"), F.least("ay", "by") - reach))
    sent = by_zoom.select("z", F.explode(rows).alias("y"), (F.col(zone) - 52).cast("int").alias("index"), "ax", "ay", "bx", "by")
    asked = tiles.select(F.col("z").cast("int").alias("z"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")).distinct()

    def paint(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        z, y = (int(k.as_py()) for k in key)
        edges = np.column_stack([left.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")]) if left.num_rows else np.zeros((0, 4))
        index = left.column("index").to_numpy() if left.num_rows else np.zeros(0, int)
        out = []
        for x in sorted(right.column("x").to_pylist()):
            pixels = png.render(edges, index, z, x, y)
            content = png.encode(pixels, palette)
            out.append((z, x, y, content, hashlib.sha256(content).hexdigest(), len(content), np.unique(pixels).tolist()))
        kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.list_(pa.int32()))
        names = ("z", "x", "y", "content", "sha256", "bytes", "indices")
        columns = list(zip(*out, strict=True)) if out else [[]] * len(names)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=list(names))

    return sent.groupBy("z", "y").cogroup(asked.groupBy("z", "y")).applyInArrow(paint, TILE)


def missing_indices(tiles: DataFrame) -> DataFrame:
    """z and the palette indices 1 to 15 that none of its tiles has."""
    seen = tiles.select("z", F.explode("indices").alias("i")).groupBy("z").agg(F.collect_set("i").alias("seen"))
    return seen.select("z", F.array_except(F.sequence(F.lit(1), F.lit(15)), "seen").alias("missing"))


def inventory_digest(tiles: DataFrame) -> DataFrame:
    """z, tiles, bytes and the SHA-256 of its ordered inventory lines, by row of tiles and then over rows."""
    line = F.concat(F.col("sha256"), F.lit("  "), F.concat_ws("/", "z", "x", "y"), F.lit(".png"))
    columns = tiles.groupBy("z", "x").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("y", line.alias("l")))), lambda v: v["l"]), "\n"), 256).alias("h"))
    whole = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "h"))), lambda v: v["h"]), "\n"), 256)
    return columns.groupBy("z").agg(F.sum("n").alias("tiles"), F.sum("b").alias("bytes"), whole.alias("sha256"))


def published_inventory(tiles: DataFrame) -> DataFrame:
    """z, tiles, bytes, bounds and the SHA-256 of the zoom's inventory file: lines of digest and path, ordered by x and y.

    tiles: z, x, y, sha256, bytes. Counts and bounds are partial sums; each zoom's digest is one stream, as its file is one.
    """
    bounds = [F.count(F.lit(1)).alias("tiles"), F.sum("bytes").alias("bytes"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y")]
    line = F.concat(F.col("sha256"), F.lit("  "), F.concat_ws("/", "z", "x", "y"), F.lit(".png\n"))
    digests = stream_hash(tiles.withColumn("line", line), "z", ["x", "y"], "line").select("z", "sha256")
    return tiles.groupBy("z").agg(*bounds).join(digests, "z")


def export(tiles: DataFrame, folder: str) -> DataFrame:
    """Write tiles as `z/x/y.png` below a folder that driver and executors share as a local path; returns z, x, y, sha256, bytes of what was written.

    Each file is written beside its place and renamed, so a task that runs again leaves the same files.
    """

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            out = []
            for z, x, y, content in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                path = f"{folder}/{z}/{x}/{y}.png"
                os.makedirs(os.path.dirname(path), exist_ok=True)
                with open(f"{path}.{attempt}", "wb") as held:
                    held.write(content)
                os.replace(f"{path}.{attempt}", path)
                out.append((z, x, y, hashlib.sha256(content).hexdigest(), len(content)))
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64())
            columns = list(zip(*out, strict=True)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["z", "x", "y", "sha256", "bytes"])

    slim = tiles.select(F.col("z").cast("int").alias("z"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "content")
    return slim.mapInArrow(put, "z int, x long, y long, sha256 string, bytes long")


def with_default(requests: DataFrame, tiles: DataFrame, default: Column) -> DataFrame:
    """requests (z, x, y, ...) with content: the tile's, or the default where there is none, and covered."""
    found = requests.join(tiles.select("z", "x", "y", "content"), ["z", "x", "y"], "left")
    return found.withColumn("covered", F.col("content").isNotNull()).withColumn("content", F.coalesce("content", default))


def recoloured(tiles: DataFrame, state: DataFrame) -> DataFrame:
    """Every tile in the colours and style of one tile state (colors, style, cache_tag); the state is a single row."""
    one = state.select("colors", "style", "cache_tag").head()
    colours = F.array(*[F.array(*map(F.lit, c)) for c in one["colors"]])
    return tiles.select("z", "x", "y", png.recoloured(F.col("content"), colours, F.lit(one["style"])).alias("content"), F.lit(one["cache_tag"]).alias("cache_tag"))
