"""spark-submit entry: python -m tessera COMMAND ...

  status FEED CATALOGUE         validate both documents and print the snapshot and the zones
  publish FEED CATALOGUE STATE  the same, and append the candidate to the state table if its snapshot is new
  tiles GPKG LAYER OUT ZOOM...  dissolve the layer's zones (column zone_id, in Mercator metres) and write their tiles as a table
  inventory LIST ROOT           compare an inventory of SHA-256 lines with the files below a folder
  download URL FILE BYTES       land a file of at most so many bytes and print its record
  inspect GPKG LAYER SRS        print what an inspection of a layer finds
  recolor TILE OUT COLOUR...    write a tile with seven colours (RRGGBB), the zones' hatches darker
"""

from __future__ import annotations

import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .operators import feed, pyramid, reconcile, rendering, topology
from .sources import files


def candidate(spark: SparkSession, feed_path: str, catalogue_path: str) -> DataFrame:
    """The snapshot of a feed document under a catalogue; raises FeedError with the first violation's code."""
    zones, wrong = feed.read_zones(files.documents(spark, feed_path))
    situations, bad = feed.read_catalogue(files.documents(spark, catalogue_path))
    feed.require_valid(wrong, bad)
    rows = feed.normalise(zones, situations.select("situation_id", "level"))
    lost = feed.unresolved(rows).select("doc", "code", F.concat(F.lit("$.z1["), F.col("index").cast("string"), F.lit("]")).alias("path"))
    feed.require_valid(lost)
    return feed.snapshots(rows)


def publish(spark: SparkSession, feed_path: str, catalogue_path: str, state: str) -> str:
    """Outcome of a candidate against the table folder state: published (a row is appended) or unchanged. A rejected document
    raises before the state is read."""
    new = candidate(spark, feed_path, catalogue_path).withColumn("published_at", F.current_timestamp())
    try:
        last = spark.read.schema(new.schema).parquet(state).agg(F.max_by("snapshot_id", "published_at")).collect()[0][0]
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        last = None
    if new.collect()[0]["snapshot_id"] == last:
        return "unchanged"
    new.write.mode("append").parquet(state)
    return "published"


def download(url: str, path: str, most: str) -> int:
    from .sources import http

    try:
        print(json.dumps(http.download(url, path, int(most)), sort_keys=True))
    except http.SourceError as error:
        print(error.code, file=sys.stderr)
        return 1
    return 0


def inspect(path: str, layer: str, srs: str) -> int:
    from .sources import gpkg

    found = gpkg.record(path, layer, int(srs), ())
    print(json.dumps(found, sort_keys=True))
    return int(bool(found["problems"]))


def recolor(tile: str, out: str, *colours: str) -> int:
    from .functions import png
    from .sources import sinks

    with open(tile, "rb") as held:
        data = held.read()
    try:
        sinks.atomic_write(out, png.recolour(data, [list(bytes.fromhex(c.removeprefix("#"))) for c in colours], True))
    except ValueError as error:
        print(error, file=sys.stderr)
        return 1
    return 0


#: Commands that need no Spark session.
LOCAL = {"download": download, "inspect": inspect, "recolor": recolor}


def main(args: list[str]) -> int:
    if not args or args[0] not in ("status", "publish", "tiles", "inventory", *LOCAL):
        print(__doc__)
        return 2
    if args[0] in LOCAL:
        return LOCAL[args[0]](*args[1:])
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    command, *rest = args
    try:
        if command == "status":
            candidate(spark, *rest).select("source_date", "snapshot_id", F.to_json("current").alias("current"), F.to_json("forecast").alias("forecast")).show(truncate=False)
        elif command == "publish":
            print(publish(spark, *rest))
        elif command == "tiles":
            from .functions import geometry
            from .sources.gpkg import GeoPackageSource

            path, layer, out, *zooms = rest
            spark.dataSource.register(GeoPackageSource)
            shapes = spark.read.format("gpkg").option("path", path).option("table", layer).option("columns", "zone_id,geom").load()
            outline = topology.dissolve(topology.edges(shapes.select("zone_id", geometry.from_blob(F.col("geom"), 3857).alias("geometry")), "zone_id", "geometry"), "zone_id")
            edge = pyramid.enumerate_tiles(outline, "zone_id", tuple(map(int, zooms)))
            rendering.render(outline, pyramid.fill_rows(outline, edge, "zone_id"), "zone_id").write.partitionBy("z").parquet(out)
        else:
            differing = reconcile.inventory(files.inventory(spark, rest[0]), files.binaries(spark, rest[1]).drop("content"), "path", "sha256").where("status <> 'same'")
            found = differing.orderBy("path").limit(10).collect()
            print(*[f"{r['status']}  {r['path']}" for r in found] or ["same"], sep="\n")
            return int(bool(found))
    except feed.FeedError as error:
        print(error.code, file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
