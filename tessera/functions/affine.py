"""Registration of a map on an image: one scale, a shift, and y turned over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def register(left: float, top: float, right: float, bottom: float, min_x: Column, min_y: Column, max_x: Column, max_y: Column) -> Column:
    """struct(scale, tx, ty) that takes a bounding box in metres to one in pixels: by the extent from north to south, the boxes' middles aligned."""
    scale = F.lit(bottom - top) / (max_y - min_y)
    return F.struct(scale.alias("scale"), (F.lit((left + right) / 2.0) - scale * (min_x + max_x) / 2.0).alias("tx"), (F.lit(top) + scale * max_y).alias("ty"))


def pixel(by: Column, x: Column, y: Column) -> Column:
    """Where a registration puts a point."""
    return F.struct((by["scale"] * x + by["tx"]).alias("x"), (by["ty"] - by["scale"] * y).alias("y"))


def ring(by: Column, points: Column) -> Column:
    return F.transform(points, lambda p: pixel(by, p["x"], p["y"]))


def residual(predicted: Column, x: Column, y: Column) -> Column:
    """Distance of a predicted pixel from the one that was seen."""
    return F.hypot(predicted["x"] - x, predicted["y"] - y)


def worst(rows: DataFrame, group: str, distance: str, most: float) -> DataFrame:
    """group, n, worst and passes: the greatest residual of each group's control points against the limit."""
    out = rows.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.max(distance).alias("worst"))
    return out.withColumn("passes", F.col("worst") <= most)
