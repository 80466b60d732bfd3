"""Connected components by contraction, without any graph on the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a long, b long, repeated and self edges allowed. Returns (node, root) for every node of an edge.

    Each round every node picks, among itself and its neighbours, the one with the least hash of id and round; edges move to
    the picks and loops go. In expectation a constant share of the nodes goes each round, whatever the shape. Rounds end when
    no edge is left, which is the only thing the driver asks.
    """
    left = cut(edges.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    both = left.select(F.col("a").alias("node")).union(left.select("b")).distinct()
    where = cut(both.select("node", F.col("node").alias("root")), "roots")
    turn = 0
    while not left.isEmpty():
        turn += 1
        near = left.select(F.col("a").alias("node"), F.col("b").alias("other")).union(left.select("b", "a"))
        rank = F.struct(F.xxhash64("other", F.lit(turn)).alias("h"), F.col("other").alias("to"))
        own = F.struct(F.xxhash64("node", F.lit(turn)).alias("h"), F.col("node").alias("to"))
        picks = cut(near.groupBy("node").agg(F.min(rank).alias("best")).select("node", F.least(F.col("best"), own)["to"].alias("to")), "picks")
        where = cut(where.join(picks.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("to", "root").alias("root")), "roots")
        moved = left.join(picks.select(F.col("node").alias("a"), F.col("to").alias("x")), "a").join(picks.select(F.col("node").alias("b"), F.col("to").alias("y")), "b")
        left = cut(moved.where("x != y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    return where
