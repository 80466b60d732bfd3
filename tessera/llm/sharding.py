"""Shards by descending a hierarchical weighted hash tree (region, rack, shard)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, let

#: A tree: regions, each a list of racks, each a list of shard weights. Shards are numbered from left to right.
Tree = Sequence[Sequence[Sequence[float]]]

SIXTEEN: Tree = [[[1.0] * 4, [1.0] * 4], [[1.0] * 4, [1.0] * 4]]


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a region of its own: the draws of the other regions stay as they are."""
    return [*tree, [[weight]]]


def draw(key: Column, path: Column, weight: Column) -> Column:
    """A node's draw for a key: an exponential variate with rate weight, from 52 bits of the MD5 of key and path; infinite for weight 0."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), path)), 1, 13), 16, 10).cast("double")
    return F.when(weight > 0, -F.log((bits + 0.5) / float(1 << 52)) / weight).otherwise(float("inf"))


def descend(key: Column, tree: Tree) -> Column:
    """Number of the shard in which the descent of a key ends.

    At each level the row goes to the child with the least draw. Every node draws by its own path (`region`, `region.rack`,
    `region.rack.shard`, counted from 0) and weight, that of all shards below it, so children get rows in proportion to their weights and
    only the children of the nodes on the way draw. A change of a shard's weight alters the weights of that shard, its rack and its
    region and no draw elsewhere: where the ways of a row that moves part, one of them goes on to one of these three. Ties go
    to the lower number.
    """

    def whole(weights: list) -> Column:
        return F.array(*[F.lit(float(w)) for w in weights])

    racks = [[sum(rack) for rack in region] for region in tree]
    numbers, after = [], 0
    for region in tree:
        numbers.append([after + sum(len(r) for r in region[:k]) for k in range(len(region))])
        after += sum(len(r) for r in region)

    def least(path: Column | None, weights: Column) -> Column:
        def one(w: Column, i: Column) -> Column:
            own = i.cast("string") if path is None else F.concat(path, F.lit("."), i.cast("string"))
            return F.struct(draw(key, own, w).alias("draw"), i.alias("i"))

        return F.array_min(F.transform(weights, one))["i"]

    def in_region(r: Column) -> Column:
        return let(least(r.cast("string"), F.array(*map(whole, racks))[r]), lambda k: in_rack(r, k))

    def in_rack(r: Column, k: Column) -> Column:
        weights = F.array(*[F.array(*map(whole, region)) for region in tree])[r][k]
        first = F.array(*[F.array(*map(F.lit, own)) for own in numbers])[r][k]
        return first + least(F.concat_ws(".", r.cast("string"), k.cast("string")), weights)

    return let(least(None, whole([sum(own) for own in racks])), in_region)


def part_of(key: Column, checksum: Column, parts: int) -> Column:
    """Part in which a row is numbered: 32 bits of the MD5 of key and checksum, modulo the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), checksum.cast("string"))), 1, 8), 16, 10).cast("long")
    return (bits % parts).cast("int")


def shard(docs: DataFrame, tree: Tree = SIXTEEN, key: str = "doc_id", text: str = "text", rows_a_part: int = 50_000) -> DataFrame:
    """Place every row in a shard of the tree by its key, and number the rows of each shard without gaps.

    Returns key, size (UTF-8 bytes of the text plus 1; a null text has none), text_crc32, law ('key'), shard, slot (from 0,
    in order of part, key and checksum) and grown_shard, the place in the tree with one more shard, which
    takes rows into itself only. A null key counts as
    the empty string. Repeated rows each get a slot of their own; columns besides key and text are ignored.

    Only the text's size and checksum leave the scan. Slots need no ordering of a whole shard: rows are counted by shard and
    hashed part, a running sum over the parts gives each its first slot, and rows are numbered within their part.
    """
    body = F.coalesce(F.col(text), F.lit("")).cast("binary")
    more = grow(tree)
    slim = docs.select(F.col(key).alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body).alias("text_crc32"))
    parts = max(32, -(-docs.count() // rows_a_part))
    placed = cut(
        slim.select(
            "doc_id", "size", "text_crc32",
            descend(F.col("doc_id"), tree).cast("int").alias("shard"), descend(F.col("doc_id"), more).cast("int").alias("grown_shard"),
            part_of(F.col("doc_id"), F.col("text_crc32"), parts).alias("_part"),
        ),
        "placed",
    )
    before = Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy("shard", "_part").count()
    first = counts.select("shard", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("shard", "_part").orderBy("doc_id", "text_crc32", "size")
    return placed.join(first, ["shard", "_part"]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard",
        (F.col("_first") + F.row_number().over(within) - 1).cast("long").alias("slot"), "grown_shard",
    )
