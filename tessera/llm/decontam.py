"""Benchmark passages in documents: SimHash of item-sized windows, multi-index Hamming search, exact verification.

DataFrame functions alone.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, words

HIT = "doc_id bigint, item_id bigint, start_word int, n_words int, distance int, similarity double"


def md5_hash(word: Column) -> Column:
    """The first 64 bits of a word's MD5."""
    return F.conv(F.substring(F.md5(word), 1, 16), 16, -10).cast("long")


def simhash(own: Column, word_hash: Callable[[Column], Column] = F.xxhash64) -> Column:
    """64-bit fingerprint of an array of words: bit i is 1 if more than half of the words' hashes have it."""
    hashes = F.transform(own, lambda w: word_hash(w))

    def bits(h: Column) -> Column:
        def bit(i: Column) -> Column:
            ones = F.aggregate(h, F.lit(0), lambda acc, x: acc + F.getbit(x, i).cast("int"))
            return F.when(2 * ones > F.size(h), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc.bitwiseOR(bit(i)))

    return let(hashes, bits)


def blocks(fingerprint: Column, radius: int) -> Column:
    """radius + 1 blocks that share the 64 bits out, as numbers with the block's place: two fingerprints within the radius
    have an equal block, as so many differing bits can't touch all of them."""
    cuts = [64 * i // (radius + 1) for i in range(radius + 2)]
    parts = []
    for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        value = F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("long"))
        parts.append(value * (radius + 1) + i)
    return F.array(*parts)


def grams(own: Column, size: Column) -> Column:
    """Shingles of `size` words, as texts."""
    return F.when(F.size(own) >= size, F.transform(F.sequence(F.lit(0), F.size(own) - size), lambda i: F.array_join(F.slice(own, i + 1, size), " "))).otherwise(F.array().cast("array<string>"))


def weighted_jaccard(a: Column, b: Column, weights: Column, other: Column) -> Column:
    """Sum of the lesser counts over sum of the greater, each shingle by its weight (a map; `other` for those not in it).

    Where neither side repeats a shingle, which is the common case, the counts are those of the sides' intersection and union.
    """

    def weight(s: Column) -> Column:
        return F.coalesce(F.try_element_at(weights, s), other)

    def tally(s: Column) -> Column:
        x, y = F.size(F.filter(a, lambda v: v == s)), F.size(F.filter(b, lambda v: v == s))
        w = weight(s)
        return F.struct((F.least(x, y) * w).alias("both"), (F.greatest(x, y) * w).alias("any"))

    def ratio(t: Column) -> Column:
        both = F.aggregate(t, F.lit(0.0), lambda acc, v: acc + v["both"])
        every = F.aggregate(t, F.lit(0.0), lambda acc, v: acc + v["any"])
        return F.when(every > 0, both / every).otherwise(0.0)

    def total(shingles: Column) -> Column:
        return F.aggregate(shingles, F.lit(0.0), lambda acc, s: acc + weight(s))

    def single(x: Column) -> Column:
        return F.size(F.array_distinct(x)) == F.size(x)

    sets = F.when(F.size(F.array_union(a, b)) > 0, total(F.array_intersect(a, b)) / total(F.array_union(a, b))).otherwise(0.0)
    return F.when(~F.arrays_overlap(a, b), 0.0).when(single(a) & single(b), sets).otherwise(let(F.transform(F.array_union(a, b), tally), ratio))


def find(docs: DataFrame, items: DataFrame, size: int = 5, similarity: float = 0.8, radius: int = 24, slack: int = 2, key: str = "doc_id", item: str = "item_id", text: str = "text", broadcast_shingles: int = 1_000_000, windows_a_part: int = 2000, word_hash: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Windows of documents that are near a benchmark item: a row (HIT) for each document and item, with the best window.

    Texts are lower-cased and cut at white space; punctuation stays. An item of n words is held against windows of n words:
    those at which a shared 5-word shingle (the whole item if it is shorter) lines up, and up to `slack` words to either side, for
    words put in or left out; where the text ends a window has fewer words. A window without a shared shingle has similarity 0. Its fingerprint is looked
    up among those of the items of n words by blocks, which finds all within the radius; the similarity of these pairs is then
    computed exactly (to nine digits): weighted Jaccard of shingle counts, a shingle's weight being ln(1 + items / items that have it). The radius is
    wide, so that it loses next to no window of that similarity (see the README): pairs have a shingle to share, few are far.

    word_hash: 64 bits of a word, for the fingerprints.

    Null and empty texts and items have no hit. Rows that share a key, null too, are one document, whose windows come from all of
    them. Rows that share an item's id, null too, are one item with several texts, each of which is looked for and weighs as an
    item of its own; rows with the same words are one. The items' shingles are broadcast if there are at most broadcast_shingles, else joined by
    shuffle. Hits come in no order.
    """
    spark = docs.sparkSession
    own = items.select(F.col(item).alias("item_id"), words(F.lower(text)).alias("iw")).where(F.size("iw") > 0).dropDuplicates(["item_id", "iw"]).withColumn("row", F.monotonically_increasing_id())
    own = own.withColumn("n", F.size("iw")).withColumn("size", F.least(F.lit(size), F.col("n")))
    listed = cut(own.withColumn("grams", grams(F.col("iw"), F.col("size"))).withColumn("print", simhash(F.col("iw"), word_hash)), "items")
    n_items = listed.count()
    places = cut(listed.select("row", "n", "size", F.posexplode(F.transform(F.sequence(F.lit(0), F.col("n") - F.col("size")), lambda i: F.xxhash64(F.slice("iw", i + 1, F.col("size"))))).alias("offset", "h")), "places")
    sizes = [r[0] for r in places.select("size").distinct().collect()]
    if not sizes:
        return spark.createDataFrame([], HIT)
    small = places.count() <= broadcast_shingles

    slim = docs.select(F.col(key).alias("doc_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    word_rows = slim.select("doc_id", words(F.col("text")).alias("w"))
    hits = None
    for k in sorted(sizes):
        found = word_rows.select("doc_id", F.posexplode(_hashes(F.col("w"), k)).alias("pos", "h"))
        there = places.where(F.col("size") == k).select("h", "n", "offset")
        found = found.join(F.broadcast(there) if small else there, "h").select("doc_id", "n", (F.col("pos") - F.col("offset")).alias("start"))
        hits = found if hits is None else hits.union(found)
    starts = hits.groupBy("doc_id").agg(F.collect_set(F.struct("n", "start")).alias("starts"))
    starts = cut(starts, "starts")
    near = F.explode(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.transform(F.sequence(F.lit(-slack), F.lit(slack)), lambda d: F.struct(s["n"].alias("n"), F.greatest(F.lit(0), s["start"] + d).alias("start")))))))
    joined = slim.alias("d").join(starts.alias("s"), F.col("d.doc_id").eqNullSafe(F.col("s.doc_id"))).select("d.doc_id", words(F.col("text")).alias("w"), "starts")
    spots = joined.select("doc_id", "w", near.alias("at")).select("doc_id", F.col("at.n").alias("n"), F.col("at.start").alias("start"), F.slice("w", F.col("at.start") + 1, F.col("at.n")).alias("ww")).where(F.size("ww") > 0)
    windows = cut(spots.withColumn("window", F.monotonically_increasing_id()).withColumn("print", simhash(F.col("ww"), word_hash)), "windows")

    left = windows.select("window", "n", "print", F.explode(blocks(F.col("print"), radius)).alias("block"))
    right = listed.select("row", "n", "print", F.explode(blocks(F.col("print"), radius)).alias("block"))
    a, b = left.alias("a"), right.alias("b")
    distance = F.bit_count(F.col("a.print").bitwiseXOR(F.col("b.print"))).cast("int")
    met = a.join(b, (F.col("a.n") == F.col("b.n")) & (F.col("a.block") == F.col("b.block")) & (distance <= radius)).select("a.window", "b.row", distance.alias("distance")).distinct()
    # few bytes and much work: dealt by the count of windows, not by bytes
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), windows.count() // windows_a_part)
    met = met.repartition(parts, "window").join(windows.select("window", "doc_id", "start", "n", "ww").repartition(parts, "window"), "window")

    seen = listed.select("row", F.explode(F.array_distinct("grams")).alias("g"))
    rarity = seen.groupBy("g").agg(F.count(F.lit(1)).alias("df"))
    weights = seen.join(rarity, "g").groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("g", F.log(1 + n_items / F.col("df"))))).alias("weights"))
    sides = listed.select("row", "item_id", "size", "grams").join(weights, "row")
    alike = weighted_jaccard(grams(F.col("ww"), F.col("size")), F.col("grams"), F.col("weights"), F.log(F.lit(1.0 + n_items)))
    # sums of weights depend on their order in the last digits
    scored = met.join(sides, "row").withColumn("similarity", F.round(alike, 9)).where(F.col("similarity") >= similarity)
    best = scored.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("similarity"), (-F.col("start")).alias("back"), (-F.col("distance")).alias("near"), F.col("n"))).alias("best"))
    return best.select("doc_id", "item_id", (-F.col("best.back")).cast("int").alias("start_word"), F.col("best.n").cast("int").alias("n_words"), (-F.col("best.near")).cast("int").alias("distance"), F.col("best.similarity").alias("similarity"))


def _hashes(own: Column, size: int) -> Column:
    """Hash of the shingle at each word; none where the text is shorter."""
    return F.when(F.size(own) >= size, F.transform(F.sequence(F.lit(0), F.size(own) - size), lambda i: F.xxhash64(F.slice(own, i + 1, size)))).otherwise(F.array().cast("array<bigint>"))
