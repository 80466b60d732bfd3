"""Packs documents into padded batches with optimal length buckets."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, cut


def _layer(best: np.ndarray, edge: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each j the least over i < j of best[i] + edge[j - 1] * (rows[j] - rows[i]), and the least such i. The first values
    of best may be -1: so few lengths do not fill the buckets.

    The least i never falls as j grows, so each depth of a binary division of the j's looks at some more than len(edge) values
    of i in all.
    """
    m = len(edge)
    value, choice = np.full(m + 1, -1, np.int64), np.zeros(m + 1, np.int64)
    first = int(np.flatnonzero(best >= 0)[0])
    # open ranges of j, with the least and greatest i that may serve them
    lo, hi, a, b = (np.array([x], np.int64) for x in (first + 1, m, first, m - 1))
    while len(lo):
        mid = (lo + hi) // 2
        stop = np.minimum(b, mid - 1)
        sizes = stop - a + 1
        ends = np.cumsum(sizes)
        at = ends - sizes
        i = np.arange(ends[-1]) - np.repeat(at - a, sizes)
        j = np.repeat(mid, sizes)
        cost = best[i] + edge[j - 1] * (rows[j] - rows[i])
        least = np.minimum.reduceat(cost, at)
        hits = np.flatnonzero(cost == np.repeat(least, sizes))
        own = i[hits[np.searchsorted(hits, at)]]
        value[mid], choice[mid] = least, own
        left, right = mid - 1 >= lo, mid + 1 <= hi
        lo, hi, a, b = (np.concatenate(x) for x in ((lo[left], mid[right] + 1), (mid[left] - 1, hi[right]), (a[left], own[right]), (own[left], b[right])))
    return value, choice


def boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper boundaries of at most so many buckets that minimise padding, by dynamic programming, exactly.

    histogram: (length, rows) for each length that occurs; only these can be boundaries of an optimum. With n[j] rows up to the j-th
    length, the bucket of the lengths i+1 to j holds edge[j] * (n[j] - n[i]) padded tokens, and best[k][j] is the least over i of
    best[k-1][i] plus that; the sum of the lengths is the same for all choices. Of equal choices the least i is taken.
    """
    cells = sorted(histogram)
    if not cells:
        return []
    edge = np.array([c[0] for c in cells], np.int64)
    rows = np.concatenate([[0], np.cumsum([c[1] for c in cells])]).astype(np.int64)
    # one bucket: all lengths up to the j-th
    best = np.concatenate([[-1], edge * rows[1:]])
    back = [np.zeros(len(cells) + 1, np.int64)]
    for _ in range(min(buckets, len(cells)) - 1):
        best, choice = _layer(best, edge, rows)
        back.append(choice)
    out, j = [], len(cells)
    for choice in reversed(back):
        out.append(int(edge[j - 1]))
        j = int(choice[j])
    return out[::-1]


def word_length(text: Column) -> Column:
    """Tokens of a text under the white-space tokenizer plus its end mark; 1 for null and empty texts."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), BLANK + "+", " "))
    return (F.when(body == "", 0).otherwise(F.length(body) - F.length(F.replace(body, F.lit(" "), F.lit(""))) + 1) + 1).cast("long")


def part_of(key: Column, length: Column, parts: int) -> Column:
    """Part in which a row is ranked: 32 bits of the MD5 of key and length, modulo the parts."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.coalesce(key.cast("string"), F.lit("")), length.cast("string"))), 1, 8), 16, 10).cast("long")
    return (bits % parts).cast("int")


def pack(
    docs: DataFrame, buckets: int = 16, budget: int = 32_768, key: str = "doc_id", length: Column | None = None, rows_a_part: int = 50_000, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Deal every document into a batch of documents padded to one length.

    length: tokens of a row, word_length of the column text by default. The global histogram goes to the driver, a row for each
    length that occurs (as lengths differ, m of them need m * m / 2 tokens at least), boundaries() chooses the buckets, and inside
    a bucket with boundary b each batch takes max(1, budget div b) documents, so padded batches hold at most the budget, or one
    longer document. No text is cut.

    Returns key, n_tokens, bucket (from 0, by length), boundary (the padded length, that of the bucket's longest document), batch
    (from 0 in its bucket), place (in its batch) and the columns of keep. Only the last batch of a bucket may be short. Rows in a
    bucket are taken by hashed part, then key and length; repeated rows count as rows of their own, a null key sorts first, an
    empty input gives no rows.
    """
    spark = docs.sparkSession
    size = word_length(F.col("text")) if length is None else length
    slim = cut(docs.select(F.col(key).alias("_key"), size.alias("n_tokens")), "lengths")
    histogram = [(r["n_tokens"], r["count"]) for r in slim.groupBy("n_tokens").count().collect()]
    edges = boundaries(histogram, buckets)
    if not edges:
        kept = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in keep)
        return spark.createDataFrame([], f"{key} {docs.schema[key].dataType.simpleString()}, n_tokens long, bucket int, boundary long, batch long, place int{kept}")
    parts = max(32, -(-sum(n for _, n in histogram) // rows_a_part))

    def placed(n: Column, of: Column) -> Column:
        bucket = sum((F.when(n > e, 1).otherwise(0) for e in edges[:-1]), F.lit(0)).cast("int")
        return F.struct(n.alias("n_tokens"), bucket.alias("bucket"), part_of(of, n, parts).alias("_part"))

    counted = slim.select(placed(F.col("n_tokens"), F.col("_key")).alias("p"), "_key").select("_key", "p.*")
    dealt = counted
    if keep:
        # what is kept is read again from docs, and not written with the lengths; a generator, so that lengths are computed once
        kept = [F.col(c).alias(f"_keep_{c}") for c in keep]
        dealt = docs.select(F.col(key).alias("_key"), F.explode(F.transform(F.array(size), lambda n: placed(n, F.col(key)))).alias("p"), *kept).select("_key", "p.*", *[f"_keep_{c}" for c in keep])
    dealt = dealt.withColumn("boundary", F.element_at(F.array(*[F.lit(e).cast("long") for e in edges]), F.col("bucket") + 1))
    before = Window.partitionBy("bucket").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    first = counted.groupBy("bucket", "_part").count().select("bucket", "_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_first"))
    within = Window.partitionBy("bucket", "_part").orderBy("_key", "n_tokens")
    ranked = dealt.join(first, ["bucket", "_part"]).withColumn("_rank", F.col("_first") + F.row_number().over(within) - 1)
    room = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.col("boundary"))).cast("long")
    return ranked.select(
        F.col("_key").alias(key), "n_tokens", "bucket", "boundary", F.floor(F.col("_rank") / room).cast("long").alias("batch"), F.pmod(F.col("_rank"), room).cast("int").alias("place"),
        *[F.col(f"_keep_{c}").alias(c) for c in keep],
    )


def padded(packed: DataFrame, ids: str, pad: int = 0) -> DataFrame:
    """Packed rows with their array of token ids (a column kept by pack) padded to the bucket's boundary: bucket, batch, place, ids, mask.

    The mask has 1 for each own id and 0 for padding. A batch is the rows of one bucket and batch number; write them with
    partitionBy("bucket") to keep batches of a length together. A null array counts as empty.
    """
    own = F.coalesce(F.col(ids), F.array().cast(packed.schema[ids].dataType))
    lacks = (F.col("boundary") - F.size(own)).cast("int")
    return packed.select("bucket", "batch", "place", F.concat(own, F.array_repeat(F.lit(pad), lacks)).alias("ids"), F.concat(F.array_repeat(F.lit(1), F.size(own)), F.array_repeat(F.lit(0), lacks)).alias("mask"))
