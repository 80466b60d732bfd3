"""Comparison of relations: counts against expectations, inventories, logical hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def against_expected(rows: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """key, n, expected, passes: counted rows of each key against expected (key, expected); a side without the key has 0."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    both = counted.join(expected.select(key, "expected"), key, "full_outer")
    n, e = F.coalesce("n", F.lit(0)).cast("long"), F.coalesce("expected", F.lit(0)).cast("long")
    return both.select(key, n.alias("n"), e.alias("expected"), (n == e).alias("passes"))


def duplicates(rows: DataFrame, key: Column, name: str) -> DataFrame:
    """Keys that don't occur exactly once, with n."""
    return rows.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("n")).where("n <> 1")


def inventory(expected: DataFrame, observed: DataFrame, key: str, digest: str) -> DataFrame:
    """key and status: missing, extra, changed or same, by null-safe comparison of the digest."""
    a, b = expected.alias("a"), observed.alias("b")
    joined = a.join(b, F.col(f"a.{key}") == F.col(f"b.{key}"), "full_outer")
    status = F.when(F.col(f"b.{key}").isNull(), "missing").when(F.col(f"a.{key}").isNull(), "extra").when(~F.col(f"a.{digest}").eqNullSafe(F.col(f"b.{digest}")), "changed").otherwise("same")
    return joined.select(F.coalesce(f"a.{key}", f"b.{key}").alias(key), status.alias("status"))


def multiset_difference(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows that one side has more often, with side: missing (left) or extra (right)."""
    return left.exceptAll(right).withColumn("side", F.lit("missing")).unionByName(right.exceptAll(left).withColumn("side", F.lit("extra")))


def row_json(columns: list[str]) -> Column:
    """Compact JSON of a row with its nulls and in the given order."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def logical_hash(rows: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """One row: n and sha256 of a relation, whatever its order and partitions.

    Rows are digested, digests grouped by their first four hex digits, each group hashed in sorted order, and the groups' hashes
    too: no task holds more than a 65,536th of the digests, or as many hashes.
    """
    digest = rows.select(F.sha2(F.concat_ws("\n", F.concat_ws("\x1f", *key), row_json(columns)), 256).alias("h"))
    parts = digest.groupBy(F.left("h", F.lit(4)).alias("part")).agg(F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("h"))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", "h"))), lambda x: x["h"]), "\n")
    return parts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sha2(whole, 256).alias("sha256"))


def metrics(rows: DataFrame, distinct: dict[str, Column], text: str, size: str) -> DataFrame:
    """One row: n, a count of distinct values for each of distinct, n_blank (null or blank text) and chars (the sum of size)."""
    return rows.agg(
        F.count(F.lit(1)).alias("n"), *[F.count_distinct(c).alias(name) for name, c in distinct.items()],
        F.count_if(F.col(text).isNull() | (F.trim(text) == "")).alias("n_blank"), F.coalesce(F.sum(size), F.lit(0)).alias("chars"),
    )


def exactly_one(rows: DataFrame, key: str, samples: DataFrame) -> DataFrame:
    """key, n and status (one, none, many) of each sample (key) among the rows."""
    counted = rows.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    n = F.coalesce("_n", F.lit(0))
    return samples.select(key).join(counted, key, "left").select(key, n.alias("n"), F.when(n == 0, "none").when(n == 1, "one").otherwise("many").alias("status"))


def positional(stored: DataFrame, expected: DataFrame, group: str, items: str, fields: list[str]) -> DataFrame:
    """group, position and problem (missing, extra or the first field that differs) of two arrays of structs held place by place."""
    a, b = (d.select(group, F.posexplode(items).alias("position", side)) for d, side in ((stored, "a"), (expected, "b")))
    both = a.join(b, [group, "position"], "full_outer")
    differs = F.coalesce(*[F.when(~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(f"differs:{c}")) for c in fields])
    problem = F.when(F.col("a").isNull(), "missing").when(F.col("b").isNull(), "extra").otherwise(differs)
    return both.select(group, "position", problem.alias("problem")).where("problem is not null")


def artifacts(stored: DataFrame, fresh: DataFrame, name: str, content: str) -> DataFrame:
    """name, status and both sizes of artifacts held byte for byte; only digests are joined."""
    a, b = (d.select(name, F.sha2(F.col(content).cast("binary"), 256).alias("sha256"), F.octet_length(content).alias(size)) for d, size in ((stored, "stored_bytes"), (fresh, "fresh_bytes")))
    status = inventory(a, b, name, "sha256")
    none = F.lit(-1)
    return status.join(a.drop("sha256"), name, "left").join(b.drop("sha256"), name, "left").select(name, "status", F.coalesce("stored_bytes", none).alias("stored_bytes"), F.coalesce("fresh_bytes", none).alias("fresh_bytes"))


def pinned(manifest: DataFrame, others: dict[str, DataFrame], key: str, columns: list[str]) -> DataFrame:
    """key and problem of each row of a manifest: `side:missing` or `side:column` where another side first departs, null-safe."""
    out, found = manifest, []
    for side, rows in others.items():
        own = rows.select(key, F.lit(True).alias(f"_{side}"), *[F.col(c).alias(f"_{side}_{c}") for c in columns])
        out = out.join(own, key, "left")
        found += [F.when(F.col(f"_{side}").isNull(), f"{side}:missing"), *[F.when(~F.col(c).eqNullSafe(F.col(f"_{side}_{c}")), f"{side}:{c}") for c in columns]]
    return out.select(key, F.coalesce(*found).alias("problem")).where("problem is not null")


def set_relations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: distinct keys of the left, of the right, of both together, in both, on one side only."""
    sides = left.select(key, F.lit(1).alias("a"), F.lit(0).alias("b")).union(right.select(key, F.lit(0), F.lit(1))).groupBy(key).agg(F.max("a").alias("a"), F.max("b").alias("b"))
    total = [("left_n", F.col("a") == 1), ("right_n", F.col("b") == 1), ("union_n", F.lit(True)), ("both_n", F.col("a") + F.col("b") == 2), ("left_only", F.col("b") == 0), ("right_only", F.col("a") == 0)]
    return sides.agg(*[F.count_if(c).alias(name) for name, c in total])


def first_offenders(rows: DataFrame, group: str, item: str, n: int) -> DataFrame:
    """group and its first n distinct items in order, joined by commas; no group is gathered, as Spark limits each while it sorts."""
    ranked = rows.select(group, item).distinct().withColumn("_i", F.row_number().over(Window.partitionBy(group).orderBy(item))).where(F.col("_i") <= n)
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", item))), lambda x: x[item].cast("string")), ",").alias("first"))


def guards(files: DataFrame, size: str, largest: int, total: int, count: int) -> DataFrame:
    """guard, value, most and passes: the largest file, all bytes and the number of files against their limits."""
    one = files.agg(F.coalesce(F.max(size), F.lit(0)).cast("long").alias("largest"), F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"), F.count(F.lit(1)).alias("count"))
    each = F.array(*[F.struct(F.lit(name).alias("guard"), F.col(name).alias("value"), F.lit(limit).cast("long").alias("most")) for name, limit in (("largest", largest), ("total", total), ("count", count))])
    return one.select(F.explode(each).alias("g")).select("g.*", (F.col("g.value") <= F.col("g.most")).alias("passes"))


def canonical_array(values: list[Column]) -> Column:
    """Canonical JSON of a list of values: a value a line, two blanks, a final line end. Bytes stand as their SHA-256 and size."""
    return F.concat(F.lit("[\n  "), F.array_join(F.array(*values), ",\n  "), F.lit("\n]\n"))


def json_value(value: Column) -> Column:
    """JSON of a text or number; null for null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.alias("v"))), r'(?s)^\{"v":(.*)\}$', 1), F.lit("null"))


def json_blob(content: Column) -> Column:
    """Bytes as they stand in canonical JSON of a row."""
    shape = '{\n    "sha256": "%s",\n    "size_bytes": %d\n  }'
    return F.when(content.isNull(), "null").otherwise(F.format_string(shape, F.sha2(content, 256), F.octet_length(content)))


def stream_hash(rows: DataFrame, group: str, order: list[str], piece: str, head: str = "") -> DataFrame:
    """group, n, bytes and sha256 of head and the pieces of each group in order, as one stream of UTF-8.

    The digest is that of the published files, so one group is read by one task; it keeps a hash, not the rows.
    """
    kind = rows.schema[group].dataType

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, out = None, None, []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or key != at:
                    if state is not None:
                        out.append((at, state[1], state[2], state[0].hexdigest()))
                    at, state = key, [hashlib.sha256(head.encode()), 0, len(head.encode())]
                data = text.encode()
                state[0].update(data)
                state[1] += 1
                state[2] += len(data)
            if len(out) > 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)
                out.clear()
        if state is not None:
            out.append((at, state[1], state[2], state[0].hexdigest()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], schema)

    from pyspark.sql.pandas.types import to_arrow_type

    names = (group, "n", "bytes", "sha256")
    schema = pa.schema([(group, to_arrow_type(kind)), ("n", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())])
    slim = rows.select(group, F.col(piece).alias("_piece"), *[F.col(c).alias(f"_{c}") for c in order])
    dealt = slim.repartition(group).sortWithinPartitions(group, *[f"_{c}" for c in order]).select(group, "_piece")
    return dealt.mapInArrow(digest, f"`{group}` {kind.simpleString()}, n long, bytes long, sha256 string")
