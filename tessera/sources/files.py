"""Files with a contract: documents, control tables, inventories, binaries, ZIP members."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A file whose form isn't the one agreed."""


def documents(spark: SparkSession, path: str) -> DataFrame:
    """doc (file path), body (whole text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("doc"), F.col("value").alias("body"))


def control_table(spark: SparkSession, path: str, columns: list[str], exact: bool = True) -> DataFrame:
    """A CSV of text columns; its header must be these columns in order, or with exact=False hold them all."""
    header = spark.read.text(path).limit(1).collect()
    names = header[0][0].rstrip("\r").lstrip("﻿").split(",") if header else []
    if names != columns and (exact or not set(columns) <= set(names)):
        raise ContractError(f"header {names}, expected {columns}")
    schema = T.StructType([T.StructField(c, T.StringType()) for c in names])
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("mode", "FAILFAST").option("nullValue", "\0").option("emptyValue", "").option("escape", "\"").csv(path).select(*columns).na.fill("")


def json_rows(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An array of objects; a row that doesn't fit fails the job."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_array(spark: SparkSession, path: str, fields: dict[str, str]) -> DataFrame:
    """doc, index and typed fields (name to int or string) of files that each hold an array of objects.

    Values are typed strictly: 9 and 9.0 are an int, "9" and true are not. A file that is no array, or the first row that lacks a field or has
    it in another type, is a ContractError that tells file, row and field. Other fields go.
    """
    from ..operators.feed import items, strict_int, strict_string

    held = documents(spark, path).select("doc", items(F.try_parse_json("body"), "$").alias("rows"))
    typed = held.select("doc", F.posexplode_outer("rows").alias("index", "r"), F.col("rows").isNull().alias("_none"))
    typed = typed.select("doc", "index", "_none", *[(strict_int if kind == "int" else strict_string)(F.col("r"), f"$.{name}").alias(name) for name, kind in fields.items()])
    lacks = F.when(F.col("_none"), "$").otherwise(F.coalesce(*[F.when(F.col(name).isNull() & F.col("index").isNotNull(), name) for name in fields]))
    for bad in typed.withColumn("_lacks", lacks).where("_lacks is not null").orderBy("doc", "index").limit(1).collect():
        raise ContractError(f"{bad['doc']}: no array" if bad["_none"] else f"{bad['doc']}: row {bad['index']}, field {bad['_lacks']}")
    return typed.where("index is not null").drop("_none")


def config(body: str, version: int, required: list[str], exact: bool = False) -> dict:
    """A configuration document: a JSON object of this schema_version with the required keys, with exact no others."""
    import json

    try:
        value = json.loads(body)
    except ValueError as error:
        raise ContractError("not JSON") from error
    if not isinstance(value, dict) or value.get("schema_version") != version or isinstance(value.get("schema_version"), bool):
        raise ContractError(f"not an object of schema_version {version}")
    missing, extra = set(required) - set(value), set(value) - set(required) - {"schema_version"}
    if missing or exact and extra:
        raise ContractError(f"missing {sorted(missing)}, extra {sorted(extra) if exact else []}")
    return value


def member_problems(members: DataFrame, key: str, expected: list[str]) -> DataFrame:
    """key and problem of archives (key, seq, name, problem of zip_members) whose members aren't exactly these, in this order."""
    own = members.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("name", F.lit("")).alias("name"), F.col("problem")))).alias("m"))
    first = F.get(F.filter("m", lambda x: x["problem"].isNotNull()), F.lit(0))["problem"]
    names = F.transform("m", lambda x: x["name"])
    return own.select(key, F.coalesce(first, F.when(names != F.array(*map(F.lit, expected)), "members")).alias("problem")).where("problem is not null")


def inventory(spark: SparkSession, path: str, lines: int | None = None) -> DataFrame:
    """sha256, path of an inventory of lines '<64 hex>  <path>'; another line, a path twice, or another number of lines than agreed, is an error."""
    rows = spark.read.text(path).where("value <> ''")
    if lines is not None and (n := rows.count()) != lines:
        raise ContractError(f"{n} lines, expected {lines}")
    parsed = rows.select(F.regexp_extract("value", r"^([0-9a-f]{64})  (\S.*)\z", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (\S.*)\z", 2).alias("path"))
    bad = parsed.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.min("sha256").alias("least")).where("n > 1 or least = ''")
    if not bad.isEmpty():
        raise ContractError("malformed or repeated inventory line")
    return parsed


def binaries(spark: SparkSession, root: str, content: bool = True) -> DataFrame:
    """path below root, length and, if asked, content and sha256 of all files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    name = F.regexp_replace("path", r"^file:/+", "/")
    base = root.removeprefix("file://").rstrip("/") + "/"
    rows = files.select(F.substring(name, F.lit(len(base) + 1), F.length(name)).alias("path"), "length", *(["content"] if content else []))
    return rows.withColumn("sha256", F.sha2("content", 256)) if content else rows


def zip_members():
    """A table function zip_members(binary, limit): seq, name, size, crc_ok, problem of each member.

    Encrypted members, links, members over the limit and names that leave the folder or repeat have a problem.
    """
    from pyspark.sql.functions import udtf

    @udtf(returnType="seq int, name string, size long, crc_ok boolean, problem string")
    class Members:
        def eval(self, data: bytes, limit: int):
            import io
            import zipfile

            try:
                held = zipfile.ZipFile(io.BytesIO(bytes(data)))
            except zipfile.BadZipFile:
                yield -1, None, None, False, "not_a_zip"
                return
            seen = set()
            for i, m in enumerate(held.infolist()):
                problem = None
                if m.filename in seen:
                    problem = "duplicate"
                elif m.flag_bits & 1:
                    problem = "encrypted"
                elif m.external_attr >> 28 == 0xA:
                    problem = "link"
                elif m.file_size > limit:
                    problem = "too_large"
                elif m.filename.startswith("/") or ".." in m.filename.split("/"):
                    problem = "path"
                seen.add(m.filename)
                ok = False
                if problem is None:
                    try:
                        held.read(m)
                        ok = True
                    except (zipfile.BadZipFile, RuntimeError):
                        problem = "checksum"
                yield i, m.filename, m.file_size, ok, problem

    return Members
