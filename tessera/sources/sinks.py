"""Artifacts with fixed bytes: small single files, content-addressed snapshots, deterministic ZIPs."""

from __future__ import annotations

import csv
import io
import json
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def atomic_write(path: str, content: bytes) -> None:
    """Write a single local file so that readers see the old or the new one, never a part."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "wb") as out:
            out.write(content)
            out.flush()
            os.fsync(out.fileno())
        os.chmod(temporary, 0o644)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def json_bytes(value: object) -> bytes:
    """Canonical JSON: sorted keys, two blanks, final line end, no NaN."""
    return (json.dumps(value, ensure_ascii=False, indent=2, sort_keys=True, allow_nan=False) + "\n").encode()


def csv_bytes(rows: DataFrame, columns: list[str], order: list[str], most: int = 100_000) -> bytes:
    """A small table as CSV in fixed column and row order; more than `most` rows are an error, as they come to the driver: write_csv takes any number."""
    if extra := set(rows.columns) - set(columns):
        raise ValueError(f"extra columns {sorted(extra)}")
    held = rows.select(*columns).orderBy(*order).limit(most + 1).collect()
    if len(held) > most:
        raise ValueError("too many rows for one file")
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(columns)
    writer.writerows([["" if v is None else v for v in r] for r in held])
    return out.getvalue().encode()


def zip_bytes(members: list[tuple[str, bytes]]) -> bytes:
    """A ZIP whose bytes follow from its members: fixed time, mode and compression."""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as held:
        for name, content in members:
            info = zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0))
            info.compress_type, info.external_attr, info.create_system = zipfile.ZIP_DEFLATED, 0o644 << 16, 3
            held.writestr(info, content, compresslevel=9)
    return out.getvalue()


def promote(contents: DataFrame, root: str) -> DataFrame:
    """Append snapshots (source, content) that root doesn't have yet, by SHA-256; returns source, sha256, size, new of all given.

    The table is partitioned by source. A content that is there is left as it is.
    """
    spark = contents.sparkSession
    own = contents.select("source", F.sha2("content", 256).alias("sha256"), F.octet_length("content").cast("long").alias("size"), "content").dropDuplicates(["source", "sha256"])
    try:
        there = spark.read.parquet(root).select("source", "sha256").withColumn("_there", F.lit(True))
    except Exception as error:
        if "PATH_NOT_FOUND" not in str(error) and "UNABLE_TO_INFER" not in str(error):
            raise
        there = spark.createDataFrame([], "source string, sha256 string, _there boolean")
    marked = own.join(there.distinct(), ["source", "sha256"], "left").withColumn("new", F.col("_there").isNull())
    # the report is a table below root that readers of root do not see, so nothing is computed twice or gathered
    report = f"{root.rstrip('/')}/_reports/{uuid.uuid4().hex}"
    marked.select("source", "sha256", "size", "new").write.parquet(report)
    found = spark.read.schema("source string, sha256 string, size long, new boolean").parquet(report)
    fresh = found.where("new").select("source", "sha256")
    own.join(fresh, ["source", "sha256"], "left_semi").select("sha256", "size", "content", "source").write.mode("append").partitionBy("source").parquet(root)
    return found


def departed(root: str, spark) -> DataFrame:
    """source and sha256 of promoted snapshots whose content no longer has its digest or size."""
    rows = spark.read.parquet(root)
    return rows.where((F.sha2("content", 256) != F.col("sha256")) | (F.octet_length("content") != F.col("size"))).select("source", "sha256")


def write_csv(rows: DataFrame, columns: list[str], order: list[str], path: str) -> None:
    """A table of any size as CSV parts in fixed column and row order: the parts' names sort as their rows do."""
    if extra := set(rows.columns) - set(columns):
        raise ValueError(f"extra columns {sorted(extra)}")
    ranged = rows.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.option("header", True).option("emptyValue", "").option("nullValue", "").option("escape", '"').csv(path)


def verified_copy(files: DataFrame, inventory: DataFrame, target: str, write: bool = True) -> DataFrame:
    """path and problem (missing, extra, changed) of files (path, content) against an inventory (path, sha256); without problems, and with write,
    the files are written as a table and read back, and any that then differ are the problems."""

    def against(rows: DataFrame) -> DataFrame:
        own = rows.select("path", F.sha2("content", 256).alias("_own"), F.lit(True).alias("_there"))
        both = inventory.select("path", "sha256", F.lit(True).alias("_asked")).join(own, "path", "full_outer")
        problem = F.when(F.col("_there").isNull(), "missing").when(F.col("_asked").isNull(), "extra").when(F.col("_own") != F.col("sha256"), "changed")
        return both.select("path", problem.alias("problem")).where("problem is not null")

    found = against(files)
    if not write or not found.isEmpty():
        return found
    files.select("path", "content").write.mode("errorifexists").parquet(target)
    return against(files.sparkSession.read.parquet(target))


def swap_folder(target: str, fill) -> None:
    """Let fill(folder) make a local folder and put it in place at once; a target that is there is kept and is an error."""
    if os.path.exists(target):
        raise FileExistsError(target)
    stage = tempfile.mkdtemp(dir=os.path.dirname(os.path.abspath(target)), prefix=".stage-")
    try:
        fill(stage)
        os.chmod(stage, 0o755)
        os.rename(stage, target)
    except BaseException:
        shutil.rmtree(stage, ignore_errors=True)
        raise


def self_sized(manifest: dict, others: int, field: str = "total_bytes", rounds: int = 20) -> bytes:
    """Canonical JSON of a manifest whose field is the bytes of all others and of itself."""
    total = others
    for _ in range(rounds):
        data = json_bytes(manifest | {field: total})
        if others + len(data) == total:
            return data
        total = others + len(data)
    raise ValueError("the manifest's size does not settle")


def build(artifacts: dict[str, bytes], folder: str) -> dict[str, str]:
    """Write artifacts that were all made before, each at once; returns their SHA-256."""
    import hashlib

    for name, content in artifacts.items():
        path = os.path.join(folder, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        atomic_write(path, content)
    return {name: hashlib.sha256(content).hexdigest() for name, content in artifacts.items()}


def validate(artifacts: dict[str, bytes], folder: str) -> list[str]:
    """Names of artifacts whose stored file is not there or differs from the bytes made anew."""
    wrong = []
    for name, content in artifacts.items():
        path = os.path.join(folder, name)
        if not os.path.isfile(path):
            wrong.append(name)
            continue
        with open(path, "rb") as held:
            if held.read() != content:
                wrong.append(name)
    return wrong
