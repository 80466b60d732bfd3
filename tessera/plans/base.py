"""Where queries and their SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        QUERIES[run.__name__] = run
        if sql is not None:
            SQL[run.__name__] = sql
        return run

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name for tables and files that a query writes and reads again: below spark.checkpoint.dir, which a cluster must set."""
    import os
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = f"file://{os.path.join(tempfile.gettempdir(), 'tessera-' + spark.sparkContext.applicationId)}"
        _remove_at_exit(shared.removeprefix("file://"))
    return f"{shared.rstrip('/')}/{name}-{uuid.uuid4().hex}"


_removed: set[str] = set()


def _remove_at_exit(folder: str) -> None:
    import atexit
    import shutil

    if folder not in _removed:
        _removed.add(folder)
        atexit.register(shutil.rmtree, folder, True)
