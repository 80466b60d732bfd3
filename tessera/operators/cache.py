"""Results cached by state, period and tile."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEY = ["cache_tag", "z", "x", "y"]


def serve(requests: DataFrame, cached: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (cache_tag, z, x, y, ...) against cached results (KEY, content): (answers, wanted).

    answers: the requests with content, null where it must be made, and hit; wanted: each key to make, once. A tag holds the
    snapshot, the period and, while stale, the date, so entries of other states are never met and need no eviction to be right.
    """
    found = requests.join(cached.select(*KEY, "content"), KEY, "left").withColumn("hit", F.col("content").isNotNull())
    return found, found.where("not hit").select(*KEY).distinct()


def store(cached: DataFrame, made: DataFrame) -> DataFrame:
    """The cache after results (KEY, content) were added: entries that are there stay, failed results (null) are not kept."""
    fresh = made.where("content is not null").select(*KEY, "content").dropDuplicates(KEY).join(cached.select(*KEY), KEY, "left_anti")
    return cached.select(*KEY, "content").unionByName(fresh)
