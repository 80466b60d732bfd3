"""Ordered expectations: earlier stages hold before later ones run, and documents of each kind meet their own rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GateError(RuntimeError):
    """A stage that found problems, with the first few of them."""

    def __init__(self, stage: str, found: list):
        super().__init__(f"{stage}: {found}")
        self.stage, self.found = stage, found


def run(stages: list[tuple[str, Callable[[], DataFrame]]], shown: int = 5) -> list[str]:
    """The names of the stages, each of whose problem relations is empty; the first that isn't ends the run. Later ones aren't even built."""
    passed = []
    for name, problems in stages:
        if found := problems().limit(shown).collect():
            raise GateError(name, found)
        passed.append(name)
    return passed


def by_kind(rows: DataFrame, kind: str, rules: dict[str, list[tuple[Column, str]]]) -> DataFrame:
    """rows with problem, of the rules (holds, name) of their kind the first that fails; a kind without rules is unknown_kind."""
    problem = F.when(~F.coalesce(F.col(kind).isin(*rules), F.lit(False)), "unknown_kind")
    for name, own in rules.items():
        for holds, what in own:
            problem = problem.when((F.col(kind) == name) & ~F.coalesce(holds, F.lit(False)), what)
    return rows.withColumn("problem", problem)


def controls(points: DataFrame, crosswalk: DataFrame, borders: DataFrame, least_border: float) -> DataFrame:
    """id and the first problem of control points (id, zone, places: one or two names).

    crosswalk: name, zone, code; borders: left, right (codes, left first), length. In order: unknown_place, other_zone, no_border (two places
    that share less than least_border of it).
    """
    each = points.select("id", F.col("zone").alias("_zone"), F.posexplode("places").alias("_i", "name")).join(crosswalk.select("name", "zone", "code"), "name", "left")
    rows = each.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("code").isNull()).alias("lost"), F.count_if(~F.col("zone").eqNullSafe(F.col("_zone"))).alias("other"), F.min("code").alias("left"), F.max("code").alias("right"))
    rows = rows.join(borders.select("left", "right", "length"), ["left", "right"], "left")
    short = (F.col("n") == 2) & (F.coalesce("length", F.lit(0.0)) <= least_border)
    problem = F.when(F.col("lost") > 0, "unknown_place").when(F.col("other") > 0, "other_zone").when(short, "no_border")
    return rows.select("id", problem.alias("problem")).where("problem is not null")
