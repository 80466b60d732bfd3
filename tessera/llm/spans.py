"""Regex matches with their places, by SQL functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import let

MATCH = "array<struct<start:int,end:int,text:string,before:string>>"


def matches(text: Column, pattern: str, before: int = 40) -> Column:
    """All leftmost non-overlapping matches of a Java pattern in a text that isn't null, as MATCH: start and end in code
    points, the matched text, and up to so many characters that stand before it and after the previous match.

    Places are running sums of the lengths of the pieces between matches and of the matches; a text without a match costs
    one pass of the pattern. The pattern must not match the empty string.
    """
    none = F.array().cast(MATCH)

    def placed(found: Column) -> Column:
        def step(acc: Column, i: Column, pieces: Column) -> Column:
            start = acc["at"] + F.length(pieces[i])
            end = start + F.length(found[i])
            item = F.struct(start.alias("start"), end.alias("end"), found[i].alias("text"), F.right(pieces[i], F.lit(before)).alias("before"))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(item)).alias("out"))

        def walk(pieces: Column) -> Column:
            return F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), F.struct(F.lit(0).alias("at"), none.alias("out")), lambda acc, i: step(acc, i, pieces), lambda acc: acc["out"])

        return F.when(F.size(found) == 0, none).otherwise(let(F.split(text, pattern, -1), walk))

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
