"""Columns over place names: a key for suggestions, review categories, report cells."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as an apostrophe, and the articles that are written behind a name.
APOSTROPHES = "‘’ʼ`´"
ARTICLE_BEHIND = r"(?i),\s*(?:el|la|els|les|los|las|l')(?=/|\z)"


def suggestion_key(name: Column) -> Column:
    """Key for suggestions only: one apostrophe, no blanks around slashes, single blanks, lower case.

    Accents stay. For names beyond Latin letters use suggestion_key_unicode, which also normalises.
    """
    plain = F.translate(name, APOSTROPHES, "'" * len(APOSTROPHES))
    plain = F.regexp_replace(plain, r"\s*/\s*", "/")
    return F.lower(F.trim(F.regexp_replace(plain, r"\s+", " ")))


def suggestion_key_unicode(name: Column) -> Column:
    """The key with NFKC and case folding, which Spark has no function for."""
    @F.pandas_udf("string")
    def fold(names: pd.Series) -> pd.Series:
        return names.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())

    return F.trim(fold(suggestion_key(name)))


def suggestion_keys(name: Column) -> Column:
    """The whole key and its parts between slashes."""
    whole = suggestion_key(name)
    return F.array_distinct(F.concat(F.array(whole), F.filter(F.split(whole, "/"), lambda p: p != "")))


def review_categories(name: Column, sampled: Column, aliased: Column) -> Column:
    """Why a name must be reviewed, in fixed order; empty if it need not."""
    return F.array_compact(F.array(
        F.when(sampled, "required_sample"), F.when(name.contains("/"), "bilingual"), F.when(name.rlike(ARTICLE_BEHIND), "postposed_article"), F.when(aliased, "alias"),
    ))


def markdown_cell(text: Column) -> Column:
    return F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))


def sort_key(name: Column) -> Column:
    """What published rows are ordered by, before the name itself: the folded name. Beyond Latin letters use suggestion_key_unicode's folding."""
    return F.lower(F.replace(name, F.lit("ß"), F.lit("ss")))


def markdown_row(cells: list[Column]) -> Column:
    """A line of a Markdown table."""
    return F.concat(F.lit("| "), F.array_join(F.array(*map(markdown_cell, cells)), " | "), F.lit(" |"))


def bbox_text(min_x: Column, min_y: Column, max_x: Column, max_y: Column, digits: int = 3) -> Column:
    """A bounding box for reports."""
    return F.format_string(f"[{', '.join([f'%.{digits}f'] * 4)}]", min_x, min_y, max_x, max_y)
