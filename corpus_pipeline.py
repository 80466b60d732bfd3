"""From raw documents to packed batches: quality rules, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return the columns of
documents; other columns of the input go. Rows that share a doc_id are one document: the first two filters keep or drop them
together, and the second leaves one of them. Null texts count as empty, and quality rules reject them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontam, ngram_join, packing, pii, quality
from tessera.llm.common import cut, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _only(docs: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """The documents with (left_semi) or without (left_anti) an id in ids; null is an id."""
    own = ids.select(F.col("doc_id").alias("_id"))
    return docs.join(own, F.col("doc_id").eqNullSafe(F.col("_id")), how)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    docs = docs.select(*COLUMNS)
    return _only(docs, quality.measure(docs).where("kept").select("doc_id"), "left_semi")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group linked by a similarity of 0.8 or more on 5-word shingles, the document with the least id; documents with a
    null id all stay. Of rows that share an id the one with the least columns, in their order, stays."""
    docs = docs.select(*COLUMNS)
    ids = cut(ngram_join.join(docs, size=5, percent=80).select("doc_id", "component_id"), "groups")
    kept = _only(docs, ids.where("doc_id <=> component_id or doc_id is null").select("doc_id").distinct(), "left_semi")
    again = ids.where("doc_id is not null").groupBy("doc_id").count().where("count > 1")
    if again.isEmpty():
        return kept
    # only rows of ids that repeat are dealt anew
    single, several = _only(kept, again, "left_anti"), _only(kept, again, "left_semi")
    first = several.groupBy("doc_id").agg(F.min(F.struct(*[F.col(c) for c in COLUMNS[1:]])).alias("row")).select("doc_id", "row.*")
    return single.union(first)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage near a benchmark item."""
    docs = docs.select(*COLUMNS)
    return _only(docs, decontam.find(docs, table(spark, sf_dir, "benchmark")).select("doc_id").distinct(), "left_anti")


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each personal span replaced by its kind; n_chars follows the text."""
    found = pii.find(docs.select(*COLUMNS), keep=COLUMNS[1:])
    text = F.when(F.col("text").isNotNull(), pii.redact(F.col("text"), F.col("spans")))
    return found.withColumn("text", text).select("doc_id", "text", "lang", "source", F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def length_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The batches: a row for each document with its bucket, batch, place and text."""
    return packing.pack(docs, keep=("text",))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("personal_data", personal_data),
    ("length_packing", length_packing),
]

#: SQL cannot express the trained and iterative stages; tests/llm/test_pipeline.py holds them and the documents of run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's rows are written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
