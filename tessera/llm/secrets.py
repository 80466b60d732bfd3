"""Secret scans with an incremental ledger of blobs, by DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .spans import listed, matches


@dataclass(frozen=True)
class Rule:
    """A pattern, the least length of a match, and whether the length is that of the value after the sign."""

    kind: str
    pattern: str
    least: int
    value: str | None = None
    version: int = 1

    def spans(self, text: Column) -> Column:
        def fits(m: Column) -> Column:
            return F.length(m["text"] if self.value is None else F.regexp_extract(m["text"], self.value, 1)) >= self.least

        found = F.filter(matches(text, self.pattern, 0), fits)
        return F.transform(found, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))


# The first three are the contract's; a look-ahead or look-behind only spares the regex engine hopeless starts.
# The others are public formats of credentials.
BASE = (
    Rule("assign", r"""(?=[PSTApsta])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 8, r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 32),
)
MORE = (
    Rule("private_key", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", 20),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}+", 40),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}+", 15),
    Rule("signed_token", r"eyJ[A-Za-z0-9_-]{8,}+\.eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+", 30),
)

LEDGER = "blob string, rule string, version int, spans array<struct<start:int,end:int>>"
SPAN = "array<struct<start:int,rank:int,end:int,kind:string>>"


def scan(versions: DataFrame, ledger: DataFrame | None = None, rules: tuple[Rule, ...] = BASE + MORE, path: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Scan every version of every path once for each content and rule version.

    versions: a row for each version of a path. Its blob is the SHA-256 of its text (null: empty text). ledger: pairs of blob
    and rule version that earlier scans did, with their spans (LEDGER), None at first. Pairs that the ledger has aren't scanned.

    Returns (findings, news): findings has a row for each row of versions: path, blob, spans (SPAN, by start, then the rules'
    order; code points, end exclusive); news is what to append to the ledger, with a row for each newly scanned pair, hits or
    not. Repeated rows, and one path with many contents, give rows of their own; a null path is a path.

    Texts are shuffled once, by path and blob, to those of their rows that are to be scanned; a content with very many copies is
    scanned once, and where the ledger has all pairs no text is shuffled at all. Findings go back to paths by blob, a join of
    small rows that Spark may split when it is skewed.
    """
    spark = versions.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    held = versions.select(F.col(path).alias("path"), body.alias("text"), F.sha2(body.cast("binary"), 256).alias("blob"))
    addressed = cut(held.select("path", "blob"), "addresses")
    todo = F.array(*[F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version")) for r in rules])
    blobs = addressed.groupBy("blob").agg(F.min("path").alias("path"))
    if ledger is None:
        ledger = spark.createDataFrame([], LEDGER)
        unseen = blobs.withColumn("rules", F.array(*[F.lit(r.kind) for r in rules]))
    else:
        pairs = blobs.select("blob", "path", F.explode(todo).alias("r")).select("blob", "path", "r.rule", "r.version")
        unseen = cut(pairs.join(ledger, ["blob", "rule", "version"], "left_anti").groupBy("blob", "path").agg(F.collect_set("rule").alias("rules")), "unseen")
        if unseen.isEmpty():
            held = held.where("false")
    # one source row for a blob: rows that repeat both path and text are scanned more than once, and the first result is kept
    source = held.alias("h").join(unseen.alias("u"), F.col("h.path").eqNullSafe(F.col("u.path")) & (F.col("h.blob") == F.col("u.blob"))).select("h.blob", "h.text", "u.rules")
    none = F.array().cast("array<struct<start:int,end:int>>")
    results = [F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.lit(i).alias("rank"), F.when(F.array_contains("rules", r.kind), r.spans(F.col("text"))).otherwise(none).alias("spans")) for i, r in enumerate(rules)]
    scanned = cut(source.select("blob", "rules", F.filter(F.array(*results), lambda x: F.size(x["spans"]) > 0).alias("hits")).dropDuplicates(["blob"]), "scanned")
    empty = F.map_from_entries(F.transform("hits", lambda h: F.struct(h["rule"], h["spans"])))
    versions_of = F.map_from_entries(F.transform(todo, lambda r: F.struct(r["rule"], r["version"])))
    news = scanned.select("blob", F.explode("rules").alias("rule"), empty.alias("_found"), versions_of.alias("_versions")).select(
        "blob", "rule", F.element_at("_versions", F.col("rule")).alias("version"), F.coalesce(F.try_element_at("_found", F.col("rule")), none).alias("spans")
    )
    ranks = {r.kind: i for i, r in enumerate(rules)}
    rank = F.map_from_arrays(F.array(*map(F.lit, ranks)), F.array(*map(F.lit, ranks.values())))

    def flat(kind: Column, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.element_at(rank, kind).alias("rank"), s["end"].alias("end"), kind.alias("kind")))

    fresh = scanned.where(F.size("hits") > 0).select("blob", F.flatten(F.transform("hits", lambda h: flat(h["rule"], h["spans"]))).cast(SPAN).alias("spans"))
    known = spark.createDataFrame([(r.kind, r.version) for r in rules], "rule string, version int")
    old = ledger.where(F.size("spans") > 0).join(F.broadcast(known), ["rule", "version"]).select("blob", flat(F.col("rule"), F.col("spans")).cast(SPAN).alias("spans"))
    hits = fresh.unionByName(old).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    findings = addressed.join(hits, "blob", "left").select(F.col("path").alias(path), "blob", F.coalesce("spans", F.array().cast(SPAN)).alias("spans"))
    return findings, news


def digest(findings: DataFrame, base: tuple[str, ...] = tuple(r.kind for r in BASE), path: str = "doc_id") -> DataFrame:
    """path, n_<kind> for each base kind, base_sha256 and spans of findings."""
    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    own = of(*base)
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in base]
    return findings.select(path, *counts, F.sha2(listed(own).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
