"""Quality rules: base counts, and divergence from the document's language, by DataFrame functions alone."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BLANK, cut, let, words

# Classes of characters that are counted one by one; blanks and lower-case letters a-z follow from the rest.
CLASSES = {"upper": "[A-Z]", "digit": "[0-9]", "mark": "[.,;:!?'\"()-]", "symbol": r"[#*$%&|<>@=_/\\^~`+{}\[\]]", "control": r"[\x00-\x08\x0E-\x1F\x7F]", "other": r"[^\x00-\x7F]"}
#: Classes of a histogram: these, blanks, lower-case letters.
WIDTH = len(CLASSES) + 2


@dataclass(frozen=True)
class Limits:
    """common: words in a language's list, of any length. Divergence counts from so many characters or words on.
    languages: lists and references of up to so many are broadcast, for more Spark chooses the join. A document is rejected over
    a Jensen-Shannon distance (0 to 1, square root of the divergence in bits)."""

    common: int = 24
    least_chars: int = 200
    least_words: int = 50
    languages: int = 256
    char_distance: float = 0.3
    word_distance: float = 0.45


def repeated_words(own: Column) -> Column:
    """Words that lie in a 5-word window found twice or more in the array.

    Most texts repeat none: that shows when hashes of the windows are distinct. Else the windows themselves are sorted with
    their places, those with an equal neighbour are marked, and the lengths that the marked windows cover are summed.
    """

    def covered(places: Column) -> Column:
        # each marked window covers 5 words, less what the next one covers too
        gaps = F.zip_with(places, F.concat(F.slice(places, 2, F.size(places)), F.array(F.lit(1 << 30))), lambda a, b: F.least(F.lit(5), b - a))
        return F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)

    def marked(ranked: Column) -> Column:
        def twin(x: Column, i: Column) -> Column:
            return F.coalesce(F.get(ranked, i - 1)["w"] == x["w"], F.lit(False)) | F.coalesce(F.get(ranked, i + 1)["w"] == x["w"], F.lit(False))

        return let(F.array_sort(F.transform(F.filter(ranked, twin), lambda x: x["i"])), lambda p: F.when(F.size(p) == 0, 0).otherwise(covered(p)))

    def exact(w: Column) -> Column:
        windows = F.transform(F.sequence(F.lit(1), F.size(w) - 4), lambda i: F.struct(F.array_join(F.slice(w, i, 5), " ").alias("w"), i.alias("i")))
        return let(F.sort_array(windows), marked)

    def checked(w: Column) -> Column:
        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(h) - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))

        each = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return let(each, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(exact(w)))

    return F.when(F.size(own) < 6, 0).otherwise(let(own, checked)).cast("long")


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def class_counts(text: Column, rest: Column, in_words: Column) -> Column:
    """Characters of each class, then blanks and lower-case letters. rest: the text without letters a-z and spaces, which holds
    all the others and is short; in_words: characters in words."""
    counts = [F.length(rest) - F.length(F.regexp_replace(rest, f"{c}+", "")) for c in CLASSES.values()]

    def whole(c: Column) -> Column:
        return F.concat(c, F.array(F.length(text) - in_words, in_words - F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)))

    return let(F.array(*counts).cast("array<long>"), whole).cast("array<long>")


def common_counts(own: Column, listed: Column, longest: Column) -> Column:
    """How often each word of the list is among the words, lower-cased; all other words last. Null without a list.

    longest: characters of the list's longest word. No longer word can be in it, as lower case never has fewer characters, so
    these are not looked up."""
    short = F.filter(own, lambda w: F.length(w) <= longest)
    places = F.filter(F.transform(short, lambda w: F.array_position(listed, F.lower(w)).cast("int")), lambda p: p > 0)

    def count(p: Column) -> Column:
        return F.concat(F.transform(F.sequence(F.lit(1), F.size(listed)), lambda k: F.size(p) - F.size(F.array_remove(p, k))), F.array(F.size(own) - F.size(p)))

    return F.when(listed.isNotNull() & (F.size(listed) > 0), let(places, count)).cast("array<long>")


def shannon(p: Column, q: Column) -> Column:
    """Jensen-Shannon distance of two histograms of one length, of any totals; null where one is empty or null."""

    def total(h: Column) -> Column:
        return F.aggregate(h, F.lit(0.0), lambda a, x: a + x.cast("double"))

    def term(a: Column, b: Column) -> Column:
        return F.when(a > 0, a * F.log2(2 * a / (a + b))).otherwise(0.0)

    def distance(s: Column) -> Column:
        each = F.zip_with(p, q, lambda a, b: term(a / s["p"], b / s["q"]) + term(b / s["q"], a / s["p"]))
        return F.when((s["p"] > 0) & (s["q"] > 0), F.sqrt(F.greatest(F.lit(0.0), F.aggregate(each, F.lit(0.0), lambda a, x: a + x) / 2)))

    return F.when(p.isNotNull() & q.isNotNull(), let(F.struct(total(p).alias("p"), total(q).alias("q")), distance))


def common_words(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, its list of most frequent words, counted over all documents, and the longest one's characters; ties in order of the word."""
    word = docs.select(F.col(lang).alias("_lang"), F.explode(F.split(F.lower(F.col(text)), BLANK + "+")).alias("word"))
    counts = word.where(F.col("word") != "").groupBy("_lang", "word").count()
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.desc("count"), "word"))).where(F.col("rank") <= limits.common)
    lists = best.groupBy("_lang").agg(F.array_sort(F.collect_list(F.struct("rank", "word"))).alias("_list")).select("_lang", F.transform("_list", lambda x: x["word"]).alias("_list"))
    return lists.withColumn("_longest", F.array_max(F.transform("_list", lambda x: F.length(x))))


def _by_language(rows: DataFrame, sums: DataFrame, limits: Limits) -> DataFrame:
    """rows with what sums, a written table, has for their language; null is one."""
    return rows.join(F.broadcast(sums) if sums.count() <= limits.languages else sums, F.col("_lang").eqNullSafe(F.col("_own")), "left")


def measure(docs: DataFrame, limits: Limits = Limits(), key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Counts, distances and verdicts of every document, by its whole text.

    Returns key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, char_distance, word_distance, kept.
    A language's reference is the sum of its documents' histograms, however few they are or many languages there are; null is a
    language too. A language's only document is its own reference, at distance 0. A distance is null, and rejects nothing, for
    documents under the length guards. A null or empty text has no words and
    fails; repeated rows give rows of their own and count in the references; an empty input gives no rows.

    Words are counted by language over all documents (partial sums, then a top list per language), then each document is
    read once. Lists and references of at most `languages` languages are broadcast; more are joined as Spark sees fit.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    slim = docs.select(F.col(key).alias("_key"), F.col(lang).alias("_lang"), body.alias("_text"))
    lists = cut(common_words(slim, limits, "_text", "_lang"), "common")
    held = _by_language(slim, lists.withColumnRenamed("_lang", "_own"), limits)

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"), common_counts(w, F.col("_list"), F.col("_longest")).alias("common"),
        )

    held = held.withColumn("_rest", F.regexp_replace("_text", r"[a-z\x20]+", ""))
    features = held.select(
        "_key", "_lang", "_text", "_rest", let(words(F.col("_text")), counted).alias("w"), F.length(F.regexp_replace("_rest", r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        duplicate_lines(F.col("_text")).alias("n_dup_lines"),
    )
    features = features.select("_key", "_lang", "w.*", "n_symbols", "n_dup_lines", class_counts(F.col("_text"), F.col("_rest"), F.col("w.word_chars")).alias("classes"))
    features = cut(features, "features")
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(WIDTH)] + [F.sum(F.get("common", F.lit(i))).alias(f"w{i}") for i in range(limits.common + 1)]
    totals = features.groupBy("_lang").agg(*sums)
    references = totals.select(
        F.col("_lang").alias("_own"), F.array(*[F.col(f"c{i}") for i in range(WIDTH)]).alias("_classes"), F.array_compact(F.array(*[F.col(f"w{i}") for i in range(limits.common + 1)])).alias("_common")
    )
    far = _by_language(features, cut(references, "references"), limits)
    chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    verdicts = far.withColumns({
        "char_distance": F.when(chars >= limits.least_chars, shannon(F.col("classes"), F.col("_classes"))),
        "word_distance": F.when(F.col("n_words") >= limits.least_words, shannon(F.col("common"), F.col("_common"))),
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
    })
    near = (F.coalesce("char_distance", F.lit(0.0)) <= limits.char_distance) & (F.coalesce("word_distance", F.lit(0.0)) <= limits.word_distance)
    return verdicts.select(
        F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "char_distance", "word_distance", (~F.col("base_failed") & near).alias("kept")
    )
