"""Self-join of documents by Jaccard similarity of word shingles, with adaptive multi-match prefixes.

All shingles have one global order. Of a set with n shingles let t = ceil(percent * n / 100), the least overlap with any
partner, and p = n - t + 1. Two partners share at least l of the first p + l - 1 shingles of each, for every l (with both
lengths cut at n), and at least the lesser l when their l differ. So a longer prefix must have more shared shingles.

A prefix shingle that few documents have is light, else heavy; only light ones are looked up. With h heavy ones in its prefix
a document with h < l still shares a light one with each partner of like or greater l. Each document takes, of some l that
allow this, the one with the least estimated cost: pairs that its light lists make, plus the verifications that l matches
leave of them. The first level orders shingles by hash, so that prefixes are all it needs to hold. Documents that are too
heavy for it can only miss partners that are as heavy: these go to the second level, among themselves and with whole sets,
where rare shingles come first. What is too heavy even there has hardly a light shingle: large groups of near copies.

Of these each list of a heavy prefix shingle is compared with its most central document b only. Let D(x) be the shingles that
either x or b has, but not both. Then x and y differ in |D(x)| + |D(y)| - 2 |D(x) & D(y)| shingles, so if they are linked and
D(x) and D(y) share nothing, both are linked with b. What is left to compare are pairs of which one isn't linked with b and
whose D share one of their rarest; as x and y differ in n / 9 shingles at most (at 90 percent), so many of D(x) plus one do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop, let, lower_ascii, words
from .components import components


def least_overlap(n: Column, percent: int) -> Column:
    return F.floor((n * percent + 99) / 100).cast("int")


def shortest(n: Column, percent: int) -> Column:
    """p: the prefix length at which partners share one shingle."""
    return n - least_overlap(n, percent) + 1


def prefix(n: Column, percent: int, more: float) -> Column:
    """Prefix length, p and `more` times p, n at most."""
    p = shortest(n, percent)
    return F.least(n, p + F.floor(p * more).cast("int"))


def matches(n: Column, percent: int, more: float) -> Column:
    """l: the shingles that partners must share in prefixes of this length."""
    return prefix(n, percent, more) - shortest(n, percent) + 1


def shingles(text: Column, size: int) -> Column:
    """Hashes (64 bits) of a text's distinct shingles in ascending order; of fewer words, one shingle of them all; none without words.

    A shingle's hash is that of its words' hashes, so each word is hashed once.
    """
    plain = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(lower_ascii(text))

    def hashed(w: Column) -> Column:
        def windows(h: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.size(h) - size), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(size)]))

        many = let(F.transform(w, lambda x: F.xxhash64(x)), windows)
        return F.when(F.size(w) >= size, F.sort_array(F.array_distinct(many))).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))

    return let(words(plain), hashed)


def similar_sizes(a: Column, b: Column, percent: int) -> Column:
    return (100 * F.least(a, b) >= percent * F.greatest(a, b))


def probe(sets: DataFrame, percent: int, more: float, light: int, rarity: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """One level over sets (id, n, toks): pairs a < b to verify, documents too heavy for it (id, n, light: how many light
    shingles are in what was looked at, heavy: the heavy ones of the shortest prefix), and the written table that both read.

    toks holds at least the longest prefix by hash; with rarity it is the whole set, and rare shingles come first.
    """
    span = F.col("n") if rarity else prefix(F.col("n"), percent, more)
    rows = sets.select("id", "n", F.posexplode(F.slice("toks", F.lit(1), span)).alias("rank", "token"))
    freq = rows.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    shared = rows.join(freq, "token").groupBy("id", "n").agg(F.collect_list(F.struct("rank", "token", "df")).alias("toks"))
    fewest = matches(least_overlap(F.col("n"), percent), percent, more)
    steps = sorted({0.0, more / 4, more / 2, more})

    def weigh(toks: Column, step: float) -> Column:
        size, l = prefix(F.col("n"), percent, step), matches(F.col("n"), percent, step)

        def cost(x: Column) -> Column:
            h = F.size(F.filter(x, lambda y: y["df"] > light))
            pairs = F.aggregate(x, F.lit(0.0), lambda acc, y: acc + F.when(y["df"] <= light, (y["df"] - 1).cast("double")).otherwise(0.0))
            # at most pairs / l documents have l matches; each verification reads n shingles
            return F.struct(F.when(h < l, pairs * (1 + F.col("n") / 8 / l)).otherwise(float("inf")).alias("cost"), size.alias("size"), l.alias("l"), h.alias("h"))

        return let(F.filter(toks, lambda x: x["rank"] < size), cost)

    def choose(toks: Column) -> Column:
        def take(odd: Column, plan: Column) -> Column:
            own = F.filter(toks, lambda x: (x["rank"] < plan["size"]) & (x["df"] <= light))
            heavy = F.filter(toks, lambda x: (x["df"] > light) & (x["rank"] < shortest(F.col("n"), percent)))
            return F.struct(
                odd.alias("odd"), plan["l"].alias("l"), plan["h"].alias("h"), F.transform(own, lambda x: x["token"]).alias("own"), F.when(odd, F.transform(heavy, lambda x: x["token"])).alias("heavy"),
                (F.col("n") - F.size(F.filter(toks, lambda x: x["df"] > light))).alias("light"),
            )

        def decide(plans: Column) -> Column:
            odd = plans[len(steps) - 1]["h"] >= fewest
            return let(F.struct(odd.alias("odd"), F.when(odd, plans[len(steps) - 1]).otherwise(F.array_min(plans)).alias("plan")), lambda c: take(c["odd"], c["plan"]))

        return let(F.array(*[weigh(toks, s) for s in steps]), decide)

    def by_rarity(toks: Column) -> Column:
        # shingles of one document come before all these
        first = F.col("n") - F.size(toks)
        return let(F.sort_array(F.transform(toks, lambda x: F.struct(x["df"], x["token"]))), lambda r: F.transform(r, lambda x, i: F.struct((first + i).alias("rank"), x["token"].alias("token"), x["df"].alias("df"))))

    plan = let(by_rarity(F.col("toks")), choose) if rarity else choose(F.col("toks"))
    kept = shared.select("id", "n", plan.alias("plan")).select("id", "n", "plan.*").where(F.col("odd") | (F.size("own") > 0))
    kept = cut(kept, "prefixes", "lz4", release=True)
    looked = kept.select("id", "n", "l", "h", F.explode("own").alias("token"))
    a, b = looked.alias("a"), looked.alias("b")
    met = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & similar_sizes(F.col("a.n"), F.col("b.n"), percent))
    counted = met.groupBy(F.col("a.id").alias("a"), F.col("b.id").alias("b")).agg(F.count(F.lit(1)).alias("c"), F.min(F.least("a.l", "b.l")).alias("l"), F.min(F.least("a.h", "b.h")).alias("h"))
    pairs = counted.where(F.col("c") + F.col("h") >= F.col("l")).select("a", "b")
    return pairs, kept.where("odd").select("id", "n", "light", "heavy"), kept


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets (id, n, toks) reach the similarity, exactly."""
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("n").alias("na"), F.col("toks").alias("ta")), "a")
    both = left.join(sets.select(F.col("id").alias("b"), F.col("n").alias("nb"), F.col("toks").alias("tb")), "b")
    shared = F.size(F.array_intersect("ta", "tb"))
    return both.select("a", "b", "na", "nb", shared.alias("i")).where((100 + percent) * F.col("i") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def join(docs: DataFrame, size: int = 3, percent: int = 90, light: int = 64, first: float = 0.5, second: float = 1.0, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Components of the documents under links of Jaccard similarity percent / 100 or more, by whole texts.

    size: words of a shingle. light: most documents that a shingle which is looked up may have. first, second: the longest
    prefixes of the two levels, as so many p more than p. These three only shift work.

    Returns a row for each row of docs: key, n_shingles, class_id (the least key with the same set) and component_id (the least
    key reachable by links). A null or empty text, or one without words, has no shingles and links with nothing. Each row is a
    document of its own, also where rows share a key: two rows with one key and different texts are linked only by their texts. A null
    key takes part like any other; least keys are those of the keys that are there, null if none is.

    Documents with equal sets are one class (by two 64-bit hashes of the set), numbered by its first row, and only that row takes
    part. Prefixes are written; shingles of whole sets are made again for the classes of pairs only. Components are computed by
    contraction.
    """
    slim = docs.select(F.col(key).cast("long").alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    made = slim.select("id", F.xxhash64("text").alias("h"), let(shingles(F.col("text"), size), lambda s: F.struct(F.size(s).alias("n"), F.xxhash64(s).alias("f"), F.xxhash64(F.reverse(s)).alias("g"), F.slice(s, F.lit(1), F.greatest(F.lit(1), prefix(F.size(s), percent, first))).alias("toks"))).alias("s"))
    held = cut(made.select("id", "h", F.monotonically_increasing_id().alias("row"), "s.*"), "sets", "lz4")
    classes = cut(held.where("n > 0").groupBy("n", "f", "g").agg(F.min("id").alias("rep"), F.min("row").alias("node")), "classes")
    reps = held.join(classes.select(F.col("node").alias("row")), "row", "left_semi").select(F.col("row").alias("id"), "n", "toks")

    pairs, odd, prefixes = probe(reps, percent, first, light)
    pairs, odd = cut(pairs, "pairs", release=True), cut(odd, "odd")
    drop(prefixes)
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).union(odd.select("id")).distinct()
    # by sort and merge at every size: what is wanted grows with the input
    key_of = [F.coalesce("id", F.lit(0)).alias("key"), F.col("id").isNull().alias("none")]
    wanted = held.join(ids.withColumnRenamed("id", "row"), "row").select(*key_of, "h", "row")
    # rows that share a key may have other texts, told by a hash, or the same one again
    keyed = slim.select(*key_of, F.xxhash64("text").alias("h"), "text").hint("merge").join(wanted.hint("merge"), ["key", "none", "h"])
    whole = keyed.dropDuplicates(["key", "none", "h"]).select(F.col("row").alias("id"), shingles(F.col("text"), size).alias("toks")).select("id", F.size("toks").alias("n"), "toks")
    whole = cut(whole, "whole", "lz4", release=True)
    edges = cut(verify(pairs, whole, percent), "links")
    if not odd.isEmpty():
        again, rest, prefixes = probe(whole.join(odd.select("id"), "id", "left_semi"), percent, second, light, rarity=True)
        again, rest = cut(again, "pairs"), cut(rest, "odd")
        drop(prefixes)
        edges = cut(edges.union(verify(again, whole, percent)), "links")
        if not rest.isEmpty():
            edges = _groups(rest, edges, whole, percent)
    drop(whole)
    roots = components(edges)
    named = classes.join(roots, "node", "left").select("n", "f", "g", "rep", F.coalesce("root", "node").alias("root"))
    least = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "root").select("n", "f", "g", "rep", "component_id")
    return held.select("id", "n", "f", "g").join(named, ["n", "f", "g"], "left").select(
        F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.coalesce("rep", "id").alias("class_id"), F.coalesce("component_id", "id").alias("component_id")
    )


def _groups(rest: DataFrame, edges: DataFrame, whole: DataFrame, percent: int) -> DataFrame:
    """Links among documents whose lists are long (id, n, light, heavy): with a central document of each list, then by differences."""
    lists = rest.select("id", "n", "light", F.explode("heavy").alias("token"))
    hubs = lists.groupBy("token").agg(F.min(F.struct("light", F.xxhash64("id").alias("h"), "id")).alias("hub"))
    pairs = cut(lists.join(hubs, "token").select("id", F.col("hub.id").alias("hub")).distinct().where("id != hub"), "stars")
    sets = whole.select("id", "n", "toks")
    met = pairs.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("n").alias("hub_n"), F.col("toks").alias("hub_toks")), "hub")
    signed = F.concat(F.transform(F.array_except("toks", "hub_toks"), lambda t: F.struct(F.lit(1).alias("side"), t.alias("token"))), F.transform(F.array_except("hub_toks", "toks"), lambda t: F.struct(F.lit(0).alias("side"), t.alias("token"))))
    differ = met.select("hub", "id", "n", "hub_n", signed.alias("d"))
    # |x & b| = (|x| + |b| - |D|) / 2
    linked = (100 + percent) * (F.col("n") + F.col("hub_n") - F.size("d")) >= 2 * percent * (F.col("n") + F.col("hub_n"))
    differ = cut(differ.select("hub", "id", "n", "d", linked.alias("linked")), "differences", "lz4")
    edges = cut(edges.union(differ.where("linked").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b"))), "links")

    roots = components(edges)
    rows = differ.select("hub", "id", F.explode("d").alias("s")).select("hub", "id", "s.side", "s.token")
    rarity = rows.groupBy("hub", "side", "token").agg(F.count(F.lit(1)).alias("df")).where(F.col("df") > 1)
    ranked = rows.join(rarity, ["hub", "side", "token"]).groupBy("hub", "id").agg(F.sort_array(F.collect_list(F.struct("df", "side", "token"))).alias("d"))
    held = ranked.join(differ.select("hub", "id", "n", "linked", F.size("d").alias("size")), ["hub", "id"]).join(roots, F.col("id") == F.col("node"), "left")
    # partners differ in this many shingles at most: n of the greater set is n * 100 / percent
    most = F.floor(F.col("n") * (100 - percent) / percent).cast("int")
    # shingles that only this document differs in come first
    own = F.col("size") - F.size("d")
    room = F.greatest(F.lit(0), F.least(F.col("size"), most + 1) - own)
    short = held.select("hub", "id", "n", "linked", "size", own.alias("own"), F.coalesce("root", "id").alias("root"), F.posexplode(F.slice("d", F.lit(1), room)).alias("i", "s"))
    # left: how many shingles of D come with this one and after it
    short = cut(short.select("hub", "id", "n", "linked", "size", "root", (F.col("size") - F.col("own") - F.col("i")).alias("left"), "s.side", "s.token"), "rarest")
    a, b = short.where("not linked").alias("a"), short.alias("b")
    same = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.side") == F.col("b.side")) & (F.col("a.token") == F.col("b.token"))
    # at the first shingle that two D share, all they share is among what is left: enough for |D(x)| + |D(y)| - 2 |D(x) & D(y)|
    # to be within what partners of these sizes differ in
    differ_most = F.floor((F.col("a.n") + F.col("b.n")) * (100 - percent) / (100 + percent))
    enough = 2 * F.least("a.left", "b.left") >= F.col("a.size") + F.col("b.size") - differ_most
    found = a.join(b, same & (F.col("a.root") != F.col("b.root")) & enough & similar_sizes(F.col("a.n"), F.col("b.n"), percent))
    found = cut(found.select(F.least("a.id", "b.id").alias("a"), F.greatest("a.id", "b.id").alias("b")).distinct(), "pairs")
    out = cut(edges.union(verify(found, whole, percent)), "links")
    drop(differ, short)
    return out
