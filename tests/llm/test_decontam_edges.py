"""Passages at the edge of the similarity, and benchmarks with several texts under one id."""

import math
import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from tessera.llm import decontam


def fresh(rng, n):
    return ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]


def edited(rng, own, k):
    """The item with as many words replaced as a similarity of 0.8 allows, at its start or its end."""
    lost = (len(own) - 4) // 9
    return fresh(rng, lost) + own[lost:] if k % 2 else own[:-lost] + fresh(rng, lost)


def test_passages_edited_at_an_edge_are_found(spark):
    rng = random.Random(4)
    own = [fresh(rng, (23, 32, 59)[i % 3]) for i in range(180)]
    rows = [(i, " ".join(fresh(rng, 30) + edited(rng, w, i) + fresh(rng, 30))) for i, w in enumerate(own)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(own)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find(docs, bench).collect()}
    assert set(got) == {(i, i) for i in range(180)}
    assert any(r["distance"] > 13 for r in got.values()) and all(0.8 <= r["similarity"] < 0.85 for r in got.values())


def test_similarity_of_sets_equals_that_of_counts(spark):
    rows = [(["a", "b", "c"], ["b", "c", "d"]), (["a", "a", "b"], ["a", "b", "b"]), (["a"], ["b"]), ([], ["b"]), ([], [])]
    frame = spark.createDataFrame(rows, "a array<string>, b array<string>")
    weights = F.create_map(F.lit("a"), F.lit(1.0), F.lit("b"), F.lit(2.0), F.lit("c"), F.lit(4.0))
    got = [r[0] for r in frame.select(decontam.weighted_jaccard(F.col("a"), F.col("b"), weights, F.lit(8.0))).collect()]
    assert got == [6 / 15, 3 / 6, 0.0, 0.0, 0.0]


def test_all_texts_of_an_id_are_looked_for(spark):
    rng = random.Random(5)
    own = [fresh(rng, 20) for _ in range(6)]
    ids = [7, 7, 7, None, None, 8]
    docs = spark.createDataFrame([(i, " ".join(fresh(rng, 30) + w + fresh(rng, 30))) for i, w in enumerate(own)], "doc_id long, text string")
    rows = [(k, " ".join(w)) for k, w in zip(ids, own, strict=True)]
    bench = spark.createDataFrame(rows + rows[:1], "item_id long, text string")
    for n in (1_000_000, 0):
        got = [(r["doc_id"], r["item_id"]) for r in decontam.find(docs, bench, broadcast_shingles=n).collect()]
        assert len(got) == 6 and set(got) == set(enumerate(ids))
    # one document with all texts has one row for each id
    both = spark.createDataFrame([(1, " ".join(sum(own, [])))], "doc_id long, text string")
    assert sorted(str(r["item_id"]) for r in decontam.find(both, bench).collect()) == ["7", "8", "None"]


def all_windows(w, item, weight, short=False):
    """(similarity, start) of every window of the item's length; with short, also of the shorter ones at the text's end."""
    grams = lambda x: Counter(tuple(x[i : i + 5]) for i in range(len(x) - 4))
    own = grams(item)
    for s in range(len(w) if short else len(w) - len(item) + 1):
        here = grams(w[s : s + len(item)])
        yield sum(weight[g] * n for g, n in (own & here).items()) / sum(weight[g] * n for g, n in (own | here).items()), s


def test_hits_are_those_of_all_windows(spark):
    """Passages with words put in, left out and replaced anywhere, by length of the item: hits and best windows as over all windows."""
    rng = random.Random(6)
    items = {i: fresh(rng, (15, 22, 31, 58, 103)[i % 5]) for i in range(100)}
    for i in range(0, 100, 10):
        items[i][:8] = items[(i + 5) % 100][:8]  # some shingles of two items
    docs = {}
    for k, own in items.items():
        w = list(own)
        for _ in range(rng.randint(0, (len(own) - 4) // 9 + 1)):
            at = rng.choice([0, len(w) - 1, rng.randrange(len(w)), rng.randrange(5)])
            w[at : at + rng.randint(0, 1)] = fresh(rng, rng.randint(0, 1))
        docs[k] = fresh(rng, rng.randint(0, 30)) + w + fresh(rng, rng.randint(0, 30))
    df = Counter(g for w in items.values() for g in {tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    weight = defaultdict(lambda: math.log(1 + len(items)), {g: math.log(1 + len(items) / n) for g, n in df.items()})
    want = {}
    for k, w in docs.items():
        for i, own in items.items():
            best = max(all_windows(w, own, weight), key=lambda x: (x[0], -x[1]), default=(0, 0))
            if best[0] >= 0.8 - 1e-9:
                want[k, i] = best
    found = decontam.find(
        spark.createDataFrame([(k, " ".join(w), "x") for k, w in docs.items()], "doc_id long, text string, print string"), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], "item_id long, text string")
    ).collect()
    got = {(r["doc_id"], r["item_id"]): r for r in found}
    assert len(found) == len(got) and set(want) <= set(got) and {len(items[i]) for _, i in want} == {15, 22, 31, 58, 103} and len(want) > 50
    for (k, i), r in got.items():
        of = {s: x for x, s in all_windows(docs[k], items[i], weight, short=True)}
        assert math.isclose(r["similarity"], of[r["start_word"]], abs_tol=1e-9) and r["similarity"] >= max(0.8, want.get((k, i), (0,))[0]) - 1e-9
        assert r["n_words"] == len(items[i]) and 0 <= r["distance"] <= 24
