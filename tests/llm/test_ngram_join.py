import random
import re
from collections import Counter, defaultdict

import pytest

from tessera.llm import ngram_join
from tessera.llm.components import components

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=3, percent=90):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i] = frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else [])
    at = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            at[g].append(i)
    both = Counter((a, b) for own in at.values() for k, a in enumerate(sorted(own)) for b in sorted(own)[k + 1 :])
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for (a, b), n in both.items():
        if 100 * n >= percent * (len(sets[a]) + len(sets[b]) - n):
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def corpus(seed=1):
    """Groups of near copies with few or many changes, shared passages, exact copies, short and empty texts."""
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghij") + rng.choice("klmnop") + rng.choice("qrstuv") * rng.randint(1, 3)
    passage = [word() for _ in range(30)]
    texts = [None, "", " \t\n", "one", "One", "one two", "ONE  TWO\n", "one two three", "one two three four", "É one", "é one", "\x0b a\x0cb"]
    for _ in range(6):
        base = [word() for _ in range(rng.randint(40, 120))]
        for _ in range(rng.randint(2, 25)):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                k = rng.randrange(len(own))
                own[k : k + 1] = rng.choice([[], [word()], [own[k], word()]])
            texts.append(" ".join(own))
    texts += [" ".join([word() for _ in range(rng.randint(0, 60))] + passage + [word() for _ in range(rng.randint(0, 60))]) for _ in range(40)]
    texts += texts[-3:] + [texts[15].upper(), texts[15].replace(" ", "  ")]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize(("light", "seed", "size", "percent"), [(64, 1, 3, 90), (4, 1, 3, 90), (1, 2, 3, 90), (4, 3, 5, 80), (1, 4, 5, 80)])
def test_components(spark, light, seed, size, percent):
    rows = corpus(seed)
    docs = spark.createDataFrame([(i, t, "x", i) for i, t in rows], "doc_id long, text string, n string, token long")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.join(docs, light=light, size=size, percent=percent).collect()}
    assert got == brute(rows, size, percent)


def test_repeated_null_and_no_rows(spark):
    docs = spark.createDataFrame([(3, "a b c d"), (3, "a b c d"), (5, "a b c d"), (None, "a b c d"), (None, None)], "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.join(docs).collect()), key=str)
    assert got[:3] == [(3, 3), (3, 3), (5, 3)] and all(i is None for i, _ in got[3:])
    assert ngram_join.join(docs.where("false")).collect() == []


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7), (501, 500)], "a long, b long")
    roots = defaultdict(set)
    for r in components(edges).collect():
        roots[r["root"]].add(r["node"])
    assert sorted(map(len, roots.values())) == [2, 201]
