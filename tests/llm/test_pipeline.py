"""The pipeline's stages against brute force over a small fixture with cases on both sides of each threshold."""

import math
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline

from .test_quality_decontam_pipeline import SCHEMA, brute_counts, brute_hits
from .test_spans import base_pii

COMMON = ["the", "of", "between", "and", "to", "in", "through"]


def fresh(rng, n):
    return ["".join(rng.choice("bcdefghijklmnopqrstuvwxyz") for _ in range(8)) for _ in range(n)]


def prose(rng, n):
    return [rng.choice(COMMON) if rng.random() < 0.45 else w for w in fresh(rng, n)]


def distance(p, q):
    if not (p and q and sum(p) and sum(q)):
        return 0.0
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a, b: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, b, strict=True) if x)
    return math.sqrt(max(0.0, (half(p, q) + half(q, p)) / 2))


def classes(t):
    sets = ["[A-Z]", "[0-9]", "[.,;:!?'\"()-]", r"[#*$%&|<>@=_/\\^~`+{}\[\]]", r"[\x00-\x08\x0E-\x1F\x7F]", r"[^\x00-\x7F]", r"[\x20\x09-\x0D]", "[a-z]"]
    return [len(re.findall(c, t)) for c in sets]


def brute_quality(rows):
    by, out = defaultdict(list), {}
    for k, t, lang, *_ in rows:
        by[lang].append((k, t or ""))
    for docs in by.values():
        heard = Counter(w for _, t in docs for w in t.lower().split())
        top = sorted(heard, key=lambda w: (-heard[w], w.encode()))[:24]
        words = {k: [t.lower().split().count(w) for w in top] for k, t in docs}
        words = {k: [*words[k], len(t.split()) - sum(words[k])] for k, t in docs}
        sums = [list(map(sum, zip(*h, strict=True))) for h in ([classes(t) for _, t in docs], list(words.values()))]
        for k, t in docs:
            far = distance(classes(t), sums[0]) if len(t) >= 200 else 0, distance(words[k], sums[1]) if len(t.split()) >= 50 else 0
            out[k] = (not brute_counts(t)[-1] and far[0] <= 0.3 and far[1] <= 0.45, *far)
    return out


def brute_groups(rows):
    """Of each linked group the least id."""
    sets = {}
    for k, t, *_ in rows:
        w = t.lower().split()
        sets[k] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}
    least = {k: k for k in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                    least[a] = min(least[a], least[b])
    return {k for k in sets if least[k] == k}


def fixture():
    rng, rows = random.Random(21), []
    add = lambda words, lang="en": rows.append((len(rows), " ".join(words), lang, "s", 1))
    for lang, n in (("en", 30), (None, 24), ("few", 9)):
        for _ in range(n):
            add(prose(rng, 120), lang)
        for part in (6, 18, 36, 60, 90, 120):  # from a little junk to nothing else
            add(["#%&$|<>~"] * 0 + ["".join(rng.choice("0123456789#%") for _ in range(8)) for _ in range(part)] + prose(rng, 120 - part), lang)
    add(fresh(rng, 9))
    add(fresh(rng, 10))
    for extra in (39, 40, 41):  # a window of 5 words twice: 10 of n words around 20 %
        five = fresh(rng, 5)
        add(five + fresh(rng, extra) + five)
    first = prose(rng, 104)
    add(first)
    for lost in (11, 12):  # of 100 shingles
        add(fresh(rng, lost) + first[lost:])
    bench = [(i, " ".join(fresh(rng, n))) for i, n in enumerate((23, 32, 59, 23, 32, 59))]
    for i, t in bench:
        w = t.split()
        lost = (len(w) - 4) // 9 + (i > 2)  # one more than similarity 0.8 allows, for the latter three
        add(prose(rng, 50) + fresh(rng, lost) + w[lost:] + prose(rng, 50))
    add([*prose(rng, 60), "a.b@c.de", *prose(rng, 60), "10.0.0.1"])
    rows.append((len(rows), None, "en", "s", 0))
    return rows, bench


def test_run_equals_brute_force(spark, tmp_path):
    path, (rows, bench) = str(tmp_path), fixture()
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    judged = brute_quality(rows)
    good = [r for r in rows if judged[r[0]][0]]
    firsts = brute_groups(good)
    single = [r for r in good if r[0] in firsts]
    hit = {k for k, _ in brute_hits(single, bench)}
    clean = [r for r in single if r[0] not in hit]
    # each threshold has cases on both sides
    failed = {r[0] for r in rows if brute_counts(r[1])[-1]}
    assert {lang for k, _, lang, *_ in rows if k not in failed and not judged[k][0]} == {"en", None, "few"} and len(failed) == 3
    assert len(good) - len(single) == 1 and len(hit) == 3

    docs = spark.read.parquet(f"{path}/documents.parquet")
    wants = [{r[0] for r in x} for x in (good, single, clean, clean)]
    for (name, stage), want in zip(corpus_pipeline.STAGES[:-1], wants, strict=True):
        docs = corpus_pipeline.cut(stage(spark, docs, path), name)
        assert {r["doc_id"] for r in docs.collect()} == want, name
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    for k, t, *_ in clean:
        for kind, a, b in sorted(base_pii(t), key=lambda s: -s[1]):
            t = f"{t[:a]}<{kind.upper()}>{t[b:]}"
        assert texts[k] == t
    assert sum("<EMAIL>" in t and "<IP>" in t for t in texts.values()) == 1
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, path).collect()} == wants[-1]
