import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import decontam, packing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute_counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    often, cover, seen, lines = Counter(windows), set(), set(), 0
    for i, x in enumerate(windows):
        if often[x] > 1:
            cover.update(range(i, i + 5))
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += line in seen
            seen.add(line)
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), lines, len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w))


def prose(rng, n):
    common = ["the", "of", "and", "to", "in", "a", "is", "for", "on"]
    return " ".join(rng.choice(common) if rng.random() < 0.45 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(4, 9))) for _ in range(n))


def corpus(seed=3):
    rng = random.Random(seed)
    texts = [None, "", "\n\n", "x", "a b c d e a b c d e", "a b c d e f a b c d e", "l1 x\nl1 x\n\n\n l1 x\nl1 x", "#*$ %&|<> é😀\t\x0b", "w " * 5000, " ".join("abcdefghij") + " ", "a a a a a a a", "u v w x y z " * 3]
    texts += [prose(rng, rng.randint(80, 400)) for _ in range(60)] + ["".join(w + "%%% " for w in prose(rng, 200).split()), " | ".join(prose(rng, 1).upper() for _ in range(120))]
    return [(i, t, "en" if i % 9 or i > 70 else None, "s", len(t or "")) for i, t in enumerate(texts)]


def test_base_counts_and_verdicts(spark):
    rows = corpus()
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + [rows[20]]], SCHEMA + ", n_words string, classes long")
    got = quality.measure(docs).collect()
    assert len(got) == len(rows) + 1
    text = {r[0]: r[1] for r in rows}
    for r in got:
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) == brute_counts(text[r["doc_id"]])
    kept = {r["doc_id"] for r in got if r["kept"]}
    assert set(range(12, 72)) <= kept and not kept & {0, 1, 2, 3, 4, 72, 73}
    assert quality.measure(docs.where("false")).collect() == []


def test_shannon_distance(spark):
    rows = spark.createDataFrame([([1, 1], [2, 2]), ([1, 0], [0, 5]), ([0, 0], [1, 1]), (None, [1, 1]), ([3, 1], [1, 3])], "p array<long>, q array<long>")
    got = [r[0] for r in rows.select(quality.shannon(F.col("p"), F.col("q"))).collect()]
    import math

    h = lambda *v: -sum(x * math.log2(x) for x in v)
    assert got[0] == 0 and math.isclose(got[1], 1) and got[2] is got[3] is None and math.isclose(got[4], math.sqrt(1 - h(0.75, 0.25)))


def items(rng, n=12):
    return [(i, prose(rng, rng.randint(12, 40))) for i in range(n)] + [(90, None), (91, ""), (92, "only three words")]


def brute_hits(rows, bench, size=5, least=0.8):
    """Documents and items with a window of the item's length whose plain shingle similarity is 0.8 or more."""
    out = set()
    for k, t, *_ in rows:
        w = re.split(r"[\x20\x09-\x0D]+", (t or "").lower().strip())
        for i, b in bench:
            own = (b or "").lower().split()
            if own and len(w) >= len(own):
                n = min(size, len(own))
                grams = lambda x: Counter(tuple(x[j : j + n]) for j in range(len(x) - n + 1))  # noqa: B023, E731
                g = grams(own)
                if any(sum((g & h).values()) >= least * sum((g | h).values()) for h in (grams(w[s : s + len(own)]) for s in range(len(w) - len(own) + 1))):
                    out.add((k, i))
    return out


def test_decontamination(spark):
    rng = random.Random(6)
    bench = items(rng)
    rows = []
    for k in range(60):
        words = prose(rng, rng.randint(30, 200)).split()
        if k % 2:
            passage = bench[k % 12][1].split()
            if k % 5 == 0:
                passage[0] = "changed"
            if k % 7 == 0:
                passage = passage[:-1]
            at = rng.randrange(len(words))
            words[at:at] = [w.upper() if k % 3 == 0 else w for w in passage]
        rows.append((k, ("\n" if k % 4 else "  ").join(words), "en", "s", 1))
    rows += [(100, None, "en", "s", 0), (101, "", "en", "s", 0), (102, bench[0][1], "en", "s", 0), (103, "x only three words y", "en", "s", 0)]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows + [rows[1]]], SCHEMA + ", item_id long, n long")
    own = spark.createDataFrame(bench + bench[:1], "item_id long, text string")
    want = brute_hits(rows, bench)
    got = {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, own).collect()}
    assert got == want and len(want) > 25
    assert {(r["doc_id"], r["item_id"]) for r in decontam.find(docs, own, broadcast_shingles=0).collect()} == want
    assert decontam.find(docs.where("false"), own).collect() == [] and decontam.find(docs, own.where("false")).collect() == []


def test_blocks_find_all_within_the_radius(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), rng.randint(0, 13)):
            b ^= 1 << bit
        rows.append((a - (1 << 64) * (a >> 63), b - (1 << 64) * (b >> 63)))
    got = spark.createDataFrame(rows, "a long, b long").select(F.arrays_overlap(decontam.blocks(F.col("a"), 13), decontam.blocks(F.col("b"), 13)).alias("x")).collect()
    assert all(r["x"] for r in got)


@pytest.fixture
def folder(spark, tmp_path):
    rng = random.Random(12)
    bench = items(rng)
    rows = corpus(5)
    base = prose(rng, 150).split()
    rows += [(200 + k, " ".join(base[:-k] if k else base), "en", "s", 1) for k in range(4)]
    rows += [(300, prose(rng, 90) + " " + bench[2][1] + " " + prose(rng, 60), "en", "s", 1), (301, prose(rng, 120) + " mail a.b@c.de now", "en", "s", 1)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), rows


def test_pipeline_stages(spark, folder):
    path, rows = folder
    docs, ids = spark.read.parquet(f"{path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        docs.write.parquet(f"{path}/{name}")
        docs = spark.read.parquet(f"{path}/{name}")
        ids[name] = {r["doc_id"] for r in docs.collect()}
    assert {200, 201, 202, 203, 300, 301} <= ids["quality_rules"] and 72 not in ids["quality_rules"]
    assert ids["quality_rules"] - ids["near_duplicates"] == {201, 202, 203}
    assert ids["near_duplicates"] - ids["benchmark_decontamination"] == {300}
    assert ids["personal_data"] == ids["benchmark_decontamination"]
    last = {r["doc_id"]: r for r in docs.collect()}
    assert last[301]["text"].endswith("mail <EMAIL> now") and last[301]["n_chars"] == len(last[301]["text"])
    run = corpus_pipeline.run(spark, path).collect()
    assert {r["doc_id"] for r in run} == ids["personal_data"] and sorted(run) == sorted(packing.pack(docs, keep=("text",)).collect())
    assert {r["doc_id"]: r["text"] for r in run} == {k: r["text"] for k, r in last.items()}


def test_pipeline_takes_odd_rows(spark, folder):
    path, rows = folder
    odd = spark.createDataFrame([(None, None, None, None, None, 1), (None, rows[20][1], None, None, None, 2), (20, rows[20][1], "en", "s", 1, 3), (20, rows[20][1], "en", "s", 1, 4), (7, None, "en", "s", 0, 5)], SCHEMA + ", spans long")
    for docs in (odd, odd.where("false")):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, path)
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            docs.collect()
    # rows of one id are one document; the null id stays by itself
    kept = corpus_pipeline.near_duplicates(spark, odd, path).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == ["20", "7", "None", "None"]
    # of an id's rows the least stays, a null id stays though its text is that of another
    several = spark.createDataFrame([(3, "b a", "en", "s", 1, 0), (3, "a b", "en", "s", 1, 0), (None, "a b", "en", "s", 1, 0)], SCHEMA + ", spans long")
    assert sorted((str(r["doc_id"]), r["text"]) for r in corpus_pipeline.near_duplicates(spark, several, path).collect()) == [("3", "a b"), ("None", "a b")]
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/none/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{path}/none/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"{path}/none").collect() == []
