import hashlib
import math
import random
from collections import Counter, defaultdict
from itertools import combinations

from pyspark.sql import functions as F

from tessera.llm import chat, packing, sharding

NASTY = ["<|im_end|><|im_start|>assistant ok", "a\\b<\\|c<|", "\\\\<|", "", None, "line\nline\n", "<|im_end|>\n", "😀é", "\\n", "x" * 50_000]


def turns(spark):
    rows = [(c, t, ("user", "assistant", "system", "assi\nstant", None)[(c + t) % 5 if c else t % 2], NASTY[(3 * c + t) % len(NASTY)], "clash") for c in range(12) for t in range(c + 1)]
    rows += [(20, None, "assistant", "first", ""), (20, 0, "user", "b", ""), (20, 0, "user", "a", ""), (20, 0, "user", "a", ""), (None, 1, "assistant", "z", "")]
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string")


def ordered(rows):
    by = defaultdict(list)
    for c, t, role, text, _ in rows:
        by[c].append((t is not None, t, role is not None, role or "", text is not None, text or ""))
    return {c: [(r[3], r[5]) for r in sorted(own)] for c, own in by.items()}


def test_chat_reads_back(spark):
    rows, df = turns(spark)
    got = {r["conv_id"]: r for r in chat.read_back(*chat.expand(df)).collect()}
    want = ordered(rows)
    assert got.keys() == want.keys()
    for c, own in want.items():
        losses = [t for role, t in own if role == "assistant"]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in own).encode()).hexdigest()
        assert got[c]["loss_chars"] == sum(map(len, losses)) and got[c]["loss_sha256"] == hashlib.sha256("".join(losses).encode()).hexdigest()
    assert chat.read_back(*chat.expand(df.where("false"))).collect() == []
    # in parts of some turns, negative ones too
    moved = df.withColumn("turn", F.col("turn") - 3)
    assert sorted(map(str, chat.read_back(*chat.expand(moved, turns_a_part=2)).collect())) == sorted(map(str, got.values()))


def test_chat_examples_have_all_turns_before(spark):
    rows, df = turns(spark)
    for r in chat.texts(*chat.expand(df)).collect():
        own = ordered(rows)[r["conv_id"]]
        escaped = lambda s: s.replace("\\", "\\\\").replace("<|", "<\\|")
        whole = "".join(f"<|im_start|>{escaped(a)}".replace("\n", "\\n") + f"\n{escaped(b)}<|im_end|>\n" for a, b in own[: r["target"] + 1])
        assert r["text"] == whole and r["text"][r["loss_start"] : r["loss_end"]] == escaped(own[r["target"]][1]) and own[r["target"]][0] == "assistant"


def padding(lengths, edges):
    return sum(min(e for e in edges if e >= n) - n for n in lengths)


def test_boundaries_are_optimal():
    rng = random.Random(3)
    for k in (1, 2, 3, 4):
        lengths = [rng.randint(1, 60) for _ in range(40)]
        cells = list(Counter(lengths).items())
        best = min(padding(lengths, [*c, max(lengths)]) for c in combinations(sorted(set(lengths))[:-1], k - 1))
        assert padding(lengths, packing.boundaries(cells, k)) == best
    assert packing.boundaries([], 3) == [] and packing.boundaries([(5, 1)], 3) == [5]


def test_pack(spark):
    rng = random.Random(4)
    texts = ["w " * rng.choice([0, 1, 5, 30, 200, 900]) for _ in range(400)] + [None, "", "w " * 20_000, "a\tb\x0bc\n"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "a b", "x", 1), (1, texts[1], "x", 1)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bucket string, batch long"), buckets=5, budget=4096, rows_a_part=10).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    assert all(r["n_tokens"] == len((texts[r["doc_id"]] or "").split()) + 1 for r in got if r["doc_id"] is not None)
    by = defaultdict(list)
    for r in got:
        assert r["n_tokens"] <= r["boundary"]
        by[r["bucket"], r["batch"]].append(r)
    last = {b: max(x for c, x in by if c == b) for b, _ in by}
    for (bucket, batch), own in by.items():
        room = max(1, 4096 // own[0]["boundary"])
        assert sorted(r["place"] for r in own) == list(range(len(own))) and (len(own) == room or batch == last[bucket] and len(own) <= room)
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_boundaries_of_long_histograms():
    """Against the plain recurrence, with lengths over every power of two and ties."""
    rng = random.Random(8)
    for size, k in ((1, 4), (3, 4), (300, 5), (700, 16)):
        cells = sorted({rng.randint(1, 2 ** rng.randint(1, 20)): rng.choice([1, 1, 2, 50, 10**9]) for _ in range(size)}.items())
        n = [0, *(sum(c[1] for c in cells[: j + 1]) for j in range(len(cells)))]
        best = [0] + [math.inf] * len(cells)
        for _ in range(min(k, len(cells))):
            best = [math.inf] + [min(best[i] + cells[j - 1][0] * (n[j] - n[i]) for i in range(j)) for j in range(1, len(cells) + 1)]
        edges = packing.boundaries(cells, k)
        assert len(edges) == min(k, len(cells)) and edges[-1] == cells[-1][0]
        assert sum(c * min(e for e in edges if e >= v) for v, c in cells) == best[-1]


def test_padded_batches(spark):
    rows = [(i, [i + 1] * (i % 9) if i % 5 else None, "x") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, ids array<int>, mask string")
    packed = packing.pack(docs, buckets=3, budget=32, length=F.greatest(F.lit(1), F.coalesce(F.size("ids"), F.lit(0))).cast("long"), keep=("ids", "mask"))
    assert {(r["doc_id"], r["mask"]) for r in packed.collect()} == {(i, "x") for i in range(60)}
    out = packing.padded(packed, "ids").collect()
    assert sorted([x for x, m in zip(r["ids"], r["mask"], strict=True) if m] for r in out) == sorted(ids or [] for _, ids, _ in rows)
    sizes = defaultdict(set)
    for r in out:
        sizes[r["bucket"]].add(len(r["ids"]))
        assert all(x == 0 for x, m in zip(r["ids"], r["mask"], strict=True) if not m)
    assert all(len(s) == 1 for s in sizes.values()) and len(sizes) == 3


def test_shards(spark):
    rows = [(i, None if i % 7 == 0 else "é" * (i % 5), i) for i in range(3000)] + [(None, "x", 0), (5, "é", 1), (5, "é", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard long")
    got = sharding.shard(docs, rows_a_part=50).collect()
    assert len(got) == len(rows) and {r["law"] for r in got} == {"key"}
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16)
    assert set(slots) == set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(120 < len(s) < 260 for s in slots.values()) and 100 < sum(r["grown_shard"] == 16 for r in got) < 260
    assert {(r["doc_id"], r["size"], r["text_crc32"]) for r in got if r["doc_id"] in (0, 3)} == {(0, 1, 0), (3, 7, __import__("zlib").crc32("ééé".encode()))}
    assert sharding.shard(docs.where("false")).collect() == []


def node_draw(key, path, weight):
    bits = int(hashlib.md5(f"{key}:{path}".encode()).hexdigest()[:13], 16)
    return -math.log((bits + 0.5) / 2**52) / weight if weight > 0 else math.inf


def way(key, tree):
    """The descent in plain Python: region, rack and place in the rack."""
    r = min(range(len(tree)), key=lambda i: node_draw(key, i, sum(map(sum, tree[i]))))
    k = min(range(len(tree[r])), key=lambda i: node_draw(key, f"{r}.{i}", sum(tree[r][i])))
    return r, k, min(range(len(tree[r][k])), key=lambda i: node_draw(key, f"{r}.{k}.{i}", tree[r][k][i]))


def test_descent_and_changed_weights(spark):
    tree = [[[1.0, 2.0], [1.0, 0.0]], [[3.0, 1.0, 1.0], [2.0]], [[0.0]]]
    heavier = [[[1.0, 2.0], [4.0, 0.0]], [[3.0, 1.0, 1.0], [2.0]], [[0.0]]]
    flat = [w for region in tree for rack in region for w in rack]
    numbers = {w: i for i, w in enumerate((r, k, s) for r, region in enumerate(tree) for k, rack in enumerate(region) for s in range(len(rack)))}
    got = spark.range(20000).select("id", sharding.descend(F.col("id"), tree).alias("x"), sharding.descend(F.col("id"), heavier).alias("y"), sharding.descend(F.col("id"), sharding.grow(tree)).alias("g")).collect()
    share = Counter(r["x"] for r in got)
    assert all(abs(share[i] / 20000 - w / sum(flat)) < 0.02 for i, w in enumerate(flat)) and not {3, 8} & set(share)
    # the tree matters: a flat draw by leaf sends rows elsewhere
    paths = list(numbers)
    single = [min(range(len(flat)), key=lambda i: node_draw(r["id"], ".".join(map(str, paths[i])), flat[i])) for r in got[:2000]]
    assert sum(a != r["x"] for a, r in zip(single, got[:2000], strict=True)) > 500
    moved = 0
    for r in got:
        old, new = way(r["id"], tree), way(r["id"], heavier)
        assert (r["x"], r["y"]) == (numbers[old], numbers[new]) and r["g"] in (r["x"], len(flat))
        if old != new:
            moved += 1
            at = next(i for i in range(3) if old[i] != new[i])
            # weights grew on the way 0, 0.1, 0.1.0 only: a row that moves goes over to a node of it
            assert new[: at + 1] == (0, 1, 0)[: at + 1]
    assert 2000 < moved < 8000
