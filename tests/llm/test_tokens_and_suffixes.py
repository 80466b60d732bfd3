import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from tokenizers import Tokenizer

from tessera.llm import suffix_dedup, tokenbin

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "  a  b", "a\n b", " x\n", "foo   bar", "don't it's 'll x's", "a<|endoftext|> b", "tab\tq r", "é́ à 12 3,4 .. !?", "\n\n a\n\nb c", "\nab\n", "a\nb\n", "a\xa0b c d", "x\x1cy z", "\0 a\0", "😀 é", "w" * 3000, "word " * 5000,
]


def test_blocks_round_trip():
    rng = np.random.default_rng(2)
    cases = [np.array([5], np.uint32), np.full(1024, 7, np.uint32), rng.integers(0, 50257, 1024).astype(np.uint32), np.where(rng.random(1000) < 0.01, 2**32 - 1, rng.integers(100, 120, 1000)).astype(np.uint32), rng.integers(0, 2**32, 77, dtype=np.uint64).astype(np.uint32)]
    for ids in cases:
        data = tokenbin.pack_block(ids.copy())
        assert (tokenbin.unpack_block(memoryview(data), len(ids)) == ids).all()
    assert len(tokenbin.pack_block(cases[3].copy())) < 1000
    ids = np.concatenate(cases)
    segment = tokenbin.pack_segment([1, None, 3], [10, 0, len(ids) - 10], ids)
    assert (tokenbin.segment_ids(segment) == ids).all() and (tokenbin.segment_ids(segment, 1020, 2100) == ids[1020:2100]).all()
    assert [(int(d["k"]), int(d["null"]), int(d["n"])) for d in tokenbin.segment_docs(segment)] == [(1, 0, 10), (0, 1, 0), (3, 0, len(ids) - 10)]
    assert tokenbin.pack_segment([4], [0], ids[:0]) and len(tokenbin.segment_ids(tokenbin.pack_segment([4], [0], ids[:0]))) == 0


def test_encoder_is_the_library():
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["".join(rng.choice(["a", " ", "\n", "é", "1", "'s", ",", "\t", "the ", "<|"]) for _ in range(40)) for _ in range(500)]
    want = [np.array(e.ids, "<u4").tobytes() for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    encoder = tokenbin.Encoder(PATH)
    encoder.many = 50
    assert [x for i in range(0, len(texts), 100) for x in encoder(pa.array(texts[i : i + 100]))] == want


def test_token_files(spark):
    rows = [(3 * i, t, "x") for i, t in enumerate(TEXTS)] + [(6, TEXTS[2], "x"), (None, "null key", "x")]
    written = tokenbin.write(spark.createDataFrame(rows, "doc_id long, text string, part string"), PATH, segment=1000)
    assert written.count() >= 2
    got = sorted(tokenbin.read(written).collect(), key=lambda r: r["start"])
    keys = [r["doc_id"] for r in got]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0)) and len(got) == len(rows)
    library, at = Tokenizer.from_file(PATH), 0
    text = {k: t or "" for k, t, _ in rows}
    for r in got:
        ids = np.array([*library.encode(text[r["doc_id"]], add_special_tokens=False).ids, 2], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert tokenbin.read(tokenbin.write(spark.createDataFrame([], "doc_id long, text string"), PATH)).collect() == []


def test_segment_files(spark, tmp_path):
    rows = [(i, f"{t or ''} {i}") for i, t in enumerate(TEXTS * 3)]
    written = tokenbin.write(spark.createDataFrame(rows, "doc_id long, text string"), PATH, segment=300)
    index = sorted(tokenbin.export(written, str(tmp_path / "files")).collect())
    names = sorted(p.name for p in (tmp_path / "files").iterdir() if p.suffix == ".pfr")
    assert [r["name"] for r in index] == names and len(names) >= 3
    at = 0
    for r in index:
        data = (tmp_path / "files" / r["name"]).read_bytes()
        assert (r["first"], r["n_ids"], r["n_docs"], r["bytes"], r["crc32"]) == (at, len(tokenbin.segment_ids(data)), len(tokenbin.segment_docs(data)), len(data), zlib.crc32(data))
        at += r["n_ids"]
    tokenbin.export(written, str(tmp_path / "files"))
    loaded = tokenbin.load(spark, str(tmp_path / "files"))
    assert sorted(tokenbin.read(loaded).collect()) == sorted(tokenbin.read(written).collect())
    assert loaded.agg({"n_ids": "sum"}).collect()[0][0] == at


def brute(rows, length=50):
    order = lambda k: -1 if k is None else k
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            first[s] = min(first.get(s, 1 << 62), order(k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < order(k):
                gone[i : i + length] = b"\1" * length
        out.append((k, len(b), sum(gone), len(re.findall(rb"\x01+", bytes(gone))), hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()))
    return sorted(out, key=str)


def test_suffix_removal(spark, monkeypatch):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    passages = [" ".join(word() for _ in range(n)) for n in (8, 12, 15, 30, 80)]
    texts = [None, "", "short", "a" * 49, "a" * 50, "a" * 51, "a" * 500, "ab" * 300, "é" * 25, "é" * 60, passages[3], passages[3][:50], passages[3][3:60], passages[4] + "x"]
    texts += [" ".join(rng.choice([word(), word(), word(), rng.choice(passages)]) for _ in range(rng.randint(1, 60))) for _ in range(120)]
    texts += texts[20:25] + ["\0" * 120, "\0" * 60 + "b"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, texts[k]) for i, k in enumerate(order)] + [(None, passages[2] + passages[3]), (9, texts[order[9]])]
    docs = spark.createDataFrame([(k, t, "x", 1) for k, t in rows], "doc_id long, text string, id string, sha long")
    want = brute(rows)
    assert sorted((tuple(r) for r in suffix_dedup.dedup(docs).collect()), key=str) == want
    assert suffix_dedup.dedup(docs.where("false")).collect() == []


def test_long_texts_come_in_pieces(monkeypatch):
    monkeypatch.setattr(suffix_dedup, "PIECE", 500)
    rng = random.Random(2)
    texts = ["".join(rng.choice("abc ") for _ in range(n)).encode() for n in (30, 700, 3000)]
    seen = {}
    for data, at, first, last, own, place, _ in suffix_dedup.anchors(texts):
        for a, f, n, o, p in zip(at, first, last, own, place, strict=True):
            for k in range(n - f + 1):
                seen.setdefault((int(o), int(p) + k), []).append(int(p + a - f))
    assert sorted(seen) == [(i, k) for i, t in enumerate(texts) for k in range(len(t) - 49)] and all(len(v) == 1 and k <= v[0] <= k + 34 for (_, k), v in seen.items())


def test_contexts_in_parts(monkeypatch):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcd ") for _ in range(300)) for _ in range(6)]
    texts = [t[: rng.randint(100, 300)] + rng.choice("xyz") + t[rng.randint(0, 100) :] for t in base * 5]
    at = pa.array([sorted({int(p + a - f) for _, aa, ff, _, _, pp, _ in suffix_dedup.anchors([t.encode()]) for a, f, p in zip(aa, ff, pp, strict=True)}) for t in texts], pa.list_(pa.int32()))
    rows = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(range(30)), pa.array(texts), at], names=["id", "t64", "text", "at"])
    contexts = pa.Table.from_batches(suffix_dedup._contexts(iter([rows])))
    numbers = {}
    k = pa.array([numbers.setdefault((r, o), len(numbers)) for r, o in zip(contexts["raw"].to_pylist(), contexts["off"].to_pylist(), strict=True)], pa.int64())
    batches = contexts.select(["lead"]).append_column("k", k).append_column("raw", contexts["raw"]).append_column("off", contexts["off"]).append_column("id", contexts["id"]).to_batches(max_chunksize=11)

    def resolve():
        folded = list(suffix_dedup._fold(iter(batches)))
        return len(folded), sorted(str(tuple(r.values())) for b in suffix_dedup._resolve(iter(folded)) for r in b.to_pylist())

    whole = resolve()
    monkeypatch.setattr(suffix_dedup, "KINDS", 1)
    monkeypatch.setattr(suffix_dedup, "KINDS_FOLDED", 20)
    parts = resolve()
    assert whole[1] and parts[1] == whole[1] and whole[0] == 1 < parts[0]


def test_multikey_runs():
    data = np.frombuffer(b"abcabcabc" * 20 + b"x" + b"abcabcabc" * 20 + bytes(8), np.uint8)
    words = np.zeros(len(data) - 7, np.uint64)
    for k in range(8):
        words = (words << np.uint64(8)) | data[k : len(data) - 7 + k]
    places = np.array([p for p in range(312) if p + 50 <= 180 or p > 180])
    run = suffix_dedup.multikey_runs(words, places)
    raw = data.tobytes()
    by = {}
    for r, p in zip(run.tolist(), places.tolist(), strict=True):
        assert by.setdefault(raw[p : p + 50], r) == r
    assert len(set(by.values())) == len(by)


def test_common_grams_are_flagged_before_they_are_dealt(monkeypatch):
    rng = random.Random(11)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(400))
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randint(60, 300))) + (passage[rng.randint(0, 200) :] if i % 3 else "") for i in range(90)]
    batches = [pa.RecordBatch.from_arrays([pa.array(range(i, i + 30), pa.int64()), pa.array(texts[i : i + 30])], names=["t64", "text"]) for i in (0, 30, 60)]

    def places(common):
        monkeypatch.setattr(suffix_dedup, "COMMON", common)
        dealt = [b for part in batches for b in suffix_dedup._deal(4)(iter([part]))]
        rows = [(k, v) for b in dealt for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        sizes = [int(np.frombuffer(v, np.uint32, 2)[1]) for k, v in rows if k >= 0]
        flags = []
        for own in range(4):  # a task has the rows of its key, whatever it is
            taken = [pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "payload": pa.array([v], pa.binary())}) for k, v in rows if k % 4 == own]
            flags += [(k, v) for b in suffix_dedup._flag(4)(iter(taken)) for k, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        out = {}
        for own in range(4):
            taken = [pa.RecordBatch.from_pydict({"bucket": pa.array([k], pa.int32()), "payload": pa.array([v], pa.binary())}) for k, v in flags if k == own]
            out |= {r["t64"]: r["at"] for b in suffix_dedup._gather(iter(taken)) for r in b.to_pylist()}
        return sum(sizes), out

    few, own = places(8)
    many, plain = places(10**9)
    assert own == plain and len(own) >= 60 and few < 0.7 * many
