"""Queries against their SQL over a table of odd rows: null and rare languages, null and repeated ids, repeated rows, odd texts."""

import random

import duckdb
import pytest

from tessera.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string"
LISTS = {"en": "the and of to in it is was that for on with as at by".split(), "de": "und der die das nicht ein eine mit auf von zu".split(), None: "lorem ipsum dolor sit amet consectetur adipiscing elit sed do".split(), "small": "zzz yyy xxx www vvv uuu".split()}


def rows():
    rng = random.Random(12)
    text = lambda lang, n: " ".join(rng.choice(LISTS[lang]) + rng.choice(["", "", ",", "."]) for _ in range(n))
    out = [(i, text(lang, rng.choice([3, 12, 60, 150])), lang) for i, lang in enumerate(["en"] * 60 + ["de"] * 40 + [None] * 50 + ["small"] * 7)]
    # rejected by their language's reference
    out += [(1000, "#%& " * 100, None), (1001, text("de", 120), "small"), (1002, text(None, 200), "en"), (1003, "ÄÖÜ " * 90 + "0123 " * 50, "small")]
    out += [(1100, None, "en"), (1101, "", None), (1102, " \n\t\x0b", "de"), (1103, "x" * 70_000, "en"), (1104, "a b\n" * 3000, "only"), (1105, text("en", 9), None)]
    # repeated rows, texts and ids
    out += [out[5], out[5], (7, out[6][1], "en"), (2000, out[70][1], "de"), (2001, out[70][1], None), (2001, out[71][1], "de"), (2002, out[71][1], "de"), (None, out[3][1], "en"), (None, None, None)]
    # each row is a document: u and v have no link, though one id has both
    u, v = text("en", 40), text("de", 40)
    out += [(3000, u, "en"), (3001, u, "en"), (3001, v, "en"), (3002, v, "en"), (3003, v + " und", "en")]
    # benchmark passages: whole, with other words before and a word less, under a null id, in two rows of one id
    for i, t in enumerate(PASSAGES):
        out += [(4000 + i, text("en", 30) + " " + t.upper() + " " + text("de", 20), "en"), (4100, t, None), (None, "x " + " ".join(t.split()[1:]), "en"), (4200 + i, " ".join(t.split()[: len(t.split()) // 2]), "en")]
    return [(i, t, lang, "s", len(t or ""), "clash") for i, t, lang in out]


PASSAGES = [" ".join("abcdefghijklmnopqrstuvwxyz"[(i * k + k) % 26] * (1 + (i + k) % 4) for i in range(n)) for k, n in ((3, 20), (5, 31), (7, 58))] + ["only three words", "alone"]
ITEMS = [(1, PASSAGES[0]), (1, PASSAGES[1]), (1, PASSAGES[1]), (None, PASSAGES[2]), (None, PASSAGES[0]), (2, None), (3, " "), (4, PASSAGES[3]), (5, PASSAGES[4])]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("odd")
    for name, own in (("documents", rows()), ("none", [])):
        spark.createDataFrame(own, SCHEMA).coalesce(1).write.parquet(f"{at}/{name}/documents.parquet")
        spark.createDataFrame([(*x, "clash") for x in ITEMS] if own else [], "item_id long, text string, doc_id string").coalesce(1).write.parquet(f"{at}/{name}/benchmark.parquet")
    return at


@pytest.mark.parametrize("name", ["op2_adaptive_prefixes", "op4_language_divergence", "op5_simhash_windows", "op6_length_packing", "op8_suffix_ranges", "op9_hash_tree_shards", "op10_blob_ledger"])
def test_odd_rows(spark, folder, name):
    got = QUERIES[name](spark, f"{folder}/documents")
    data = duckdb.connect()
    for t in ("documents", "benchmark"):
        data.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/documents/{t}.parquet/*.parquet')")
    want = data.execute(f"SELECT {', '.join(got.columns)} FROM ({SQL[name]})").fetchall()
    a, b = sorted(map(str, map(tuple, got.collect()))), sorted(map(str, want))
    assert a == b, (sorted(set(a) - set(b))[:5], sorted(set(b) - set(a))[:5])
    if name == "op4_language_divergence":
        kept = {r["doc_id"]: r["kept"] for r in got.collect()}
        assert not any(kept[i] for i in (1000, 1001, 1002, 1003)) and sum(kept[i] for i in range(100, 150)) > 20
    if name == "op5_simhash_windows":
        assert {r["item_id"] for r in got.collect()} >= {1, None, 4, 5} and any(r["doc_id"] is None for r in got.collect())
    assert QUERIES[name](spark, f"{folder}/none").collect() == []
