"""Lists and references of languages: words of any length, null as a language, languages of any size and number."""

import random
from collections import Counter

from tessera.llm import quality

SCHEMA = "doc_id long, text string, lang string"
LONG = ["nicht", "einer", "werden", "zwischen", "gegenüber", "Wirtschaft"]


def prose(rng, n=90, common=LONG):
    return " ".join(rng.choice(common) if rng.random() < 0.45 else "".join(rng.choice("aeioulnrst") for _ in range(rng.randint(5, 9))) for _ in range(n))


def junk(rng):
    return " ".join("".join(rng.choice("0123456789#%") for _ in range(8)) for _ in range(90))


def language(lang, first, n, rng):
    """n documents of a language, the last one divergent."""
    return [(first + i, prose(rng), lang) for i in range(n - 1)] + [(first + n - 1, junk(rng), lang)]


def verdicts(spark, rows):
    return {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, SCHEMA)).collect()}


def test_common_words_have_any_length(spark):
    rng = random.Random(1)
    rows = language("de", 0, 40, rng)
    counts = Counter(w for _, t, _ in rows for w in t.lower().split())
    want = sorted(counts, key=lambda w: (-counts[w], w.encode()))[:24]
    got = quality.common_words(spark.createDataFrame(rows, SCHEMA), quality.Limits()).collect()
    assert [r["_list"] for r in got] == [want] and {w.lower() for w in LONG} <= set(want)
    # no word of 4 characters or less in the language: both distances count, by words too
    rows.append((40, " ".join("".join(rng.choice("aeioulnrst") for _ in range(7)) for _ in range(90)), "de"))
    got = verdicts(spark, rows)
    assert all(got[i]["kept"] and got[i]["word_distance"] is not None for i in range(39))
    assert got[39]["char_distance"] > 0.3 and not got[39]["kept"]
    assert got[40]["word_distance"] > max(got[i]["word_distance"] for i in range(39))


def test_null_is_a_language_with_a_reference(spark):
    rng = random.Random(2)
    got = verdicts(spark, language(None, 0, 30, rng) + language("de", 100, 30, rng))
    for first in (0, 100):
        assert all(got[first + i]["kept"] for i in range(29))
        assert got[first + 29]["char_distance"] > 0.3 and not got[first + 29]["base_failed"] and not got[first + 29]["kept"]
    assert all(r["char_distance"] is not None and r["word_distance"] is not None for r in got.values())


def test_languages_of_any_size_and_number_have_references(spark):
    rng = random.Random(3)
    sizes = [2 if k else 19 for k in range(300)]
    rows = [r for k, n in enumerate(sizes) for r in language(f"x-{k}", 100 * k, n, rng)]
    got = verdicts(spark, rows)
    assert len(got) == len(rows) and all(r["char_distance"] is not None and r["word_distance"] is not None for r in got.values())
    assert all(got[i]["kept"] for i in range(18)) and got[18]["char_distance"] > 0.3 and not got[18]["kept"]
    # past the broadcast bound, and without it
    own = {r["doc_id"]: r for r in quality.measure(spark.createDataFrame(rows, SCHEMA), quality.Limits(languages=1000)).collect()}
    assert all(got[i]["kept"] == own[i]["kept"] and abs(got[i]["char_distance"] - own[i]["char_distance"]) < 1e-9 for i in got)
    # a document by itself
    assert verdicts(spark, language("solo", 0, 1, rng))[0]["char_distance"] == 0
