"""All spans of op1 against a plain-Python version of its labelers, and redaction of spans that overlap."""

import math
import random
from collections import Counter
from itertools import permutations

import regex
from pyspark.sql import functions as F

from tessera.llm import pii
from tests.llm.test_spans import EDGE, base_pii, luhn

BITS = [
    " ", "\n", ". ", ": ", "a", "name", "Dr ", "call ", "version ", "John Smith", "Elena Rossi", "The Road", "Monday Smith", "Ahmed Khan", "123-45-6789", "000-12-3456", "(555) 234-5678", "555-555-0123", "DE44 5001 0517 5407 3249 31", "XX12 1234 1234 1234",
    "31/12/1980", "39/19/1980", "2001-02-03", "2044-13-31", "born ", "a@b.cd", "+49 30 1234567", "4111111111111111", "10.0.0.1", "7",
]


def strict(kind, t):
    digits = regex.sub("[^0-9]", "", t)
    if kind == "ip":
        return all(int(x) <= 255 for x in t.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "national_id":
        return not (t[:3] in ("000", "666") or t[0] == "9" or t[4:6] == "00" or t[-4:] == "0000")
    if kind == "local_phone":
        return digits[0] in "23456789" and digits[3] in "23456789"
    if kind == "iban":
        return 15 <= len(t.replace(" ", "")) <= 34
    if kind == "birth_date":
        a, b, c = regex.split("[/.-]", t)
        if len(a) == 4:
            return 1 <= int(b) <= 12 and 1 <= int(c) <= 31
        return 1 <= min(int(a), int(b)) <= 12 and 1 <= max(int(a), int(b)) <= 31
    return True


def known(kind, t):
    if kind == "email":
        return int(t.lower().rsplit(".", 1)[1] in "com org net edu gov info io de es fr uk eu it nl pt".split())
    if kind == "ip":
        return -1 if t.startswith(pii.PRIVATE_NETS) else 0
    if kind == "card":
        return 1 if regex.match("4|5[1-5]|2[2-7]|3[47]|6", t) else 0
    if kind == "phone":
        return 1 if regex.match(pii.CALLING, t) else -1
    if kind == "local_phone":
        return -1 if regex.search(r"555[ .-]01[0-9]{2}$", t) else 0
    if kind == "iban":
        return 1 if t[:2] in pii.IBAN_LANDS else -1
    if kind == "birth_date":
        return 0 if regex.search("19[0-9]{2}|20[01][0-9]", t) else -1
    if kind == "person":
        first, last = t.split(" ")
        return -1 if {first, last} & set(pii.NO_NAMES) else 1 if first in pii.GIVEN or last in pii.FAMILY else -1
    return 0


def proposed(kind, pattern, text):
    out, last = [], 0
    for m in regex.finditer(pattern, text):
        before = text[last : m.start()][-40:]
        last = m.end()
        context = -1 if regex.search(pii.AGAINST, before) else 1 if regex.search(pii.CONTEXT, before) else 0
        edge = 0 if not before else 1 if before[-1] in " \t\n\x0b\x0c\r" else 2 if regex.search(r"[\p{L}\p{M}0-9]$", before) else 3
        regular = 0 if kind == "person" else 1 if strict(kind, m.group()) else -1
        out.append((kind, m.start(), m.end(), (kind, regular, known(kind, m.group()), context, min(3, len(m.group()) // 8), edge)))
    return out


def overlap(a, b):
    return a[1] < b[2] and b[1] < a[2]


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def spans_of(text):
    found = {k: proposed(k, p, text) for k, p in (PLAIN | pii.MORE | {"person": pii.GIVEN_PERSON}).items()}
    base = [s for k in pii.BASE for s in found[k] if s[3][1] == 1]
    told = [s for s in proposed("person", pii.TOLD_PERSON, text) if s[3][3] == 1 and not any(overlap(s, o) for o in found["person"])]
    return base, [s for k in pii.MORE for s in [*found[k], *(told if k == "person" else [])] if not any(overlap(s, b) for b in base)]


def test_all_spans(spark):
    rng = random.Random(9)
    texts = [t or "" for t in EDGE] + ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 30))) for _ in range(300)]
    both = [spans_of(t) for t in texts]
    counts = Counter(s[3] for base, more in both for s in base + more)
    model = pii.train(sorted((*k, n) for k, n in counts.items()))

    def probability(features):
        score = model.weights.get(("bias", 1), 0.0) + sum(model.weights.get(f, 0.0) for f in zip(pii.FEATURES, features, strict=True))
        return 1 / (1 + math.exp(-score))

    want = []
    for t, (base, more) in zip(texts, both, strict=True):
        assert [s[:3] for s in base] == base_pii(t)
        own = base + [s for s in more if probability(s[3]) > 0.5]
        own.sort(key=lambda s: (pii.KINDS.index(s[0]), s[1]))
        want.append(",".join(f"{k}:{a}:{b}" for k, a, b, _ in own))
    got = pii.digest(pii.find(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()
    assert [r["spans"] for r in sorted(got, key=lambda r: r["doc_id"])] == want
    kinds = {s.split(":")[0] for w in want for s in w.split(",") if s}
    # the classifier takes some and leaves some
    assert kinds >= {"email", "phone", "person"} and sum(len(m) for _, m in both) > sum(len(b) for b, _ in both) / 9
    assert any(probability(s[3]) <= 0.5 for _, more in both for s in more) and any(probability(s[3]) > 0.5 for _, more in both for s in more)


def test_redaction_takes_all_of_overlapping_spans(spark):
    text = "0123456789abcdefghij"
    places = [(2, 6), (4, 9), (4, 6), (2, 9), (6, 8), (9, 12)]
    rows = []
    for one, two in permutations(pii.KINDS, 2):
        for (a, b), (c, d) in permutations(places, 2):
            rows.append((text, sorted([(pii.KINDS.index(one), a, b, one), (pii.KINDS.index(two), c, d, two)])))
    got = spark.createDataFrame(rows, f"text string, spans {pii.SPAN}").select("spans", pii.redact(F.col("text"), F.col("spans")).alias("t")).collect()
    for r in got:
        want, at = "", 0
        for s in sorted(r["spans"], key=lambda s: (s["start"], -s["end"], s["kind"])):
            if s["start"] >= at:
                want += text[at : s["start"]] + f"<{s['kind'].upper()}>"
            at = max(at, s["end"])
        assert r["t"] == want + text[at:]
        hidden = {i for s in r["spans"] for i in range(s["start"], s["end"])}
        assert "".join(c for i, c in enumerate(text) if i not in hidden) == regex.sub("<[A-Z_]+>", "", r["t"])
    found = pii.find(spark.createDataFrame([(1, "call +49 301 234 567a@b.cd now")], "doc_id long, text string"), keep=("text",))
    assert found.select(pii.redact(F.col("text"), F.col("spans"))).collect()[0][0] == "call <PHONE> now"
