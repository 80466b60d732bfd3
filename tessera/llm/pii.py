"""Personal data by weak supervision: labelers vote on candidate spans, expectation-maximisation weighs them."""

from __future__ import annotations

import math
from collections import defaultdict
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let
from .spans import listed, matches

# The contract's base kinds in its order, then the candidate kinds of this method.
# A look-behind with \G only spares the regex engine starts inside a run that has failed at its beginning.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9]){12,}+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "national_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "local_phone": r"(?<![0-9+(.-])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?![A-Za-z0-9])",
    "birth_date": r"(?<![0-9/.-])(?:[0-3]?[0-9][/.-][01]?[0-9][/.-](?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9])(?![0-9/-])",
    "person": r"(?<![\p{L}\p{M}])\p{Lu}[\p{Ll}\p{M}]{1,20}\x20\p{Lu}[\p{Ll}\p{M}]{1,20}(?![\p{L}\p{M}])",
}
#: A character that any match of the kind has, to spare texts without it.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "national_id": "-"}
#: Words that tell personal data of any kind, right before a span.
SIGNS = "name|mr|mrs|ms|dr|contact|call|phone|tel|mobile|fax|e-?mail|mail|card|visa|account|iban|ssn|social security|born|birth|dob|ip|address|nombre|correo|nom|telefono|telefon|konto|geboren"
CONTEXT = rf"(?i)(?<![a-z])(?:{SIGNS})(?![a-z])[^\n]{{0,20}}$"
#: Words before a span that tell something else, such as a version or an amount.
AGAINST = r"(?i)(?<![a-z])(?:version|release|section|chapter|figure|page|isbn|issn|part|order|invoice|total|price|vol|no)(?![a-z])[^\n]{0,8}$"
#: Frequent given and family names of four languages, and capitalised words that are no names.
GIVEN = (
    "James", "Mary", "John", "Patricia", "Robert", "Jennifer", "Michael", "Linda", "David", "Elizabeth", "William", "Barbara", "Richard", "Susan", "Thomas", "Sarah", "Maria", "Carlos", "Juan", "Ana",
    "Luis", "Jose", "Pierre", "Marie", "Jean", "Sophie", "Hans", "Anna", "Klaus", "Peter", "Paul", "Laura", "Charles", "Joseph", "Daniel", "Matthew", "Anthony", "Mark", "Steven", "Andrew", "Emily",
    "Karen", "Nancy", "Margaret", "Sandra", "Ashley", "Emma", "Olivia", "George", "Kevin", "Brian", "Edward", "Alice", "Helen", "Jack", "Henry", "Antonio", "Manuel", "Francisco", "Javier", "Miguel",
    "Pedro", "Carmen", "Isabel", "Lucia", "Elena", "Marta", "Pablo", "Sergio", "Diego", "Michel", "Philippe", "Alain", "Nicolas", "Julien", "Claire", "Camille", "Isabelle", "Nathalie", "Catherine", "Antoine",
    "Louis", "Jacques", "Wolfgang", "Stefan", "Andreas", "Markus", "Sabine", "Monika", "Ursula", "Petra", "Heike", "Jens", "Uwe", "Birgit", "Karl", "Friedrich", "Greta", "Lukas", "Felix", "Martin",
)
FAMILY = (
    "Smith", "Johnson", "Williams", "Brown", "Jones", "Miller", "Davis", "Wilson", "Anderson", "Taylor", "Moore", "Jackson", "Thompson", "White", "Harris", "Clark", "Lewis", "Robinson", "Walker", "Young",
    "Garcia", "Rodriguez", "Martinez", "Hernandez", "Lopez", "Gonzalez", "Perez", "Sanchez", "Ramirez", "Torres", "Fernandez", "Gomez", "Diaz", "Ruiz", "Moreno", "Dubois", "Bernard", "Durand", "Moreau", "Laurent",
    "Lefebvre", "Leroy", "Roux", "Fournier", "Girard", "Schneider", "Fischer", "Weber", "Meyer", "Wagner", "Becker", "Schulz", "Hoffmann", "Koch", "Bauer", "Richter", "Klein", "Wolf", "Neumann", "Zimmermann",
)
NO_NAMES = (
    "Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday", "January", "February", "March", "April", "June", "July", "August", "September", "October", "November", "December", "The", "This",
    "That", "These", "And", "But", "New", "North", "South", "East", "West", "United", "University", "License", "Public", "General", "Apache", "Street", "Road", "Avenue", "City", "County",
)
#: Calling codes of countries, by their first digits.
CALLING = r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|2[1-6][0-9]|3[578][0-9]|42[01]|50[0-9]|59[0-9]|67[0-9]|68[0-9]|85[0-9]|88[0-9]|96[0-9]|97[0-9]|99[0-9])"
#: Persons are proposed by a given name, or else by a word of CONTEXT before two words that aren't of it.
_FIRST = r"\p{Lu}[\p{Ll}\p{M}]{1,20}\x20"
_NO_SIGN = rf"(?!(?i:{SIGNS})(?![\p{{L}}\p{{M}}]))"
GIVEN_PERSON = MORE["person"].replace(_FIRST, rf"(?=[A-Z])(?:{'|'.join(GIVEN)})\x20", 1)
TOLD_PERSON = MORE["person"].replace(_FIRST, rf"(?=\p{{Lu}}){_NO_SIGN}(?<=(?i:(?<![a-z])(?:{SIGNS})(?![a-z]))[^\n]{{0,20}}){_FIRST}{_NO_SIGN}", 1)
PRIVATE_NETS = ("10.", "127.", "192.168.", "0.")
IBAN_LANDS = ("AT", "BE", "CH", "DE", "DK", "ES", "FI", "FR", "GB", "IE", "IT", "NL", "NO", "PL", "PT", "SE")

KINDS = (*BASE, *MORE)
LABELERS = ("regex", "gazetteer", "context")
FEATURES = ("kind", *LABELERS, "size", "edge")
CANDIDATE = "array<struct<rank:int,start:int,end:int,kind:string,base:boolean,regex:int,gazetteer:int,context:int,size:int,edge:int>>"


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def add(acc: Column, i: Column) -> Column:
        d = F.substring(digits, -1 - i, F.lit(1)).cast("int")
        twice = 2 * d
        return acc + F.when(i % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(0), F.length(digits) - 1), F.lit(0), add) % 10 == 0


def strict(kind: str, text: Column) -> Column:
    """Whether the match holds to its kind's format in full: the regex labeler's vote, but for persons, whose format says nothing."""
    digits = F.regexp_replace(text, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(text, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(F.split(text, r"\."), lambda p: F.right(F.concat(F.lit("000"), p), F.lit(3)).cast("int") <= 255)
    if kind == "card":
        return let(digits, lambda d: F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False))
    if kind == "phone":
        return F.length(digits).between(9, 15)
    if kind == "national_id":
        return ~(text.startswith("000") | text.startswith("666") | text.startswith("9") | text.contains("-00-") | text.endswith("0000"))
    if kind == "local_phone":
        return digits.rlike("^[2-9][0-9]{2}[2-9]")
    if kind == "iban":
        return F.length(F.replace(text, F.lit(" "), F.lit(""))).between(15, 34)
    if kind == "birth_date":
        day, month = "(?:0?[1-9]|[12][0-9]|3[01])", "(?:0?[1-9]|1[0-2])"
        return text.rlike(rf"^(?:{day}[/.-]{month}|{month}[/.-]{day})[/.-][0-9]{{4}}$") | text.rlike(rf"^[0-9]{{4}}-{month}-{day}$")
    return F.lit(True)


def known(kind: str, text: Column) -> Column:
    """The gazetteer labeler: 1 for, -1 against, 0 silent."""
    if kind == "email":
        return F.when(text.rlike(r"(?i)\.(com|org|net|edu|gov|info|io|de|es|fr|uk|eu|it|nl|pt)$"), 1).otherwise(0)
    if kind == "ip":
        return F.when(text.startswith(PRIVATE_NETS[0]) | text.startswith(PRIVATE_NETS[1]) | text.startswith(PRIVATE_NETS[2]) | text.startswith(PRIVATE_NETS[3]), -1).otherwise(0)
    if kind == "card":
        return F.when(text.rlike("^(4|5[1-5]|2[2-7]|3[47]|6)"), 1).otherwise(0)
    if kind == "iban":
        return F.when(F.left(text, F.lit(2)).isin(*IBAN_LANDS), 1).otherwise(-1)
    if kind == "phone":
        return F.when(text.rlike(CALLING), 1).otherwise(-1)
    if kind == "local_phone":
        # the numbers that are set aside for fiction
        return F.when(text.rlike(r"555[\x20.-]01[0-9]{2}$"), -1).otherwise(0)
    if kind == "birth_date":
        return F.when(text.rlike(r"(?:19[0-9]{2}|20[01][0-9])"), 0).otherwise(-1)
    if kind == "person":
        first, last = F.substring_index(text, " ", 1), F.substring_index(text, " ", -1)
        return F.when(first.isin(*NO_NAMES) | last.isin(*NO_NAMES), -1).when(first.isin(*GIVEN) | last.isin(*FAMILY), 1).otherwise(-1)
    return F.lit(0)


def edge(before: Column) -> Column:
    """What stands right before a span: 0 nothing or another match, 1 a blank, 2 a letter or digit, 3 another mark."""
    return F.when(before == "", 0).when(before.rlike(r"[\x09-\x0D\x20]$"), 1).when(before.rlike(r"[\p{L}\p{M}0-9]$"), 2).otherwise(3)


def candidates(text: Column) -> Column:
    """CANDIDATE spans of a text: every base span and what other kinds propose, each with the labelers' votes and, for the classifier, its
    size and edge.

    Proposals that overlap a base span are left out. A capitalised pair is proposed as a person when a labeler speaks for it: its
    first word is in the gazetteer, or the context votes for it and it overlaps no pair of the gazetteer's.
    """
    def voted(kind: str, rank: int):
        def item(m: Column) -> Column:
            context = F.when(m["before"].rlike(AGAINST), -1).when(m["before"].rlike(CONTEXT), 1).otherwise(0)
            return F.struct(
                F.lit(rank).alias("rank"), m["start"].alias("start"), m["end"].alias("end"), F.lit(kind).alias("kind"), F.lit(kind in BASE).alias("base"),
                (F.lit(0) if kind == "person" else F.when(strict(kind, m["text"]), 1).otherwise(-1)).alias("regex"), known(kind, m["text"]).cast("int").alias("gazetteer"), context.alias("context"),
                F.least(F.lit(3), F.floor((m["end"] - m["start"]) / 8)).cast("int").alias("size"), edge(m["before"]).alias("edge"),
            )

        return item

    found = {}
    for rank, kind in enumerate(KINDS):
        pattern = (BASE | MORE)[kind] if kind != "person" else GIVEN_PERSON
        spans = F.transform(matches(text, pattern), voted(kind, rank)).cast(CANDIDATE)
        found[kind] = F.when(text.contains(NEEDS[kind]), spans).otherwise(F.array().cast(CANDIDATE)) if kind in NEEDS else spans
    told = F.filter(F.transform(matches(text, TOLD_PERSON), voted("person", KINDS.index("person"))).cast(CANDIDATE), lambda m: m["context"] == 1)
    found["person"] = let(found["person"], lambda own: F.concat(own, F.filter(told, lambda m: ~F.exists(own, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))))
    base = F.filter(F.concat(*[found[k] for k in BASE]), lambda s: s["regex"] == 1)
    more = F.concat(*[found[k] for k in MORE])
    return let(base, lambda b: F.concat(b, F.filter(more, lambda m: ~F.exists(b, lambda s: (s["start"] < m["end"]) & (m["start"] < s["end"])))))


@dataclass(frozen=True)
class Model:
    """reliability[labeler][vote]: chance of the vote when a span is personal, and when it isn't; weights of the classifier."""

    prior: float
    reliability: dict[str, dict[int, tuple[float, float]]]
    weights: dict[tuple[str, object], float]
    rounds: int

    def probability(self, span: Column) -> Column:
        score = F.lit(self.weights.get(("bias", 1), 0.0))
        for (name, value), w in sorted(self.weights.items(), key=str):
            if name != "bias":
                score = score + F.when(span[name] == value, w).otherwise(0.0)
        return 1 / (1 + F.exp(-score))


def train(patterns: list[tuple], rounds: int = 50, steps: int = 300, rate: float = 1.0) -> Model:
    """Fit by expectation-maximisation on counts of (kind, regex, gazetteer, context, size, edge, spans), then train the classifier.

    Each labeler votes 1, -1 or 0 (silent), independently given the hidden truth. The truth's posterior of each vote pattern is
    the soft label of a logistic regression on kind, votes, size and edge, which thus can depart from the votes' independence and
    speaks of spans that no labeler told apart. There are at most 9 kinds x 27 votes x 4 sizes x 4 edges of patterns, whatever the input.
    """
    total = sum(p[-1] for p in patterns) or 1
    # the start: votes say what they say
    post = [1 / (1 + math.exp(-1.5 * (p[1] + p[2] + p[3]))) for p in patterns]
    prior, rel = 0.5, {}
    for _ in range(rounds):
        mass = sum(q * p[-1] for q, p in zip(post, patterns, strict=True))
        prior = min(max((mass + 1) / (total + 2), 1e-3), 1 - 1e-3)
        for i, name in enumerate(LABELERS, 1):
            yes, no = defaultdict(lambda: 1.0), defaultdict(lambda: 1.0)
            for q, p in zip(post, patterns, strict=True):
                yes[p[i]] += q * p[-1]
                no[p[i]] += (1 - q) * p[-1]
            rel[name] = {v: (yes[v] / (mass + 3), no[v] / (total - mass + 3)) for v in (-1, 0, 1)}
        last = post
        post = []
        for p in patterns:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rel[n][p[i]][0] / rel[n][p[i]][1]) for i, n in enumerate(LABELERS, 1))
            post.append(1 / (1 + math.exp(-max(-30.0, min(30.0, odds)))))
        if max((abs(a - b) for a, b in zip(post, last, strict=True)), default=0) < 1e-6:
            break
    weights: dict[tuple[str, object], float] = defaultdict(float)
    for _ in range(steps):
        slope: dict[tuple[str, object], float] = defaultdict(float)
        for q, p in zip(post, patterns, strict=True):
            own = [("bias", 1), *zip(FEATURES, p[:-1], strict=False)]
            z = sum(weights[f] for f in own)
            gap = (q - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) * p[-1] / total
            for f in own:
                slope[f] += gap
        for f, g in slope.items():
            weights[f] += rate * (g - 1e-4 * weights[f])
    return Model(prior, rel, dict(weights), rounds)


SPAN = "array<struct<rank:int,start:int,end:int,kind:string>>"


def find(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = 0.5, keep: tuple[str, ...] = ()) -> DataFrame:
    """Personal spans of every whole text: key, the columns of keep, and spans (SPAN, by kind, then start; code points, end exclusive).

    Base spans stay whatever the model says; of the other candidates those stay that the classifier gives more than the
    threshold. A null or empty text has none; repeated rows give rows of their own; an empty input gives no rows and a model of
    the priors alone. Candidates are written once, as one array a document, so the texts are searched once and nothing is joined;
    the vote patterns' counts (at most 3,888 rows) go to the driver.
    """
    own = [F.col(key), *[F.col(c) for c in keep]]
    voted = cut(docs.select(*own, candidates(F.coalesce(F.col(text), F.lit(""))).alias("_spans")), "candidates")
    patterns = voted.select(F.explode("_spans").alias("s")).select("s.*").groupBy(*FEATURES).count().collect()
    model = train(sorted(tuple(r) for r in patterns))
    chosen = F.filter("_spans", lambda s: s["base"] | (model.probability(s) > threshold))
    plain = F.transform(chosen, lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return voted.select(key, *keep, F.array_sort(plain).cast(SPAN).alias("spans"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, n_<kind> for the base kinds, base_sha256 and spans."""

    def of(*kinds: str) -> Column:
        return F.filter("spans", lambda s: s["kind"].isin(*kinds))

    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select(key, *counts, F.sha2(listed(of(*BASE)).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def redact(text: Column, spans: Column) -> Column:
    """The text with what spans cover replaced by a kind in angle brackets.

    Spans that overlap are one stretch, all of which goes, under the kind of the one that starts first, or else is longest.
    """
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        piece = F.substring(text, acc["at"] + 1, s["start"] - acc["at"])
        on = F.struct((-s["back"]).alias("at"), F.concat(acc["out"], piece, F.lit("<"), F.upper(s["kind"]), F.lit(">")).alias("out"))
        return F.when(s["start"] >= acc["at"], on).otherwise(F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), acc["out"].alias("out")))

    done = F.aggregate(order, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)
