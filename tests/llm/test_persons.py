"""Persons that the gazetteer doesn't know are proposed where the context speaks for them."""

from pyspark.sql import functions as F

from tessera.llm import pii

TEXTS = {
    "Contact: Ahmed Khan": ["Ahmed Khan"],
    "Hello Dr Elena Rossi and others": ["Elena Rossi"],
    "nombre: Íñigo Núñez, konto: Jürgen Groß": ["Jürgen Groß", "Íñigo Núñez"],
    "Mr Ahmed John Smith": ["John Smith"],
    "Maria Núñez came": ["Maria Núñez"],
    "Yesterday John Smith": ["John Smith"],
    "Call Contact Desk": [],
    "The Great River was wide": [],
    "version Ahmed Khan": [],
    "name\nAhmed Khan": [],
    "Contact Élodie Durand and John Smith": ["John Smith", "Élodie Durand"],
}


def test_persons_are_proposed_by_context(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    spans = docs.select("doc_id", "text", F.explode(pii.candidates(F.col("text"))).alias("s")).where("s.kind = 'person'").collect()
    got = {t: sorted(r["text"][r["s"]["start"] : r["s"]["end"]] for r in spans if r["text"] == t) for t in TEXTS}
    assert got == TEXTS
    votes = {r["text"]: (r["s"]["gazetteer"], r["s"]["context"]) for r in spans}
    assert votes["Contact: Ahmed Khan"] == (-1, 1) and votes["Maria Núñez came"] == (1, 0)
