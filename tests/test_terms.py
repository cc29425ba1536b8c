"""Term dictionaries, eponyms and the verifier against plain readings on made-up rows and edges."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import terms as T
from vellum.operators import terms as ops


def stems(word):
    return [word.lower()] + [word.lower()[: -len(s)] for s in T.SUFFIXES if len(word) > len(s) + 3 and word.lower().endswith(s)]


def via(word, terms):
    if word.lower() in terms:
        return "exact"
    if any(f in terms for f in stems(word)):
        return "stem"
    return "word" if " " in word and any(f in terms for part in word.split() for f in stems(part)) else None


PHRASES = ["Nächtliche", "Herzens", "Kardialen", "Mitralinsuffizienz Grad I", "Leber", "Max Mustermann", "Herz Muster", "es", "Ernen", "Vitamin Dosis", "LUNGEN", "Zellen Herr", "", "Ödeme"]


def test_protected_phrases(spark):
    terms = ops.dictionary(spark, spark.createDataFrame([("Mitralinsuffizienz",), (None,), (" ",), ("leber",)], "term string"))
    known = {r.term for r in terms.collect()}
    df = spark.createDataFrame([(p,) for p in PHRASES + PHRASES + [None]], "phrase string").withColumns({"word": F.lit(1), "via": F.lit("x")})
    got = {r.phrase: r.via for r in ops.protected_phrases(df, terms).collect()}
    assert got == {p: via(p, known) for p in PHRASES}
    assert got["Nächtliche"] == "stem" and got["Mitralinsuffizienz Grad I"] == "word" and got["Max Mustermann"] is None


def test_protected_tokens(spark):
    terms = spark.createDataFrame([("herz",), ("leber",), ("st-strecke",)], "term string")
    docs = [(1, "Herz Herzen herz, Leber! x"), (1, "Herz Herzen herz, Leber! x"), (2, None), (3, ""), (4, "ST-Strecke; Lebern (Leber) é"), (5, "nichts")]
    got = sorted(tuple(r) for r in ops.protected_tokens(spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(7)), terms).collect())
    assert got == sorted([(1, 5, 4, 1, "herz herzen leber")] * 2 + [(2, 0, 0, 0, ""), (3, 0, 0, 0, ""), (4, 4, 3, 1, "leber lebern st-strecke"), (5, 1, 0, 0, "")])
    assert ops.protected_tokens(spark.createDataFrame([], "doc_id long, text string"), terms).count() == 0


def test_protected_tokens_shuffle_no_words_for_few_terms(spark, monkeypatch):
    """Few terms meet the words where these are; many, by a join on words, find the same."""
    terms = spark.createDataFrame([("herz",), ("leber",), ("abc",), ("herzen",)], "term string")
    words = ["Herz", "herzen", "Lebern", "abcn", "abc", "HERZENES", "ungen", "x", "leberische"]
    docs = spark.createDataFrame([(i, " ".join(words[i % 4 :] + words[: i % 7])) for i in range(9)] + [(2, None)], "doc_id long, text string")
    few = ops.protected_tokens(docs, terms)
    assert "hashpartitioning(word" not in few._jdf.queryExecution().executedPlan().toString()
    want = {r.word: r.via for r in ops.matched_words(spark.createDataFrame([(w,) for w in words], "word string"), terms).collect()}
    forms = {r.form: r.via for r in ops.all_forms(terms).collect()}
    assert want == {w: forms[w.lower()] for w in words if w.lower() in forms}
    monkeypatch.setattr(ops, "BROADCAST_ROWS", 1)
    many = ops.protected_tokens(docs, terms)
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_many_terms_need_no_broadcast(spark):
    terms = spark.range(500).select(F.concat(F.lit("t"), "id").alias("term"))
    assert ops.sized(terms, 100) is terms and "BROADCAST" not in ops.sized(terms, 100)._jdf.queryExecution().toString().upper()
    assert ops.sized(terms, 500) is not terms


@pytest.mark.parametrize("reach", [50, 4])
def test_eponyms(spark, reach):
    texts = ["Morbus Crohn und Frau Schmidt", "Crohn", "Ab Cd Ef Gh Ij Kl Mn Morbus " + "Xy " * 30 + "Ende", "Diagnose: Parkinson. " + "leer " * 20 + "Weit", None, "", "ÄrztinKurz Über é Syndrom-Nahe", "Morbus" + " " * 43 + "Knapp" + " " * 44 + "Fern"]
    names = spark.createDataFrame([("crohn",), ("Parkinson",)], "name string")
    got = sorted(tuple(r) for r in ops.eponyms(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), names, reach).collect())
    want = []
    for i, text in enumerate(texts):
        for k, m in enumerate(re.finditer(r"\b[A-ZÄÖÜ][a-zäöüß]+\b", text or "")):
            around = text[max(m.start() - reach, 0) : m.end() + reach].lower()
            want.append((i, k, m.group(), m.group().lower() in ("crohn", "parkinson"), any(w in around for w in T.DISEASE_WORDS)))
    assert [(i, n, a, b) for i, _, n, a, b in got] == [(i, n, a, b) for i, _, n, a, b in sorted(want)]


def first_rule(term):
    """The rules read one after another."""
    low = term.lower()
    if len(term) < 2:
        return False, "too_short"
    for group in (T.TEMPORAL, "german_temporal_medical"), (T.SCORES, "scoring_system:{}"), (T.ABBREVIATIONS, "medical_abbrev:{}"), (T.ANATOMY_ALL, "anatomical:{}"), (T.GENERA + T.SPECIES, "bacterial:{}"):
        if low in group[0]:
            return True, group[1].replace("{}", low)
    if re.search(T.BACTERIA, term, re.I):
        return True, "bacterial_species"
    if re.search(T.ANTIBODIES, term, re.I):
        return True, "autoantibody"
    if found := [s for s in T.ENDINGS if low.endswith(s) and len(low) > len(s) + 2]:
        return True, f"german_suffix:{max(found, key=len)}"
    if found := [p for p in T.BEGINNINGS if low.startswith(p) and len(low) > len(p) + 3 and low.endswith(tuple(T.BEGUN_ENDS))]:
        return True, f"german_prefix:{max(found, key=len)}"
    if re.search("|".join(T.COMPOUNDS), low):
        return True, "compound_medical_term"
    return next(((True, f"german_root:{r}") for r in T.ROOTS if r in low), (False, "not_medical"))


CASES = [
    "Nächtliche", "nächtliches", "Child-Pugh", "los angeles", "ÖGD", "PCR", "Unterlappen", "hochgradiger", "Mittellappencarina", "Zytologische", "Vitamin B12", "E. coli", "epidermidis", "Staph. epidermidis", "Nostaphylo", "anti-Jo-1", "Anti SMA Titer", "antizipiert",
    "Gastroskopisch", "Appendizitis", "itis", "xitis", "Hyperkapnie", "Paraxal", "Panik", "ST-Strecken-Veränderungen", "Durchblutungsstörungen", "Kardiologe", "Stoffwechselumsatzes", "Thrombose", "Müller", "Schmidt", "a", "", "München", "Trikuspidalklappeninsuffizienz", "Anastomosenring",
    "endogen", "bisher", "postal", "Vitaminreich", "x é",
]


def test_verified(spark):
    table = ops.rules(spark)
    got = {r.term: (r.is_medical, r.reason) for r in ops.verified(spark.createDataFrame([(c,) for c in CASES + CASES + [None]], "term string").withColumn("low", F.lit(1)), table).collect()}
    assert got == {c: first_rule(c) for c in CASES}
    assert got["Müller"] == (False, "not_medical") and got["Child-Pugh"] == (True, "scoring_system:child-pugh")


def test_abbreviations_come_first(spark):
    table = ops.rules(spark, spark.createDataFrame([("MRT", "m" * 60), ("XYZ", None), ("Q1", "")], "abbreviation string, meaning string"))
    got = {r.term: r.reason for r in ops.verified(spark.createDataFrame([("mrt",), ("xyz",), ("Q1",)], "term string"), table).collect()}
    assert got == {"mrt": "abbreviation:" + "m" * 50, "xyz": "abbreviation:known", "Q1": "abbreviation:known"}
