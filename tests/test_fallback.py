"""The model-free removal against a plain reading of the same values, sentence by sentence and on made-up letters and edges."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import fallback
from vellum.functions import terms as T

LETTERS = [
    "Patient: Müller, Hans\nGeb.: 01.01.1980\nDiagnose: Diabetes", "geboren am 3-4-1971, Geburtsdatum: 1971-04-03", "Versichertennummer: A123456789 und Fallnummer: ABC-123, Aktenzeichen 2024/12", "Hauptstraße 12a, 50667 Köln am Rhein, Tel 0221 1234567 +49 30 123-456",
    "Mail a.b@c-d.de, www.example.de/x?y=1 und https://a.b.example.com", "Sehr geehrte Frau Kollegin, wir berichten.\nMit freundlichen Grüßen Dr. X\nHochachtungsvoll Y\nEnde", "Steuer-ID: 12 345 678 910 Steuernummer 12345678910, SV-Nummer: 65 010175 R 001, RVN 65010175R001",
    "Reisepass Nr. C01X00T47, Personalausweis: L01X00T47Z, Ausweis 1234567890", "Behandlungsnummer: 2024-12345 Aufnahme Nr 7 Station-Nummer 3b", "Krankenkassennummer: 123456789012", "Mobil: 0151 12345678 Handy +49 171-1234567 Fax: 030 555 66", "Bergweg 5-7 Etage 3, Feldpfad 9, Marktplatz 1",
    "Geschlecht: weiblich, geschlecht m", "Dr. med. Schmidt und Prof. Dr. Weber, Dr Hansen", "Frau Maria Schmidt\nHerr Otto mit Leber\n  Prof. Groß spricht\nTherapie Otto Weber Anna Klein\nMax Muster", "Vitamin D3, Vit. B12, 25-OH-D3, I50.1, 5-470.11, 2339-0, HbA1c 6,1, CK-MB, ck, Hämoglobin 12.5 g/dl, Leber: 15 cm, Metformin 500",
    "Morbus Crohn Alzheimer Typ, Karl Crohn Typ", "x  y\t z\n\n\n\nq ", "", None, " Vitamin D zwei Zeichen ", "Éric Ärzte Österreich Übung Äb", "0049 1", "CT CTA ct-CT RF", "Labor vom 12.03.2024 am 1.2.24, * 3.4.50",
]




def protect(text, ledger):
    """Protected pieces leave the text for the ledger, found by the alternatives one after another at each place."""
    terms = [*T.TERMS, *T.DRUGS]
    codes = [re.compile(c) for c in fallback.CODES]
    longest = lambda xs: "|".join(re.escape(w) for w in sorted(xs, key=lambda w: (-len(w), w)))
    codes.append(re.compile(rf"(?:{longest(t for t in terms if len(t) > 3)})\s*:?\s*[0-9]+[,.]?[0-9]*\s*[a-zA-Z/%]*\b", re.I))
    codes.append(re.compile(rf"(?:{longest([*fallback.ABBREVIATIONS, *T.DRUGS])})\b", re.I))
    out, at = [], 0
    while at < len(text):
        m = re.compile(f"[{fallback.OPEN}{fallback.CLOSE}{fallback.DIGITS}]").match(text, at)
        if not m and re.compile(r"\b").match(text, at):
            m = next((m for c in codes if (m := c.match(text, at))), None)
        if m and m.group():
            ledger.append(m.group())
            out.append(f"{fallback.OPEN}{str(len(ledger)).translate(str.maketrans('0123456789', fallback.DIGITS))}{fallback.CLOSE}")
            at = m.end()
        else:
            out.append(text[at])
            at += 1
    return "".join(out)


def passes(text):
    types, n = [], 0
    for kind, flags, pattern, instead, _ in fallback.PASSES:
        found = re.compile(pattern, (re.I if "i" in flags else 0) | (re.M if "m" in flags else 0))
        if found.search(text):
            n += 1
            types += [kind] if kind not in types else []
        text = found.sub(instead, text)
    return text, types, n


def names(text):
    terms, listed = [*T.TERMS, *T.DRUGS], {*T.TERMS, *T.DRUGS, *T.EPONYMS}
    text = re.sub(fallback.TITLED, "[NAME ENTFERNT]", text)
    lines = [x for x in text.split("\n") if not re.match(fallback.LED, x) or any(t in x.lower() for t in terms)]
    run = r"\b[A-ZÄÖÜ][a-zäöüß]+(?:\s+[A-ZÄÖÜ][a-zäöüß]+){1,2}\b"
    return "\n".join(re.sub(run, lambda m: m.group() if {w.lower() for w in m.group().split()} & listed else "", x) for x in lines)


def plain(text):
    if not text:
        return "", [], 0, 0
    ledger = []
    text, types, n = passes(protect(text, ledger))
    text = names(text)
    text = re.sub(f"{fallback.OPEN}([{fallback.DIGITS}]+){fallback.CLOSE}", lambda m: ledger[int(m[1].translate(str.maketrans(fallback.DIGITS, "0123456789"))) - 1], text)
    return re.sub(r"[ \t]+", " ", re.sub(r"\n{3,}", "\n\n", text)).strip(), types, n, len(ledger)


@pytest.fixture(scope="module")
def letters(spark):
    more = ["\n".join(x for x in LETTERS if x), "\n".join(reversed([x for x in LETTERS if x])) * 3, "".join((fallback.OPEN, "Vitamin D ", fallback.DIGITS[3], fallback.CLOSE, " 7")), "wort " * 20_000 + "Geb.: 1.1.1980"]
    return spark.createDataFrame(list(enumerate(LETTERS + more)), "id long, text string").withColumns({"masked_": F.lit(1), "types_": F.lit(2)})


def test_filtered(letters):
    for r in fallback.filtered(letters).collect():
        text, types, n, k = plain(r.text)
        assert (r.clean, r.types, r.pattern_removals, r.n_protected) == (text, ",".join(types), n, k), r.text
        assert r.content_kept == (len(text) <= 200 or any(w in text.lower() for w in fallback.INDICATORS)) and r.review == (not r.content_kept) and r.quality == 100.0


def test_passes(letters):
    for r in fallback.removed(letters.select("id", F.col("text").alias("before"), F.coalesce("text", F.lit("")).alias("text")), "text").collect():
        assert (r.text, r.types, r.pattern_removals) == (lambda t, k, n: (t, ",".join(k), n))(*passes(r.before or ""))


def test_round_trip(letters):
    rows = fallback.protected(letters, "text").select("text", "masked", fallback.restored(F.col("masked"), F.col("ledger")).alias("back"), "ledger").collect()
    for r in rows:
        assert r.back == (r.text or "")
        assert not any(x in r.masked for x in ("Vitamin", "2339-0", "Metformin"))
    # entries survive all passes, each once
    kept = fallback.removed(fallback.protected(letters, "text"), "masked").select(F.regexp_count("masked", F.lit(fallback.OPEN)).alias("n"), F.size("ledger").alias("k"), "text").collect()
    assert all(r.n == r.k for r in kept)


def test_date_context(spark):
    cases = [("Geboren ", "pii"), ("Labor vom ", "medical"), ("irgendwo ", "pii"), ("Untersuchung, geb. ", "pii"), ("", "pii"), ("Befund " + "x" * 50, "medical" if "am" in "x" * 50 else "pii")]
    df = spark.createDataFrame([(b[-50:], k) for b, k in cases], "before string, kind string")
    assert df.where(fallback.date_context(F.col("before")) != F.col("kind")).count() == 0


def test_quality(spark):
    r = spark.range(1).select(*[fallback.quality(*[F.lit(x) for x in v]).alias(str(i)) for i, v in enumerate([(0, 0, 0, 0), (1, 0, 0, 0), (0, 0, 1, 2), (2, 1, 1, 1)])]).first()
    assert list(r) == [100.0, 100.0, 60.0, 86.0]


def test_terms_are_bounded():
    with pytest.raises(ValueError):
        fallback.protection([f"t{i}" for i in range(fallback.MOST_TERMS + 1)])


def test_catalogue(spark, sf):
    from collections import Counter

    from vellum.plans import fallback as letters_plan
    from vellum.plans import parts

    want = Counter(k for r in letters_plan.letters(spark, sf).collect() for k in passes(r.text)[1])
    got = {r.kind: (r.marker, r.n) for r in parts.QUERIES["pi31_catalogue"](spark, sf).collect()}
    assert set(got) == {p[0] for p in fallback.PASSES} and len(got) == 20
    assert all(n == want[k] for k, (_, n) in got.items()) and got["birthdate"][0] == "[GEBURTSDATUM ENTFERNT]"


def test_quick_passes_find_the_same(spark):
    """Letters that match without case, streets, words side by side: gates and quick expressions change no match."""
    odd = ["Patıent: Anna", "Haupt\u017ftraße 12a Hauptstr. 5 Hauptweg 3b-Ringweg  7", "éHauptstraße 5 x_Hauptstraße 5 Ringß 5 Aweg\u00a012 Domplatz 12-14b Etage 3", "Fall: X12 Akte-Nr. 7/8 kran\u212aenakte: 12 GESCHLECHT: m Telefax: 0211 99 Handy 0171 234", "Reisepass-Nr: C12345678 SV-Nummer: 12 345678 A 123 St.-Nr. 12 345 678 901",
           "vitamın D3 VİTAMIN B12 25-OH I50.1 5-123.4 Metformin 500 mg ck-mb ntprobnp NT-proBNP \u017fpO2 xCRP CRP. CRP_ _CRP äCRP"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*odd, " ".join(odd)])], "id long, text string")
    for kind, flags, pattern, _, literals in fallback.PASSES:
        plain, quick = fallback.expression_of(flags, pattern), fallback.expression_of(flags, fallback.quick(kind, pattern))
        for r in rows.select("text", F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(quick), F.lit(0)).alias("b")).collect():
            assert r.a == r.b, (kind, r)
    forked, fallback.FORK = fallback.protection(), 1000
    try:
        plain = fallback.protection().replace("(?<![A-Za-z0-9_])", "")
    finally:
        fallback.FORK = 5
    for r in rows.select(F.regexp_extract_all("text", F.lit(plain), F.lit(0)).alias("a"), F.regexp_extract_all("text", F.lit(forked), F.lit(0)).alias("b")).collect():
        assert r.a == r.b
    assert fallback.removed(rows, "text").where("id = 0").first().types == "patient_name"


def test_one_search_a_text(spark, monkeypatch):
    """Ledger and masked text come from one search; a text that holds the mark itself is searched twice, with the same result."""
    searches, expression = [], fallback.protection()
    for name in ("split", "regexp_replace", "regexp_extract_all"):
        made = getattr(F, name)
        monkeypatch.setattr(fallback.F, name, lambda *a, made=made, name=name: searches.append(name) or made(*a))
    texts = [x for x in LETTERS if x] + ["", "Leber 15 cm", "x CRP 4", "CRPCRP CRP CRP"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "id long, text string")
    fast = fallback.protected(rows, "text", expression)
    assert "regexp_replace" in searches
    monkeypatch.undo()
    M = fallback.MARK
    slow = fallback.protected(rows.withColumn("text", F.concat(F.lit(M + " "), "text", F.lit(" " + M))), "text", expression)
    got, also = {r.id: (r.masked, list(r.ledger)) for r in fast.collect()}, {r.id: (r.masked[2:-2], list(r.ledger)) for r in slow.collect()}
    for i, x in enumerate(texts):
        ledger = []
        want = protect(x, ledger)
        assert got[i] == also[i] == (want, ledger), x


def test_gates_after_removals(spark):
    """What a pass puts in or leaves is seen by later ones, though the folded text is made again only once for the first passes."""
    texts = ["versicherte: Anna, Berta", "vorname: Anna name ENTFERNT , Weg", "Mit freundlichen Grüßen\nStation-Nr: 12 Tel: 0171 2345678", "Patient: Anna patienten-id 12 fall-nr 7 fall nummer: 8 krankenakte 3", "st.nr 12 345 678 910 St Nr: 12345678910", "Aufnahme Nr 7 bettnummer 12-3",
             "kranken kassen versichertennummer A123456789 krankekasse-nummer 123456789", "Handy: +49 171 234567 mobil 0049-1512345 tel. 0161234", "geb: 1.1.1980 geboren am 2.2.1990", "a  b\tc\t d \t\t e   f", "x\n\n\n\ny", "12345 Köln 123456 Bonn x12345 Bonn 1234 Ulm 12345 Ulm Nord"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*texts, " ".join(texts), "\n".join(texts)])], "id long, text string")
    for r in fallback.removed(rows.withColumn("before", F.col("text")), "text").collect():
        assert (r.text, r.types, r.pattern_removals) == (lambda t, k, n: (t, ",".join(k), n))(*passes(r.before)), r.before
    for r in fallback.filtered(rows).collect():
        assert r.clean == plain(r.text)[0], r.text
