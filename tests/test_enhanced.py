"""Post passes, pipe tables, enhancement, structuring and column clusters against plain readings."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import privacy, scans
from vellum.plans import fallback as letters_plan
from vellum.plans import scans as plans

TEXTS = [
    "anna.schmidt-fink\n@[EMAIL_DOMAIN] und max.muster@x.de, m_n\n @a.b-c.org", "O598926034 AB598926034, Status m Status X9 , STATUS K", "Tel 0211 /- 2764 [PHONE] / 12345 [PHONE]-77 1/22", "fallnummer 123456789 Fallnummer:12345678 TK/Hamburg, a/Berlin b/Ulm", "Rhedung 18 b, 41460 Neuss; Weg 3 , [PLZ_CITY]",
    "([IP_ADDRESS] g/l) ([ip_address]%) [IP_ADDRESS] g/l", "", "Natrium   140   mmol/l   135-145\n\n  a  b \nKalium  4,1", "Hamoglobin 13,5 g/dI\nLeukosyten: 8500 /µl\nText ohne\nBefund gut\nDiagnose: x 5 mg\nna 3", "Name   \n\nLaborwerte\nGlucose: 95 mg/dl (70 - 110)\nHämoglobin-Wert 13 (12)\nfoo 3\n4 foo", "ſtatus STATUſ M", "é1 ü 2 %",
]


def post(text):
    for flags, expression, instead in privacy.POST_PASSES:
        text = re.sub(expression, instead.replace("$", "\\"), text, flags=re.I if flags else 0)
    return text


def pipes(text):
    lines = [re.sub("  +", " | ", x).strip(scans.SPACE) for x in text.split("\n")]
    return re.sub(scans.CLEAN_ROW[4:], r"\1: \2 \3 (Referenz: \4)", "\n".join(x for x in lines if x))


def enhanced(text):
    for pattern, instead in scans.ENHANCED:
        text = re.sub(pattern, instead, text, flags=re.I)

    def written(m):
        name = m[1].strip()
        name = next((k.capitalize() for k, ws in scans.VARIATIONS.items() if any(w in name.lower() for w in ws)), name)
        return f"{name}: {m[2]}" + (f" {m[3]}" if m[3] else "")

    out, lab, finding = [], False, False
    for line in re.sub(scans.VALUE[4:], written, text).split("\n"):
        if not lab and any(w in line.lower() for ws in scans.VARIATIONS.values() for w in ws):
            out, lab = [*out, "\n=== LABORWERTE ==="], True
        if not finding and any(w in line.lower() for w in scans.FINDINGS):
            out, finding = [*out, "\n=== DIAGNOSE/BEFUND ==="], True
        out.append(line)
    return "\n".join(out)


def structured(text):
    out = []
    for line in (x.strip(scans.SPACE) for x in text.split("\n")):
        if not line:
            continue
        if any(h in line.lower() for h in scans.SECTIONS):
            out.append(f"\n=== {line.upper()} ===")
        elif m := re.match(scans.LINE_VALUE[4:], line):
            name = next((n for n in scans.NAMES if n.lower() in m[1].lower()), m[1].strip())
            out.append(f"{name}: {m[2]}" + (f" {m[3]}" if m[3] else "") + (f" (Referenz: {m[4].strip()})" if m[4] else ""))
        else:
            out.append(line)
    return "\n".join(out)


def clusters(lefts):
    found = []
    for x in lefts:
        mine = next((c for c in found if abs(c[0] - x) < 20), None)
        if mine is None:
            found.append([x])
        else:
            mine.append(x)
    return len(lefts) >= 10 and sum(len(c) >= 3 for c in found) >= 3


@pytest.fixture(scope="module")
def texts(spark, sf):
    wide = [r.text for r in plans._wide(letters_plan.letters(spark, sf)).limit(120).collect()]
    return spark.createDataFrame(list(enumerate(TEXTS + wide)), "id long, text string")


def test_post_passes(texts):
    before = {r.id: r.text for r in texts.collect()}
    for r in privacy.post_processed(texts, "text").collect():
        assert r.text == post(before[r.id]), before[r.id]


def test_pipe_tables(texts):
    for r in texts.select("text", scans.pipe_table(F.col("text")).alias("out")).collect():
        assert r.out == pipes(r.text), r.text


def test_enhanced(texts):
    before = {r.id: r.text for r in texts.collect()}
    for r in scans.enhanced(texts, "text").collect():
        assert r.text == enhanced(before[r.id]), before[r.id]


def test_structured(texts):
    for r in texts.select("text", scans.structured(F.col("text")).alias("out")).collect():
        assert r.out == structured(r.text), r.text


def test_column_clusters(spark):
    rows = [[0, 100, 200] * 4, [0, 100, 200] * 3, [0, 19, 38] * 4, list(range(0, 400, 10)), [], [5] * 12, [0, 110, 215, 3, 101, 220, 1, 99, 199, 7]]
    df = spark.createDataFrame([(r,) for r in rows], "lefts array<int>")
    assert [r.t for r in df.select(scans.has_columns(F.col("lefts")).alias("t")).collect()] == [clusters(r) for r in rows]


def test_quick_rows_find_the_same(spark):
    """Rows side by side, names behind a match, cells of white space only."""
    odd = ["a-b | 1,2 | mg/dl | 3 - 4-c | 5 | % | 6", "x|1|u| \n y|2|v|z", "éab | 1 | g/l | \u00a0", "Na | 1 | | 2 K | 3 | l | 4,1", "aa bb | . | / | -CRP|4|x|5-6", "|1|a|2", "-|1|%|-"]
    rows = spark.createDataFrame([(x,) for x in [*odd, " ".join(odd), "".join(odd)]], "text string")
    for r in rows.select("text", *[F.regexp_replace("text", e, "<$1;$2;$3;$4>").alias(n) for n, e in (("a", scans.CLEAN_ROW), ("b", scans.QUICK_ROW))]).collect():
        assert r.a == r.b
