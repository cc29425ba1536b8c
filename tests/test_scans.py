"""Clean-up of recognised text and tables from boxes, against plain readings, on letters, made-up lines and edges."""

import re

import pytest
from pyspark.sql import functions as F

from vellum.functions import scans
from vellum.operators import layout
from vellum.plans import scans as plans

TEXTS = [
    "0perati0n ge1ungen, 1nfekt Ge1b, wa1d, I2 1O2 3o4", "Hamoglobin 12 g/d1, thrombocyten 3 mg/d1 5mmol/1 7 µg/m1 9U/1", "5mg 6  ml 7 % 8mmol 1.234 1,500 12.5 3,4 - 5,6 7 - 8", "koennen muessen Strasse aerob Baustelle pii", "a  b\n\n\n\nc", "", None,
    "HERZ Herz herz hERZ Herzen herz-lunge _herz_ schilddrüse ANÄMIE", "Natrium  140  mmol/l  135-145\nKalium 4,1\n\nText\nGlucose\t95\tmg/dl\t70-110\t*\nSatz ohne Wert\n  Leukozyten: 8500  ", "%\n1 g", "Zeile\r\nHämatokrit   0,41\r\n", "é 1 g\nx",
]


def corrected(text):
    for pattern, instead in scans.CORRECTIONS:
        text = re.sub(pattern, instead.replace("$", "\\"), text, flags=re.I)
    for pattern, instead in scans.SPACING:
        text = re.sub(pattern, instead.replace("$", "\\"), text)
    return text


def respelled(text):
    def case(m):
        found = {t.lower(): t for t in scans.SPELLINGS}.get(m[0].lower())
        return m[0] if found is None else found.upper() if m[0].isupper() else found if m[0][0].isupper() else found.lower()

    return re.sub(r"\w+", case, text)


def lab_tables(text):
    out, inside = [], False
    for line in text.split("\n"):
        line = line.strip(scans.SPACE)
        if not line:
            continue
        low = line.lower()
        if any(x in low for x in scans.PARAMETERS + scans.UNITS) and re.search("[0-9]", line):
            out += [] if inside else scans.TABLE_HEAD
            parts = [p.strip() for p in re.split(r"\s{2,}|\t+", line) if p.strip()]
            out += [f"| {' | '.join((parts + [''] * 4)[:4])} |"] if len(parts) > 1 else []
        else:
            out += ["", line] if inside else [line]
        inside = bool(any(x in low for x in scans.PARAMETERS + scans.UNITS) and re.search("[0-9]", line))
    return "\n".join(out)


def united(passes):
    lines = sorted({x for p in passes for x in (y.strip(scans.SPACE) for y in (p or "").split("\n")) if len(x) > 2})
    out, i = [], 0
    while i < len(lines):
        if any(n.lower() in lines[i].lower() for n in scans.NAMES) and i + 1 < len(lines) and re.search("[0-9]", lines[i + 1]):
            out.append(f"{lines[i]}: {lines[i + 1]}")
            i += 1
        else:
            out.append(lines[i])
        i += 1
    return "\n".join(out)


@pytest.fixture(scope="module")
def texts(spark, sf):
    rows = TEXTS + [r.text for r in plans.letters(spark, sf).limit(150).collect()]
    return spark.createDataFrame(list(enumerate(rows)), "id long, text string")


def test_corrections_and_spellings(texts):
    rows = texts.select("text", scans.corrected(F.col("text")).alias("corrected"), scans.respelled(F.col("text")).alias("respelled")).collect()
    for r in rows:
        assert (r.corrected, r.respelled) == ((None, None) if r.text is None else (corrected(r.text), respelled(r.text)))
    assert rows[7].respelled == "HERZ Herz herz herz Herzen herz-lunge _herz_ schilddrüse ANÄMIE"
    # what lies between words is kept, and a second run changes nothing
    assert texts.where(scans.respelled(scans.respelled(F.col("text"))) != scans.respelled(F.col("text"))).count() == 0


def test_lab_tables(texts):
    for r in texts.select("text", scans.lab_tables(scans.stripped_lines(F.coalesce("text", F.lit("")))).alias("out")).collect():
        assert r.out == lab_tables(r.text or ""), r.text


def test_headers(spark):
    cases = [(["Parameter", "Ergebnis", "Einheit"], True), (["a", "Wert"], True), (["a", "b", "Wert"], False), ([], False), (["Natrium", "140"], False), (["TESTWERT"], True)]
    df = spark.createDataFrame(cases, "cells array<string>, want boolean")
    assert df.where(scans.is_header(F.col("cells")) != F.col("want")).count() == 0


def test_united_lines(spark, texts):
    rows = [("Natrium\n140 mmol\nab\nKalium", "Kalium 4\n Natrium \nCK 5\nCK\nCRP\nEisen", None), ("", None, ""), ("CRP\nCRP 1\nCRP 2\nCRP 3", "x", "GOT\nzzz"), ("Natrium", None, None)]
    rows += [(r.text, (r.text or "").replace(", ", "\n"), (r.text or "")[:80].upper()) for r in texts.collect()]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for r in df.select("*", scans.united([F.col("a"), F.col("b"), F.col("c")]).alias("out")).collect():
        assert r.out == united([r.a, r.b, r.c])


def rows_of(boxes, way):
    """Boxes grouped one after another."""
    boxes = sorted(boxes, key=lambda b: {"lines": (b["top"], b["left"], b["idx"]), "rows": (b["top"], b["idx"]), "centres": (b["idx"],)}[way])
    limit = {"lines": 20, "rows": boxes[0]["height"] * 0.5, "centres": sum(b["height"] for b in boxes) / len(boxes) * 0.5}[way]
    rows = []
    for b in boxes:
        at = b["top"] + b["height"] / 2 if way == "centres" else b["top"]
        if rows:
            row = rows[-1]
            held = sum(x["top"] + x["height"] / 2 for x in row) / len(row) if way == "centres" else row[0]["top"]
        if rows and abs(at - held) <= limit:
            rows[-1].append(b)
        else:
            rows.append([b])
    return rows


def markdown(boxes):
    boxes = [b for b in boxes if b["conf"] >= 20 and b["word"].strip()]
    if not boxes:
        return None
    rows = [sorted(r, key=lambda b: (b["left"], b["top"], b["idx"])) for r in rows_of(boxes, "rows")]
    starts = []
    for x in sorted(b["left"] for b in boxes):
        if not starts or x - starts[-1] > 30:
            starts.append(x)
    table = [[" ".join(b["word"] for b in row if sum(s <= b["left"] for s in starts) == c) for c in range(1, len(starts) + 1)] for row in rows]
    table = [row for row in table if sum(x != "" for x in row) > 1]
    if len(rows) < 2 or len(starts) < 2 or not table:
        return None
    head = 2 * sum(any(h in c.lower() for h in scans.HEADS) for c in table[0]) >= len(table[0])
    names = table[0] if head else []
    for i in range(0 if head else len(starts)):
        cells = [row[i] for row in table[:3]]
        names.append(
            "Parameter" if i == 0 else "Value" if any(re.search("[0-9]", c) for c in cells) else "Unit" if any(u in c.lower() for c in cells for u in scans.UNITS)
            else "Reference Range" if any("-" in c or "bis" in c.lower() or "to" in c.lower() for c in cells) else f"Column {i + 1}"
        )
    line = lambda row: "| " + " | ".join(row) + " |"
    return "\n".join(["\n### Laboratory Results\n", line(names), line(["---"] * len(names)), *map(line, table[head:])])


@pytest.fixture(scope="module")
def boxes(spark, sf):
    real = [r.asDict() for r in plans.boxes(spark, sf).where("doc_id < 40").collect()]
    words = [[("Parameter", 0, 0), ("Ergebnis", 100, 2), ("Natrium", 1, 30), ("140", 101, 33), ("mmol/l", 160, 31)], [("Natrium", 0, 0), ("to x", 90, 1), ("g", 200, 0), ("K", 0, 40), ("bis", 90, 41)], [("one", 0, 0)], [("a", 0, 0), ("b", 0, 50), ("c", 5, 100)], [(" ", 0, 0)], [("a", 0, 0), ("b", 99, 9), ("c", 0, 18), ("d", 99, 27)]]
    made = [{"doc_id": 10**6, "page": p, "idx": i, "word": w, "left": x, "top": y, "height": 16, "conf": 90} for p, page in enumerate(words) for i, (w, x, y) in enumerate(page)]
    made += [{"doc_id": 10**6, "page": 9, "idx": i, "word": f"w{i}", "left": 40 * i, "top": 5 * i, "height": 10, "conf": 19 + i % 2} for i in range(12)]
    schema = "doc_id long, page int, idx int, word string, left int, top int, height int, conf int"
    return spark.createDataFrame([tuple(b[f.split()[0]] for f in schema.split(", ")) for b in real + made], schema), real + made


@pytest.mark.parametrize("way", ["lines", "rows", "centres"])
def test_row_groups(boxes, way):
    df, plain = boxes
    for r in layout.grouped(df, ["doc_id", "page"], way).collect():
        mine = rows_of([b for b in plain if (b["doc_id"], b["page"]) == (r.doc_id, r.page)], way)
        assert [b.row for b in r.boxes] == [i + 1 for i, row in enumerate(mine) for _ in row]


def test_markdown_tables(boxes):
    df, plain = boxes
    got = {(r.doc_id, r.page): r.markdown for r in layout.markdown_tables(df, ["doc_id", "page"]).collect()}
    keys = {(b["doc_id"], b["page"]) for b in plain}
    want = {k: markdown([b for b in plain if (b["doc_id"], b["page"]) == k]) for k in keys}
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}
    assert "| Parameter | Ergebnis |" in got[(10**6, 0)] and got[(10**6, 2)] is None


def test_pages_travel_as_arrays(spark, tmp_path):
    """Pages made of a document's words equal pages made of boxes; no word is a row."""
    rows = [(1, " ".join("x" * (1 + i * i % 13) for i in range(601))), (2, None), (3, " \n"), (4, "ä_1 b-c"), (5, " ".join(["wort"] * 240)), (6, "ein " * 241)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    boxes = plans.boxes(spark, str(tmp_path))
    for way, name in (("lines", "c10_semantic_lines"), ("centres", "c11_row_centres")):
        plain = layout.grouped(boxes, ["doc_id", "page"], way).select("doc_id", "page", F.transform("boxes", lambda b: b.row).alias("rows"))
        want = plain.select("doc_id", "page", F.array_max("rows").cast("long").alias("n_rows"), F.md5(F.array_join("rows", ",")).alias("rows_md5"))
        found = plans.QUERIES[name](spark, str(tmp_path))
        assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect())) and found.count() == 7
        assert "posexplode(regexp_extract_all" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert {(r.doc_id, r.page) for r in plans.QUERIES["c12_markdown"](spark, str(tmp_path)).collect()} == {(r.doc_id, r.page) for r in boxes.where("conf >= 20").collect()}


def test_column_clusters_over_many_pages(spark):
    """More clusters than there is room for at first, empty pages, pages of unlike length."""
    pages = [[i * 50 % 1450 for i in range(n)] for n in (0, 9, 87, 200, 1)] + [[5, 5, 5, 100, 100, 100, 300, 300, 300, 319]]
    df = spark.createDataFrame([(p,) for p in pages], "x array<int>")
    got = [r.t for r in df.select(scans.has_columns(F.col("x")).alias("t")).collect()]
    assert got == [False, False, True, True, False, True]


def test_tables_are_made_once(spark, tmp_path):
    """The rows of a page's table are read from one evaluation; empty cells, single cells and several pages keep their places."""
    boxes = [(1, 0, "a", 0, 0), (1, 1, "b", 100, 0), (1, 2, "c", 300, 0), (1, 3, "alone", 0, 100), (1, 4, "d", 0, 200), (1, 5, "e", 10, 200), (1, 6, "f", 300, 200), (2, 0, "x", 0, 0), (3, 0, " ", 0, 0)]
    df = spark.createDataFrame([(*b, 10, 90) for b in boxes], "doc_id int, idx int, word string, left int, top int, height int, conf int")
    found = layout.markdown_tables(df, ["doc_id"])
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert sum("ArrowEvalPython" in line for line in plan.splitlines()) == 1
    got = {r.doc_id: (r.n_rows, r.n_columns, r.markdown) for r in found.collect()}
    assert set(got) == {1, 2} and got[2] == (1, 1, None)
    assert got[1][:2] == (3, 3) and [x for x in got[1][2].split("\n") if x.startswith("|")][2:] == ["| a | b | c |", "| d e |  | f |"]
