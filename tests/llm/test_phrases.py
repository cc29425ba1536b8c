"""Phrase mining against brute force with small thresholds, and the query against its SQL."""

import re
from collections import Counter

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from vellum.llm import common, phrases

LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows, least, longest=4, cover=80, top=2000):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                for i in range(len(words) - k + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        candidates = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inside = lambda p, q: any(q[i : i + len(p)] == p for i in range(len(q) - len(p) + 1))
        kept = []
        for p, a in candidates.items():
            if not any(len(q) > len(p) and 100 * b >= cover * a and inside(p, q) for q, b in candidates.items()):
                score, k = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(kept)[:top])]
    return sorted(out)


def mined(df, **kw):
    return sorted(tuple(r) for r in phrases.mine(df, **kw).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.fixture(scope="module")
def docs(spark, sf):
    return common.table(spark, sf, "documents").select("text", "lang").withColumns({"word": F.lit(1), "words": F.lit("x"), "n": F.lit(0), "a": F.lit(0)})


@pytest.mark.parametrize("least, top", [(12, 2000), (30, 7), (300, 2000)])
def test_table(docs, least, top):
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert mined(docs, least=least, top=top) == brute(rows, least, top=top)


def test_made_up(spark):
    rows = [
        ("The Big cat. the big cat, the big\tcat the big cat", "en"), ("a a a a a a a", None), ("a a a b", "und"), (None, "en"), ("", None), (" \t ", "fr"), ("un deux\x0bun deux\x0cun deux\run deux\nun deux", "fr"),
        ("É é É é É é", "fr"), ("É é É é É é", "fr"), ("x" * 70000 + " y " + "x" * 70000 + " y", "long"), ("no-break no-break", "en"), ("p q r s " * 20_000, "big"),
    ]
    df = spark.createDataFrame(rows, "text string, lang string")
    for least in (1, 2, 3):
        assert mined(df, least=least) == brute(rows, least)
    assert mined(df, least=2, longest=2) == brute(rows, 2, longest=2)
    assert phrases.mine(spark.createDataFrame([], "text string, lang string")).count() == 0


def test_full_filters(docs):
    """Bitmaps so small that they prune nothing change no result."""
    rows = [(r.text, r.lang) for r in docs.limit(60).collect()]
    few = docs.sparkSession.createDataFrame(rows, "text string, lang string")
    assert mined(few, least=5, bits=6) == mined(few, least=5, bits=12) == brute(rows, 5)


def test_small_rows(docs):
    """Many postings rows of little text each, held back per language."""
    rows = [(r.text, r.lang) for r in docs.collect()]
    assert mined(docs, least=20, row_bytes=3000) == brute(rows, 20)


def test_large_counts(spark):
    """Products beyond 64 bits stay exact."""
    a = 9_000_000_000_000_000
    one = spark.createDataFrame([("x", [1], a + 2), ("x", [2], a + 5)], "lang string, words array<long>, a long")
    two = spark.createDataFrame([("x", [1, 2], a)], "lang string, words array<long>, a long")
    assert phrases.scored([one, two]).first().score == 2_000_000 * a // (2 * a + 7)


def test_query_against_sql(spark):
    sf = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    got = phrases.op12_phrases(spark, sf)
    want = con.execute(phrases.SQL)
    names = [c[0] for c in want.description]
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(want.fetchall())


def test_counts_leave_a_task_in_bounded_batches(monkeypatch):
    """Keys are summed over the rows of a task, with the first row that has them, and given back a few at a time."""
    texts = [b"a b c d", b"c d e f g", b"a h i"]
    batch = pa.Table.from_batches([phrases._row(k, "de", [t]) for k, t in enumerate(texts)]).combine_chunks().to_batches()[0]
    monkeypatch.setattr(phrases, "OUT_ROWS", 4)
    parts = list(phrases._keys([])(iter([batch])))
    assert [p.num_rows for p in parts] == [4, 4, 1]
    got = {r["key"]: (r["row"], r["n"]) for p in parts for r in p.to_pylist()}
    key = lambda w: int(phrases._bits("de", [phrases.inverted([w])[0]], 64).view("int64")[0])
    assert {w: got[key(w)] for w in (b"a", b"c", b"e", b"i")} == {b"a": (0, 2), b"c": (0, 2), b"e": (1, 1), b"i": (2, 1)} and len(got) == 9


def test_ranges_of_keys(monkeypatch):
    """Keys sorted by ranges, one after another, have the sums and first rows of all sorted at once."""
    texts = [b"a b c d e f g h i j k l", b"c d x y z", b"a y q r s t"]
    batch = pa.Table.from_batches([phrases._row(k, "de", [t]) for k, t in enumerate(texts)]).combine_chunks().to_batches()[0]
    found = lambda: [r for p in phrases._keys([])(iter([batch])) for r in p.to_pylist()]
    whole = found()
    sizes, sort = [], phrases.np.argsort
    monkeypatch.setattr(phrases, "SORTED_KEYS", 3)
    monkeypatch.setattr(phrases.np, "argsort", lambda keys, **kw: sizes.append(len(keys)) or sort(keys, **kw))
    parts = found()
    assert sorted(r["key"] for r in parts) == sorted(r["key"] for r in whole) and {tuple(r.values()) for r in parts} == {tuple(r.values()) for r in whole}
    assert sum(sizes) == 23 and max(sizes) < 12


def test_few_large_rows_at_a_time(docs, monkeypatch):
    """Neither a row group nor a batch for Python holds much more than its bytes, however few its rows."""
    monkeypatch.setattr(phrases, "GROUP_BYTES", 1 << 17)
    monkeypatch.setattr(common, "BATCH_BYTES", 1 << 17)
    lists = phrases.postings(docs.coalesce(1), row_bytes=20_000)
    (path,) = lists.inputFiles()
    meta = pq.ParquetFile(path.removeprefix("file://")).metadata
    sizes = [meta.row_group(i).total_byte_size for i in range(meta.num_row_groups)]
    assert 10 < meta.num_rows < 100 and len(sizes) > 2 and max(sizes) < 1 << 18

    def bytes_of(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], ["rows", "bytes"])

    seen = lists.mapInArrow(bytes_of, "rows long, bytes long").collect()
    monkeypatch.undo()
    common.bound_batches(docs.sparkSession)
    assert sum(b.rows for b in seen) == meta.num_rows and max(b.bytes for b in seen) < 1 << 18
