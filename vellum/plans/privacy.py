"""Queries that remove or guard personal data, over whole tables. SQL checks those without look-around; a test holds the
passes against a plain reading of the same expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import privacy
from vellum.plans.textual import _q
from vellum.sources.overlays import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
META = ["removals", "dates_kept", "kinds", "letterhead_removed", "fixes", "suspicious", "error"]


def _documents(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: run(spread(spark.read.parquet(f"{d}/documents.parquet")))
    if sql:
        ORACLE_SQL[name] = sql


def _has(terms: list[str], text: str) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(t)}) AS INT)" for t in terms) + ")"


def _any(terms: list[str], text: str, before: str = "") -> str:
    return "(" + " OR ".join(f"starts_with({text}, {_q(before + t)})" for t in terms) + ")"


_documents("pi1_remove_german", lambda df: privacy.removed(df, "de").select("doc_id", F.md5("redacted").alias("redacted_md5"), *META))
_documents("pi1_remove_english", lambda df: privacy.removed(df, "en").select("doc_id", F.md5("redacted").alias("redacted_md5"), *META))
#: A head that some texts get, so that the rule has something to find.
_HEAD = "concat(case when doc_id % 3 = 0 then 'Klinikum Nord\nAbteilung eins\n-----\n' when doc_id % 3 = 1 then 'St. Anna Hospital\n\n\n' else '' end, coalesce(text, ''))"
_H = " OR ".join(f"regexp_matches(lower(left(text, 800)), {_q(h)})" for h in privacy.HOSPITALS)
_E = [f"(length(split_part(left(text, 1000), regexp_extract(left(text, 1000), {_q('(?i)' + e)}), 1)))" for e in privacy.LETTERHEAD_ENDS]
_M = [f"regexp_matches(left(text, 1000), {_q('(?i)' + e)})" for e in privacy.LETTERHEAD_ENDS]
_documents(
    "pi3_letterhead",
    lambda df: privacy.without_letterhead(df.select("doc_id", F.expr(_HEAD.replace("\n", "\\n")).alias("text")), "text").select("doc_id", "letterhead_removed", F.md5("text").alias("text_md5")),
    f"""SELECT doc_id, n AS letterhead_removed, md5(CASE WHEN n > 0 THEN '[HOSPITAL_LETTERHEAD]' || chr(10) || regexp_replace(substr(text, e + 1), '^\\s+', '') ELSE text END) AS text_md5 FROM (
SELECT doc_id, text, e, CAST(CASE WHEN e > 0 THEN {' + '.join(f"CAST(regexp_matches(lower(left(text, e)), {_q(h)}) AS INT)" for h in privacy.HOSPITALS)} ELSE 0 END AS INT) AS n FROM (
SELECT doc_id, text, CASE WHEN length(text) >= 100 AND ({_H}) THEN CASE WHEN {_M[0]} THEN {_E[0]} WHEN {_M[1]} THEN {_E[1]} WHEN {_M[2]} THEN {_E[2]} ELSE 0 END ELSE 0 END AS e FROM (
SELECT doc_id, concat(CASE WHEN doc_id % 3 = 0 THEN 'Klinikum Nord' || chr(10) || 'Abteilung eins' || chr(10) || '-----' || chr(10) WHEN doc_id % 3 = 1 THEN 'St. Anna Hospital' || repeat(chr(10), 3) ELSE '' END, coalesce(text, '')) AS text FROM documents)))""",
)
_NUMBER, _DOTTED = "[0-9]+", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"


def _placed(expression: str, reach: int) -> str:
    """Every match of an expression in a document with what stands before and behind it, by its offset."""
    return f"""SELECT doc_id, d, m, substr(text, CAST(greatest(s - {reach}, 0) + 1 AS BIGINT), CAST(least(s, {reach}) AS BIGINT)) AS b, substr(text, CAST(s + length(m) + 1 AS BIGINT), {reach}) AS a
FROM (SELECT doc_id, d, text, m, sum(length(g) + length(m)) OVER (PARTITION BY d ORDER BY i) - length(m) AS s
FROM (SELECT doc_id, d, text, unnest(ms) AS m, unnest(gs[: len(ms)]) AS g, unnest(range(len(ms))) AS i
FROM (SELECT doc_id, row_number() OVER () AS d, text, regexp_extract_all(text, {_q(expression)}) AS ms, regexp_split_to_array(text, {_q(expression)}) AS gs FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents))))"""


def _measures(df):
    found = privacy.with_contexts(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", _NUMBER, 15, 2)
    return found.select("doc_id", F.size("found").cast("long").alias("n_numbers"), F.size(F.filter("found", lambda x: privacy.is_measure(x.after))).cast("long").alias("n_measures"))


_documents("pi11_measures", _measures, f"""WITH placed AS ({_placed(_NUMBER, 15)})
SELECT doc_id, coalesce(n, 0) AS n_numbers, coalesce(k, 0) AS n_measures FROM (SELECT row_number() OVER () AS d, doc_id FROM documents)
LEFT JOIN (SELECT d, count(*) AS n, count(*) FILTER ({_any(privacy.UNITS, 'l')} OR {_any(privacy.UNITS, 'l', '-')}) AS k FROM (SELECT d, lower(trim(a)) AS l FROM placed) GROUP BY d) USING (d)""")


def _ranges(df):
    found = privacy.with_contexts(df.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", _DOTTED, 30, 7)
    rows = found.select("doc_id", F.explode("found").alias("x")).select("doc_id", "x.*")
    return rows.select("doc_id", "match", privacy.is_lab_range(F.col("before"), F.col("after")).alias("is_range")).groupBy("doc_id", "match", "is_range").agg(F.count("*").alias("n"))


_documents("pi12_lab_ranges", _ranges, f"""WITH placed AS ({_placed(_DOTTED, 30)})
SELECT doc_id, m AS match, (contains(b, '(') AND {_any(privacy.RANGE_UNITS, 'lower(trim(a))')}) OR {_has(privacy.LAB_WORDS, 'lower(b)')} > 0 AS is_range, count(*) AS n FROM placed GROUP BY ALL""")
_documents("pi25_old_dates", lambda df: df.select("doc_id", F.md5(privacy.without_old_dates(F.col("text"))).alias("text_md5"), F.regexp_count("text", F.lit(privacy.OLD_DATE)).alias("n")), f"SELECT doc_id, md5(regexp_replace(text, {_q(privacy.OLD_DATE)}, '[DATUM ENTFERNT]', 'g')) AS text_md5, CAST(len(regexp_extract_all(text, {_q(privacy.OLD_DATE)})) AS INT) AS n FROM documents")
_KINDS = [(k, privacy.placeholder(k)) for k, _, _ in privacy.GERMAN]


def _placeholders(spark, d):
    """The kinds found in letters made of the documents, with their placeholders and in how many letters."""
    from vellum.plans.fallback import letters

    found = privacy.removed(letters(spark, d), "de").select(F.explode(F.split("kinds", ",")).alias("kind")).where("kind <> ''").groupBy("kind").agg(F.count("*").alias("n"))
    return found.join(F.broadcast(spark.createDataFrame(_KINDS, "kind string, placeholder string").distinct()), "kind")


QUERIES["pi7_placeholders"] = _placeholders
