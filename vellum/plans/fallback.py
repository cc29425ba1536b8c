"""Queries of the model-free removal of personal data, over letters made of whole documents. SQL checks what needs no Unicode word
boundary; a test holds the rest against a plain reading of the same expressions."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import fallback, privacy
from vellum.functions import terms as T
from vellum.plans.privacy import _has
from vellum.plans.terms import WORDS_SQL
from vellum.plans.textual import _q
from vellum.sources.overlays import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: A letter's head and end around a document, by its id and the nation of that number.
_HEAD = r"""concat('Patient: ', initcap(n_name), ', Maria\nGeb.: ', 1 + doc_id % 28, '.', 1 + doc_id % 12, '.19', 50 + doc_id % 40, '\nTel: +49 30 ', 1000000 + doc_id, '\nVersichertennummer: A', 123456789 + doc_id, '\n',
    'Labor vom 12.03.2024: Hämoglobin 13,5 g/dl, CRP 4, Vitamin D3, ICD I50.1, Leber 15 cm, Metformin\n', coalesce(text, ''), '\nMit freundlichen Grüßen\nDr. med. ', initcap(n_name), '\n', case when doc_id % 2 = 0 then 'Frau Doktor Muster\n' else '' end)"""


def letters(spark, d):
    docs, nations = spread(spark.read.parquet(f"{d}/documents.parquet")), spark.read.parquet(f"{d}/nation.parquet")
    return docs.join(nations, F.pmod("doc_id", F.lit(25)) == F.col("n_nationkey"), "left").select("doc_id", F.expr(_HEAD).alias("text"))


_LETTERS = "letters AS (SELECT doc_id, " + _HEAD.replace(r"\n", "' || chr(10) || '").replace("initcap(n_name)", "concat(upper(left(n_name, 1)), lower(substr(n_name, 2)))") + " AS text FROM documents LEFT JOIN nation ON n_nationkey = doc_id % 25)"


def _letters(name: str, run, sql: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: run(letters(spark, d))
    if sql:
        ORACLE_SQL[name] = f"WITH {_LETTERS}\n{sql}"


_COLUMNS = ["types", "pattern_removals", "n_protected", "content_kept", "review", "quality", "reduction"]
_letters("pi20_fallback", lambda df: fallback.filtered(df).select("doc_id", F.md5("clean").alias("clean_md5"), *_COLUMNS))
_letters(
    "pi21_round_trip",
    lambda df: fallback.protected(df, "text").select("doc_id", F.md5(fallback.restored(F.col("masked"), F.col("ledger"))).alias("text_md5"), (F.size("ledger") > 0).alias("some")),
    "SELECT doc_id, md5(text) AS text_md5, true AS some FROM letters",
)
_letters("pi22_passes", lambda df: fallback.removed(df, "text").select("doc_id", F.md5("text").alias("text_md5"), "types", "pattern_removals"))

#: Letters with leftovers that a client still takes out.
_LEFT = "concat(text, 'anna.schmidt-fink\\n@[EMAIL_DOMAIN], O598926034, Status M, [PHONE] / -27', doc_id % 100, ' Fallnummer: 12345678 TK/Hamburg, Rhedung 18 b, 41460 Neuss Haptoglobin ([IP_ADDRESS] g/l)')"
_letters("pi15_post_passes", lambda df: privacy.post_processed(df.select("doc_id", F.expr(_LEFT).alias("text")), "text").select("doc_id", F.md5("text").alias("text_md5"), F.length("text").alias("n_chars")))

_KEPT = [*T.TERMS, *T.DRUGS, *T.EPONYMS]
#: Word islands as in the plan of terms, but runs stay within a line.
_LINES = WORDS_SQL.replace("regexp_full_match(gap, '\\s+')", "regexp_full_match(gap, '[\\t\\x0B\\f\\r ]+')")
QUERIES["pi23_name_runs"] = lambda spark, d: (
    spark.read.parquet(f"{d}/documents.parquet")
    .select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    .select("doc_id", F.size(F.regexp_extract_all("text", F.lit(fallback.RUN), F.lit(0))).cast("long").alias("n_runs"), F.md5(fallback.without_runs(F.col("text"), _KEPT)).alias("text_md5"))
)
ORACLE_SQL["pi23_name_runs"] = f"""WITH {_LINES},
kept AS (SELECT * FROM (VALUES {', '.join(f'({_q(w)})' for w in _KEPT)}) v(w)),
gone AS (SELECT d, island, part, start, size FROM runs WHERE n > 1 AND NOT list_has_any(string_split(lower(phrase), ' '), (SELECT list(w) FROM kept))),
cut AS (SELECT d, string_agg(substr(text, CAST(s + 1 AS BIGINT), CAST(e - s AS BIGINT)), '' ORDER BY s) AS text FROM (
    SELECT d, text, s, least(lead(b, 1, length(text)) OVER (PARTITION BY d ORDER BY s), length(text)) AS e FROM (
        SELECT n.d, text, 0 AS s, 0 AS b FROM numbered n UNION ALL SELECT n.d, text, start + size, start FROM gone JOIN numbered n USING (d))) GROUP BY d)
SELECT doc_id, coalesce(k, 0) AS n_runs, md5(coalesce(cut.text, '')) AS text_md5
FROM numbered LEFT JOIN cut USING (d) LEFT JOIN (SELECT d, count(*) AS k FROM runs WHERE n > 1 GROUP BY d) USING (d)"""

#: Dates, and the same without a look around for both engines.
DATE = r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}"


def _dated(df):
    gaps, found = F.split("text", DATE, -1), F.regexp_extract_all("text", F.lit(DATE), F.lit(0))
    # the 50 characters before a date: the end of the gap, and of what stands before it
    upto = F.transform(found, lambda m, i: F.concat(F.when(i > 0, F.concat(F.get(gaps, i - 1), F.get(found, i - 1))).otherwise(F.lit("")), F.get(gaps, i)))
    rows = df.withColumn("before", F.transform(upto, lambda b: F.right(b, F.lit(50)))).select("doc_id", F.transform("before", fallback.date_context).alias("contexts"))
    count = lambda kind: F.size(F.filter("contexts", lambda c: c == kind)).cast("long").alias(f"n_{kind}")
    return rows.select("doc_id", count("pii"), count("medical"))


def _any(words, text):
    return "(" + " OR ".join(f"contains({text}, {_q(w)})" for w in words) + ")"


_letters(
    "pi24_date_context",
    _dated,
    f"""SELECT doc_id, count(*) FILTER (kind = 'pii') AS n_pii, count(*) FILTER (kind = 'medical') AS n_medical FROM (
SELECT doc_id, d, CASE WHEN {_any(fallback.BIRTH, 'b')} THEN 'pii' WHEN {_any(fallback.TREATMENT, 'b')} THEN 'medical' ELSE 'pii' END AS kind FROM (
SELECT doc_id, d, lower(substr(text, CAST(greatest(start - 50, 0) + 1 AS BIGINT), CAST(least(start, 50) AS BIGINT))) AS b FROM (
SELECT doc_id, d, text, sum(length(gap) + length(date)) OVER (PARTITION BY d ORDER BY i) - length(date) AS start FROM (
SELECT doc_id, d, text, unnest(ms) AS date, unnest(gs[: len(ms)]) AS gap, unnest(range(len(ms))) AS i FROM (
SELECT doc_id, row_number() OVER () AS d, text, regexp_extract_all(text, '{DATE}') AS ms, regexp_split_to_array(text, '{DATE}') AS gs FROM letters))))) GROUP BY doc_id, d""",
)
QUERIES["pi26_content_check"] = lambda spark, d: spark.read.parquet(f"{d}/documents.parquet").select("doc_id", fallback.has_content(F.coalesce("text", F.lit(""))).alias("content_kept"))
ORACLE_SQL["pi26_content_check"] = f"SELECT doc_id, length(t) <= 200 OR {_any(fallback.INDICATORS, 'lower(t)')} AS content_kept FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)"
#: Counts by confidence from a document's labels and length.
QUERIES["pi27_quality"] = lambda spark, d: (
    spark.read.parquet(f"{d}/labels.parquet").join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "n_chars"), "doc_id")
    .select("doc_id", fallback.quality(F.col("n_chars") % 7, F.col("quality").cast("long"), F.col("n_chars") % 3, F.col("toxic") + F.col("n_chars") % 2).alias("score"))
)
ORACLE_SQL["pi27_quality"] = "SELECT doc_id, CASE WHEN p + h + m + l = 0 THEN 100.0::DOUBLE ELSE round_even((p * 100 + h * 100 + m * 80 + l * 50)::DOUBLE / (p + h + m + l), 1) END AS score FROM (SELECT doc_id, n_chars % 7 AS p, quality AS h, n_chars % 3 AS m, toxic + n_chars % 2 AS l FROM labels JOIN documents USING (doc_id))"

#: A removal that takes contact data and, from every third letter, the line of laboratory values.
_GONE = "regexp_replace({0}, CASE WHEN doc_id % 3 = 0 THEN '[+]49[0-9 ]+|Labor vom[^\n]*' ELSE '[+]49[0-9 ]+' END, '[X]'{1})"
_letters(
    "pi28_preserved",
    lambda df: df.select("doc_id", privacy.preserved(F.col("text"), F.expr(_GONE.format("text", "").replace("\n", "\\n"))).alias("kept")),
    f"SELECT doc_id, CASE WHEN a > 0 THEN b / a::DOUBLE >= 0.8 ELSE true END AS kept FROM (SELECT doc_id, {_has(privacy.KEYWORDS, 'lower(text)')} AS a, {_has(privacy.KEYWORDS, 'lower(c)')} AS b FROM (SELECT doc_id, text, {_GONE.format('text', ", 'g'").replace(chr(10), chr(92) + 'n')} AS c FROM letters))",
)
