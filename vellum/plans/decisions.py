"""Queries of decision tables and scores over whole tables, each with the SQL that checks it."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import decisions, sequence, tables
from vellum.functions import documents as docs
from vellum.plans import textual
from vellum.plans.textual import _fill, _q

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_WS = r"[ \t\n\f\r]"
_TABLE_ROW = r"\|[^\n]*\|[^\n]*\|"


def _table(name: str, table: str, run, sql: str | None) -> None:
    QUERIES[name] = lambda spark, d: run(spark.read.parquet(f"{d}/{table}.parquet"))
    if sql:
        ORACLE_SQL[name] = sql


def _has(terms: list[str], text: str) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(t)}) AS INT)" for t in terms) + ")"


def _n(pattern: str, text: str) -> str:
    return f"len(regexp_extract_all({text}, {_q(pattern)}))"


_table(
    "t18_narrative",
    "documents",
    lambda df: df.select("doc_id", F.coalesce(decisions.narrative(F.col("text")), F.lit(False)).alias("narrative")),
    rf"""SELECT doc_id, coalesce(length(trim(text)) >= 100 AND (len(list_filter(regexp_split_to_array(text, '[.!?]+{_WS}+'), lambda s: length(trim(s)) > 30)) >= 3 OR (length(text) - length(replace(text, chr(10) || chr(10), ''))) / 2 >= 2)
AND {_n('[0-9]+[.,][0-9]+', 'text')} < 5 AND length(text) - length(replace(text, '|', '')) < 3 AND length(text) - length(replace(text, chr(9), '')) < 5, false) AS narrative FROM documents""",
)
#: Facts of a document read off its text: how much of a page it fills, its quality score, whether it has table rows, whether it
#: has marks of pictures or layout, how dense it is.
_FACTS = {"coverage": "least(length(text) / 3000, 1)", "has_tables": "contains(text, '|')", "has_images": "contains(text, '***') OR contains(text, '###')", "density": "least(length(replace(text, ' ', '')) / 20000, 1)"}


def _facts(df):
    df = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return df.select("doc_id", docs.text_quality(F.col("text")).alias("quality"), *[F.expr(e).cast("double" if "/" in e else "boolean").alias(n) for n, e in _FACTS.items()])


_FACTS_SQL = "(SELECT doc_id, coalesce(quality, 0.0) AS quality, " + ", ".join(f"CAST({e.replace(') / ', ')::DOUBLE / ')} AS {'DOUBLE' if '/' in e else 'BOOLEAN'}) AS {n}" for n, e in _FACTS.items()) + " FROM (SELECT doc_id, coalesce(text, '') AS text, quality FROM documents JOIN (" + textual.ORACLE_SQL["t17_text_quality"] + ") USING (doc_id)))"
_table(
    "t20_pdf_strategy",
    "documents",
    lambda df: _facts(df).select("doc_id", decisions.pdf_strategy(F.col("coverage"), F.col("quality"), F.col("has_tables"), F.col("has_images")).alias("s")).select("doc_id", "s.*"),
    f"""SELECT doc_id, split_part(r, ',', 1) AS strategy, split_part(r, ',', 2) AS complexity, split_part(r, ',', 3) AS reason FROM (SELECT doc_id, CASE
WHEN has_tables THEN CASE WHEN coverage >= 0.8 AND quality >= 0.6 THEN 'vision_llm,moderate' ELSE 'vision_llm,complex' END || ',tables_detected_require_vision_llm'
WHEN coverage >= 0.9 AND quality >= 0.7 THEN 'local_text,simple,high_quality_embedded_text_no_tables' WHEN coverage >= 0.7 AND quality >= 0.6 THEN 'local_text,simple,good_embedded_text_no_tables'
WHEN quality >= 0.9 AND coverage >= 0.6 THEN 'local_text,moderate,very_high_quality_text_cost_optimization' WHEN quality >= 0.8 AND coverage >= 0.5 THEN 'local_text,moderate,high_quality_moderate_coverage_cost_optimization'
WHEN coverage >= 0.5 AND quality >= 0.4 THEN 'local_ocr,moderate,moderate_embedded_text' WHEN has_images THEN 'vision_llm,very_complex,complex_layout_detected' ELSE 'local_ocr,moderate,poor_or_no_embedded_text' END AS r FROM {_FACTS_SQL})""",
)
_table(
    "t21_image_strategy",
    "documents",
    lambda df: _facts(df).select("doc_id", decisions.image_strategy(F.col("quality"), F.col("density"), F.col("has_tables"), F.col("has_images")).alias("s")).select("doc_id", "s.*"),
    f"""SELECT doc_id, split_part(r, ',', 1) AS strategy, split_part(r, ',', 2) AS complexity, split_part(r, ',', 3) AS reason FROM (SELECT doc_id, CASE WHEN has_tables OR has_images THEN 'vision_llm,very_complex,complex_medical_layout'
WHEN quality >= 0.7 AND density >= 0.05 THEN 'local_ocr,simple,high_quality_with_text' WHEN quality >= 0.4 AND density >= 0.02 THEN 'vision_llm,moderate,moderate_quality' ELSE 'vision_llm,complex,poor_quality_or_low_text' END AS r FROM {_FACTS_SQL})""",
)
_KIND = "CASE WHEN has_images THEN 'image' WHEN coverage > 0.02 THEN 'pdf' ELSE 'unknown' END"
_table(
    "t23_quality_issues",
    "documents",
    lambda df: _facts(df).select("doc_id", F.array_join(decisions.quality_issues(F.expr(_KIND), F.col("quality"), F.col("density"), F.col("coverage"), F.col("quality")), ",").alias("issues")),
    f"""SELECT doc_id, concat_ws(',', CASE WHEN k = 'image' AND quality < 0.4 THEN 'poor_image_quality' END, CASE WHEN k = 'image' AND quality >= 0.4 AND quality < 0.7 THEN 'moderate_quality' END, CASE WHEN k = 'image' AND density < 0.02 THEN 'low_text_density' END,
CASE WHEN k = 'pdf' AND coverage < 0.3 THEN 'low_text_coverage' END, CASE WHEN k = 'pdf' AND quality < 0.4 THEN 'poor_text_quality' END) AS issues FROM (SELECT *, {_KIND} AS k FROM {_FACTS_SQL})""",
)



def _answers(df):
    return df.select("conv_id", "turn", "text", F.lead("text").over(Window.partitionBy("conv_id").orderBy("turn")).alias("answer"))


_ANSWERS = "(SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations)"
_BAD = "coalesce(answer, '') = '' OR starts_with(answer, 'Error')"
_RATIO = "CASE WHEN length(answer) / greatest(length(text), 1)::DOUBLE BETWEEN {a} AND {b} THEN 0.1::DOUBLE ELSE 0 END"
_table(
    "t28_translation_quality",
    "conversations",
    lambda df: _answers(df).select("conv_id", "turn", decisions.translation_quality(F.col("text"), F.col("answer")).alias("quality")),
    f"SELECT conv_id, turn, CASE WHEN {_BAD} THEN 0.0::DOUBLE ELSE round(least(0.6::DOUBLE + CASE WHEN length(answer) > 500 THEN 0.2::DOUBLE WHEN length(answer) > 100 THEN 0.1::DOUBLE ELSE 0 END + {_fill(_RATIO, a=0.5, b=2.0)} + least({_has(decisions.PLAIN, 'lower(answer)')} * 0.05::DOUBLE, 0.1::DOUBLE), 1), 6) END AS quality FROM {_ANSWERS}",
)
_table(
    "t29_language_quality",
    "conversations",
    lambda df: _answers(df).select("conv_id", "turn", decisions.language_quality(F.col("text"), F.col("answer")).alias("quality")),
    f"SELECT conv_id, turn, CASE WHEN {_BAD} THEN 0.0::DOUBLE ELSE round(least(0.6::DOUBLE + CASE WHEN length(answer) > 50 THEN 0.1::DOUBLE ELSE 0 END + {_fill(_RATIO, a=0.7, b=1.5)} + CASE WHEN {_n(decisions.EMOJI, 'text')} > 0 THEN least({_n(decisions.EMOJI, 'answer')} / {_n(decisions.EMOJI, 'text')}::DOUBLE, 1) * 0.1::DOUBLE ELSE 0 END, 1), 6) END AS quality FROM {_ANSWERS}",
)
_table(
    "t30_scan_confidence",
    "documents",
    lambda df: df.select("doc_id", decisions.scan_confidence(F.col("text")).alias("confidence")),
    rf"""SELECT doc_id, CASE WHEN length(trim(coalesce(text, ''))) < 10 THEN 0.0::DOUBLE ELSE round(least(0.7::DOUBLE + 0.05::DOUBLE * (CAST(length(text) > 100 AS INT) + CAST(length(text) > 500 AS INT) + CAST(length(text) > 1000 AS INT)) + least({_has(decisions.SCAN_TERMS, 'lower(text)')} * 0.01::DOUBLE, 0.1::DOUBLE)
+ CASE WHEN {_n(_TABLE_ROW, 'text')} >= 2 THEN least({_n(_TABLE_ROW, 'text')} * 0.01::DOUBLE, 0.1::DOUBLE) ELSE 0 END + CASE WHEN contains(text, '|') OR contains(text, '- ') OR contains(text, '## ') THEN 0.02::DOUBLE ELSE 0 END
+ least({_n(decisions.MEASURE, 'text')} * 0.008::DOUBLE, 0.08::DOUBLE) - least({_n(rf'\n{_WS}*\n{_WS}*\n', 'text')} * 0.02::DOUBLE, 0.05::DOUBLE), 0.95::DOUBLE), 6) END AS confidence FROM documents""",
)
_lab = "text"
for _p, _v in decisions.LAB_VALUES:
    _lab = f"regexp_replace({_lab}, {_q(_p)}, {_q(_v.replace('$', chr(92)))}, 'g')"
_LABS = "concat(coalesce(text, ''), ' Hb 13,5 Krea: 0.9 mg/dl (0.5 - 1.2) Leukos ', CAST(doc_id AS VARCHAR), ' TSH:2.5 glukose 95')"
_table("c3_lab_values", "documents", lambda df: df.select("doc_id", F.md5(decisions.lab_values(F.expr(_LABS.replace("VARCHAR", "STRING")))).alias("text_md5")), f"SELECT doc_id, md5({_lab}) AS text_md5 FROM (SELECT doc_id, {_LABS} AS text FROM documents)")
_table("t36_truncated", "documents", lambda df: df.select("doc_id", F.md5(decisions.truncated(F.col("text"), 1200, "...")).alias("text_md5")), "SELECT doc_id, md5(CASE WHEN length(text) > 1200 THEN left(text, 1200) || '...' ELSE text END) AS text_md5 FROM documents")

# the operators of inline cases, over whole tables
_BATCHES = "(SELECT doc_id // 8 AS doc, CAST(doc_id % 8 AS INT) AS page, text FROM documents)"


def _pages(df):
    return df.select(F.floor(F.col("doc_id") / 8).alias("doc"), (F.col("doc_id") % 8).cast("int").alias("page"), "text")


def _over(name: str, case: str, old: str, new: str, run, table: str = "documents", key: str | None = "id") -> None:
    sql = textual.CASE_SQL[case]
    sql = sql[sql.rindex(")\nSELECT") + 2 :] if ")\nSELECT" in sql else sql
    sql = sql.replace(f"FROM {old}", f"FROM {new}")
    if key:
        sql = re.sub(rf"\b{key}\b", "doc_id", sql)
    _table(name, table, run, sql)


_over("t33_merge_documents", "t33_merge_pages", "pages_of", _BATCHES, lambda df: docs.merge_pages(_pages(df), "doc"), key=None)
_over("t34_smart_merge_documents", "t34_smart_merge", "pages_of", _BATCHES, lambda df: docs.merge_pages(_pages(df), "doc", smart=True), key=None)
_SHEETS = "(SELECT doc_id // 8 AS batch_id, CAST(doc_id % 8 AS INT) AS idx, text FROM documents)"


def _sheets(df):
    return df.select(F.floor(F.col("doc_id") / 8).alias("batch_id"), (F.col("doc_id") % 8).cast("int").alias("idx"), "text")


_over("t49_document_confidence", "t49_page_confidence", "sheets", _SHEETS, lambda df: _sheets(df).select("batch_id", "idx", sequence.analysis_confidence(F.col("text")).alias("confidence")), key=None)
_over("g32_moved_documents", "g32_moved_pages", "sheets", _SHEETS, lambda df: sequence.moved_share(sequence.ordered(_sheets(df))), key=None)
_over("t32_formatted_documents", "t32_formatting", "bullets", "documents", lambda df: df.select("doc_id", docs.formatted(F.col("text")).alias("text")))
_DATES = "len(list_filter(list_transform(regexp_extract_all(text, '[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}'), lambda x: try_strptime(translate(x, '/', '.'), '%d.%m.%Y')), lambda x: x IS NOT NULL)) + len(list_filter(list_transform(regexp_extract_all(text, '[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}'), lambda x: try_strptime(x, '%Y-%m-%d')), lambda x: x IS NOT NULL))"
ORACLE_SQL["t49_document_confidence"] = f"SELECT batch_id, idx, round(least(0.5::DOUBLE + CASE WHEN coalesce({textual._NUM}, 0) <> 0 THEN 0.3::DOUBLE ELSE 0 END + CASE WHEN {_DATES} > 0 THEN 0.1::DOUBLE ELSE 0 END + CASE WHEN length(text) > 500 THEN 0.1::DOUBLE ELSE 0 END + (" + " + ".join(f"CAST({textual._HAS(n, 'lower(text)')} AS INT)" for n in sequence.SECTIONS) + f") * 0.05::DOUBLE, 1), 6) AS confidence FROM {_SHEETS}"
_CLEAN = r"""
SELECT {key}, coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (c <> '' AND NOT (length(c) < 3 OR regexp_matches(c, '^[^\p{L}\p{N}_\s]+$') OR regexp_matches(c, '^[_\-=]+$')
       OR (a > 0 AND length(regexp_replace(c, '[\p{L}\p{N}_\s]', '', 'g')) > 3 * a))), '') AS text
FROM (SELECT *, length(regexp_replace(c, '[^\p{L}\p{N}_]', '', 'g')) AS a FROM (
  SELECT {key}, i, trim(regexp_replace(CASE WHEN NOT contains(l, '|') THEN l WHEN len(p) = 2 THEN p[1] || ': ' || p[2]
         WHEN len(p) > 2 AND len(list_filter(p[2:], lambda x: regexp_matches(x, '[0-9]'))) > 0 AND length(p[1]) > 1 AND NOT regexp_matches(p[1], '^[0-9]+$') AND NOT regexp_matches(p[1], '^[.\-_=><]+$')
         THEN p[1] || ': ' || p[2] || ' ' || p[3] || CASE WHEN len(p) >= 4 THEN ' (Referenz: ' || p[4] || ')' ELSE '' END
         WHEN len(p) > 2 THEN array_to_string(p, '  ') ELSE l END, '\s+', ' ', 'g')) AS c
  FROM (SELECT *, list_filter(list_transform(string_split(l, '|'), lambda x: trim(x)), lambda x: x <> '') AS p
        FROM (SELECT {key}, i, regexp_replace(regexp_replace(l, '\|\s*\|+', '|', 'g'), '^\|\s*|\s*\|$', '', 'g') AS l
              FROM (SELECT {key}, unnest(string_split(text, chr(10))) AS l, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM {table})))))
GROUP BY {key}"""
_table("c6_clean_documents", "documents", lambda df: df.select("doc_id", tables.clean_text(F.coalesce("text", F.lit(""))).alias("text")), _CLEAN.replace("{key}", "doc_id").replace("{table}", "(SELECT doc_id, coalesce(text, '') AS text FROM documents)"))
textual.CASE_SQL["c6_clean_scans"] = textual.with_cases(_CLEAN.replace("{key}", "id").replace("{table}", "scans"), "scans")
