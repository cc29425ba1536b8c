"""Queries of the pieces that larger ones are made of, each by itself over whole tables, with SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.functions import answers, documents, fallback, guard, redaction, sequence, tables
from vellum.functions import privacy as removal
from vellum.functions import terms as T
from vellum.operators import costs, filters, programs, records
from vellum.plans import decisions, flows, relational, textual
from vellum.plans import terms as term_plans
from vellum.plans.fallback import _LETTERS, letters
from vellum.plans.textual import _q
from vellum.sources.overlays import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _add(name: str, run, sql: str) -> None:
    QUERIES[name] = run
    ORACLE_SQL[name] = sql


def _documents(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: run(_read(spark, d, "documents")), sql)


def _letters(name: str, run, sql: str) -> None:
    _add(name, lambda spark, d: run(letters(spark, d)), f"WITH {_LETTERS}\n{sql}")


def _views(name: str, views: tuple[str, ...], run, sql: str) -> None:
    _add(name, lambda spark, d: run(*[view(spark, d, v) for v in views]), with_views(sql, *views))


def _derived(name: str, case: str, run, sql: str) -> None:
    _add(name, lambda spark, d: run(textual._derived(spark, d, case)), f"WITH {case} AS ({textual.DERIVED[case][1]})\n{sql}")


# sources and sinks
_derived("s6_file_types", "uploads", lambda df: df.groupBy(documents.file_type(F.col("name")).alias("kind")).agg(F.count("*").alias("n")), "SELECT CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(name), '\\.(jpg|jpeg|png)$') THEN 'image' ELSE 'unknown' END AS kind, count(*) AS n FROM uploads GROUP BY 1")
_derived("s11_pdf_keys", "uploads", lambda df: df.where(F.lower("name").endswith(".pdf")).select("id", "name"), "SELECT id, name FROM uploads WHERE lower(name) LIKE '%.pdf'")
_LINE = "concat('method=', action, ' path=/', coalesce(resource_type, '-'), '/', resource_id, ' status=', cast(200 + id % 5 as string), ' duration=', cast(id % 1000 as string))"
_views(
    "s16_log_lines",
    ("audit",),
    lambda df: df.select("id", F.expr(_LINE).alias("line")).select("id", "line", F.str_to_map("line", F.lit(" "), F.lit("=")).alias("m")).select("id", F.md5("line").alias("line"), F.col("m")["method"].alias("method"), F.col("m")["path"].alias("path"), F.col("m")["status"].cast("int").alias("status"), F.col("m")["duration"].cast("int").alias("duration")),
    f"SELECT id, md5({_LINE}) AS line, action AS method, concat('/', coalesce(resource_type, '-'), '/', resource_id) AS path, CAST(200 + id % 5 AS INT) AS status, CAST(id % 1000 AS INT) AS duration FROM audit",
)
# selections, defaults, joins
_views("f12_steps_of_language", ("step_defs",), lambda df: df.withColumn("lang", F.when(F.col("id") % 3 == 1, "de").when(F.col("id") % 3 == 2, "en")).where(F.col("enabled") & (F.col("lang").isNull() | (F.col("lang") == "de"))).select("id", "name", "lang"), "SELECT id, name, lang FROM (SELECT *, CASE id % 3 WHEN 1 THEN 'de' WHEN 2 THEN 'en' END AS lang FROM step_defs) WHERE enabled AND (lang IS NULL OR lang = 'de')")
_views("f20_defaults", ("ai_logs",), lambda df: df.select("id", F.coalesce("model_name", F.lit("Unknown")).alias("model"), F.coalesce("input_tokens", F.lit(0)).alias("tokens")), "SELECT id, coalesce(model_name, 'Unknown') AS model, coalesce(input_tokens, 0) AS tokens FROM ai_logs")
relational._cost("t53_cost_formula", lambda x: x.select("id", "total_tokens", F.round("total_cost", 9).alias("cost")), "SELECT id, total_tokens, round(total_cost, 9) AS cost FROM priced")
_views("j1_priced_models", ("ai_logs", "models"), lambda a, m: costs.priced(a, m).join(m.select(F.col("name").alias("model_name"), F.lit(True).alias("known")), "model_name", "left").groupBy(F.coalesce("model_name", F.lit("Unknown")).alias("model")).agg(F.count("*").alias("n"), F.count("known").alias("n_known")), "SELECT coalesce(model_name, 'Unknown') AS model, count(*) AS n, count(name) AS n_known FROM ai_logs LEFT JOIN models ON model_name = name GROUP BY 1")
_OLD = f"CASE WHEN NOT coalesce(data_consent_given, false) THEN uploaded_at < timestamp '{relational.NOW}' - INTERVAL 1 HOUR ELSE uploaded_at < timestamp '{relational.NOW}' - INTERVAL 90 DAY END"
_views("j6_cascaded_steps", ("steps", "jobs"), lambda s, j: s.join(records.expired(j, relational.NOW).select("job_id"), "job_id", "left_semi").select("id", "job_id"), f"SELECT id, job_id FROM steps WHERE job_id IN (SELECT job_id FROM jobs WHERE {_OLD})")
_views("j7_document_models", ("ai_logs",), lambda df: costs.without_feedback(df).groupBy("processing_id").agg(F.array_join(F.array_sort(F.collect_set("model_name")), ",").alias("models"), F.countDistinct("model_name").alias("n")), "SELECT processing_id, coalesce(string_agg(DISTINCT model_name, ',' ORDER BY model_name), '') AS models, count(DISTINCT model_name) AS n FROM ai_logs WHERE processing_id NOT LIKE 'feedback_%' GROUP BY 1")
# set operations
_BASED = f"SELECT DISTINCT name, {textual._BASE} AS base FROM store"
_derived("t42_base_keys", "store", lambda df: df.select("name", documents.base_key(F.col("name")).alias("base")).distinct(), _BASED)


def _matches(spark, d):
    new, old = textual._derived(spark, d, "registry").select(F.element_at(F.split("url", "/"), -1).alias("name")), textual._derived(spark, d, "store").select("name")
    key = lambda df, n: df.distinct().select(documents.base_key(F.col("name")).alias("base"), F.col("name").alias(n))
    return key(new, "new_name").join(key(old, "old_name"), "base").groupBy("base").agg(F.count_if(F.col("new_name") == F.col("old_name")).alias("n_same"), F.count("*").alias("n"))


_add(
    "j14_name_matches",
    _matches,
    "WITH " + ", ".join(f"{c} AS ({textual.DERIVED[c][1]})" for c in ("registry", "store")) + f", n AS (SELECT DISTINCT name, {textual._BASE} AS base FROM (SELECT regexp_extract(url, '[^/]*$') AS name FROM registry)), o AS ({_BASED}) SELECT base, count(*) FILTER (n.name = o.name) AS n_same, count(*) AS n FROM n JOIN o USING (base) GROUP BY base",
)


def _hrefs(spark, d):
    found = _read(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("at", "url"))
    return programs.first_urls(found, "page_id", "url", "at").withColumn("pos", F.col("pos").cast("long"))


_add("u6_first_urls", _hrefs, """SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos, url FROM (SELECT page_id, url, min(i) AS first FROM (SELECT page_id, unnest(h) AS url, unnest(range(len(h))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages)) GROUP BY 1, 2)""")
# texts
_T1 = textual.ORACLE_SQL["t1_screen_conversations"]
_add("t2_severities", lambda spark, d: guard.screened(_read(spark, d, "conversations")).groupBy("role", "severity").agg(F.count("*").alias("n")), f"SELECT role, severity, count(*) AS n FROM ({_T1}) JOIN conversations USING (conv_id, turn) GROUP BY 1, 2")
_T7, _T19 = textual.ORACLE_SQL["t7_classify_documents"], textual.ORACLE_SQL["t19_table_score_documents"]
_documents(
    "t9_cascade",
    lambda df: documents.classified(df).select("doc_id", documents.cascade(F.col("document_class"), F.col("confidence"), F.lit("LABORWERTE"), documents.table_score(F.col("text"))).alias("document_class")),
    f"SELECT doc_id, CASE WHEN confidence >= 0.7 OR coalesce(score <= confidence, true) THEN document_class ELSE 'LABORWERTE' END AS document_class FROM ({_T7}) JOIN ({_T19}) USING (doc_id)",
)
_documents(
    "t12_indicators",
    lambda df: df.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).select("doc_id", *[documents.hits(F.col("low"), x).cast("int").alias(f"{k}{i}") for i, (_, s, w) in enumerate(documents.CLASSES) for k, x in (("s", s), ("w", w))]),
    f"SELECT doc_id, {textual._S} FROM (SELECT doc_id, lower(coalesce(text, '')) AS l FROM documents)",
)
_STOPS = ["la", "the", "und", "de"]
_add("t14_stopped_turns", lambda spark, d: _read(spark, d, "conversations").select("conv_id", "turn", documents.stops(F.regexp_replace("text", "\n", " "), _STOPS).alias("stops")), f"SELECT conv_id, turn, upper(split_part(trim(replace(text, chr(10), ' ')), ' ', 1)) IN ({', '.join(_q(s.upper()) for s in _STOPS)}) AS stops FROM conversations")


def _changed(spark, d):
    order = Window.partitionBy("conv_id").orderBy("turn")
    rows = _read(spark, d, "conversations").withColumn("answer", F.lead("text").over(order)).where("answer is not null")
    return rows.select("conv_id", "turn", documents.changes(F.col("text"), F.col("answer")).alias("c")).select("conv_id", "turn", F.col("c.change_count").cast("long").alias("change_count"), F.col("c.length_diff").cast("long").alias("length_diff"), "c.significant")


_add(
    "t15_changes",
    _changed,
    """SELECT conv_id, turn, change_count, length_diff, change_count > 5 OR abs(length_diff) > 100 AS significant FROM (
SELECT conv_id, turn, len(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: coalesce(a[i], '') <> coalesce(b[i], ''))) AS change_count, length(answer) - length(text) AS length_diff FROM (
SELECT *, string_split(text, chr(10)) AS a, string_split(answer, chr(10)) AS b FROM (SELECT conv_id, turn, text, lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS answer FROM conversations) WHERE answer IS NOT NULL))""",
)
_documents("t44_page_numbers", lambda df: df.select("doc_id", sequence.page_number(F.col("text")).alias("page_number")), f"SELECT doc_id, {textual._NUM} AS page_number FROM documents")
_letters("t45_dates", lambda df: df.select("doc_id", F.size(sequence.dates(F.col("text"))).cast("long").alias("n")), f"SELECT doc_id, {decisions._DATES} AS n FROM letters")
_letters(
    "t46_sections",
    lambda df: df.select("doc_id", F.array_join(sequence.sections(F.lower("text")), ",").alias("sections")),
    "SELECT doc_id, concat_ws(',', " + ", ".join(f"CASE WHEN {textual._HAS(n, 'lower(text)')} THEN '{n}' END" for n in sequence.SECTIONS) + ") AS sections FROM letters",
)
_letters(
    "t47_head_and_tail",
    lambda df: df.select("doc_id", sequence.has_section(F.lower(F.substring("text", 1, 200)), "header").alias("head"), sequence.has_section(F.lower(F.right("text", F.lit(200))), "continuation").alias("tail")),
    f"SELECT doc_id, {textual._HAS('header', 'lower(left(text, 200))')} AS head, {textual._HAS('continuation', 'lower(right(text, 200))')} AS tail FROM letters",
)
_PARTS = r"len(regexp_split_to_array(x, '[|\t]')) >= 3"
_documents(
    "t48_tables",
    lambda df: df.where("text is not null").select("doc_id", sequence.has_table(F.col("text")).alias("starts"), sequence.has_table(F.array_join(F.slice(F.reverse(F.split("text", "\n", -1)), 1, 10), "\n")).alias("ends")),
    f"SELECT doc_id, len(list_filter(ls, lambda x: {_PARTS})) > 0 AS starts, len(list_filter(ls[-10:], lambda x: {_PARTS})) > 0 AS ends FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)",
)
_add(
    "t51_time_parts",
    lambda spark, d: _read(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), F.hour("ts").cast("long").alias("hour"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("iso")).withColumn("back", F.date_format(F.to_timestamp("iso"), "HH:mm")),
    "SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, extract(hour FROM ts) AS hour, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso, strftime(ts, '%H:%M') AS back FROM events",
)
_views(
    "t52_guarded_ratios",
    ("chat_logs",),
    lambda df: df.groupBy("user_id").agg(F.count_if(F.col("status") == "error").alias("a"), F.count_if(F.col("app_id") == "app_a").alias("b")).select("user_id", filters.percent(F.col("a"), F.col("b")).alias("share")),
    "SELECT user_id, CASE WHEN b = 0 THEN 0.0 ELSE round(a / b * 100, 2) END AS share FROM (SELECT user_id, count(*) FILTER (status = 'error') AS a, count(*) FILTER (app_id = 'app_a') AS b FROM chat_logs GROUP BY 1)",
)
_add("t54_digests", lambda spark, d: _read(spark, d, "conversations").select("conv_id", "turn", F.sha2("text", 256).alias("digest")), "SELECT conv_id, turn, sha256(text) AS digest FROM conversations")
_add("w3_word_windows", lambda spark, d: guard.grams(_read(spark, d, "benchmark"), "item_id", 4, 0).groupBy("item_id").agg(F.count("*").alias("n"), F.countDistinct("gram").alias("n_distinct")), "SELECT item_id, count(*) AS n, count(DISTINCT g) AS n_distinct FROM (SELECT item_id, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT item_id, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM benchmark))) GROUP BY 1")
# placeholders
_MARKED = "concat('[NAME] [NAME] ', coalesce(text, ''), '[PATIENT_ID][PLZ_CITY] ', cast(doc_id + 100000 as string), '[PLZ_CITY] [] x [PHONE] mg/dl [FAX]-12 [INSURANCE_ID] ', CASE WHEN doc_id % 2 = 0 THEN 'ml' ELSE '% ' END)"
_TIDY = "t"
for _pattern, _instead in redaction.CLEANUP:
    _TIDY = f"regexp_replace({_TIDY}, {_q(_pattern)}, {_q(_instead)}, 'g')"
_documents("pi13_tidied", lambda df: df.select("doc_id", F.md5(redaction.cleaned(F.expr(_MARKED))).alias("text_md5")), f"SELECT doc_id, md5({_TIDY}) AS text_md5 FROM (SELECT doc_id, {_MARKED} AS t FROM documents)")
_UNITS = "|".join(sorted((u for u in removal.UNITS if u[0] not in "%‰/"), key=len, reverse=True))
_SUSPECT = rf"(?i)\[(?:PHONE|FAX|INSURANCE_ID|PATIENT_ID|REFERENCE_ID)\][\s\-/]*(?:{_UNITS}|%|‰)"
_documents("pi14_suspicious", lambda df: df.select("doc_id", F.regexp_count(F.expr(_MARKED), F.lit(_SUSPECT)).cast("long").alias("n")), f"SELECT doc_id, len(regexp_extract_all({_MARKED}, {_q(_SUSPECT)})) AS n FROM documents")
# lines
_NOISE = r"length(x) < 3 OR regexp_matches(x, '^[^\p{L}\p{N}_\s]+$') OR regexp_matches(x, '^[_\-=]+$') OR (length(regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')) > 0 AND length(regexp_replace(x, '[\p{L}\p{N}_\s]', '', 'g')) > 3 * length(regexp_replace(x, '[^\p{L}\p{N}_]', '', 'g')))"
_documents("c7_noise_lines", lambda df: df.where("text is not null").select("doc_id", F.size(F.filter(F.split("text", "\n", -1), tables.is_noise)).cast("long").alias("n")), f"SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: {_NOISE})) AS n FROM documents WHERE text IS NOT NULL")
_documents(
    "c8_lab_rows",
    lambda df: df.select("doc_id", F.explode(F.split("text", "\n", -1)).alias("line")).where(F.contains("line", F.lit("|"))).select("doc_id", F.filter(F.transform(F.split("line", r"\|", -1), lambda x: F.trim(x)), lambda x: x != "").alias("p")).where(F.size("p") >= 2).select("doc_id", tables.lab_row(F.col("p")).alias("row")).groupBy("doc_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.array_sort(F.collect_list("row")), "\n")).alias("rows")),
    """SELECT doc_id, count(*) AS n, md5(string_agg(row, chr(10) ORDER BY row)) AS rows FROM (SELECT doc_id, p[1] || ': ' || p[2] || CASE WHEN len(p) >= 3 THEN ' ' || p[3] ELSE '' END || CASE WHEN len(p) >= 4 THEN ' (Referenz: ' || p[4] || ')' ELSE '' END AS row FROM (
SELECT doc_id, list_filter(list_transform(string_split(line, '|'), lambda x: trim(x)), lambda x: x <> '') AS p FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE contains(line, '|')) WHERE len(p) >= 2) GROUP BY doc_id""",
)
# programs and state
_PHASE = "CASE WHEN post_branching THEN 3 WHEN class_id IS NOT NULL THEN 2 ELSE 1 END"
_views("d3_phases", ("step_defs",), lambda df: df.where("enabled").groupBy(F.expr(_PHASE).alias("phase"), "class_id").agg(F.count("*").alias("n"), F.min_by("id", F.struct("step_order", "id")).alias("first")), f"SELECT {_PHASE} AS phase, class_id, count(*) AS n, arg_min(id, CAST(step_order AS BIGINT) * 100000000 + id) AS first FROM step_defs WHERE enabled GROUP BY 1, 2")
_HAVE = ["document_type", "source_language"]
_views(
    "d4_skipped_steps",
    ("step_defs",),
    lambda df: df.select("id", F.coalesce(F.from_json("required_variables", "array<string>"), F.expr("cast(array() as array<string>)")).alias("r")).select("id", F.array_join(F.array_except("r", F.array(*map(F.lit, _HAVE))), ",").alias("missing")).withColumn("status", F.when(F.col("missing") == "", "RUN").otherwise("SKIPPED")),
    f"SELECT id, missing, CASE WHEN missing = '' THEN 'RUN' ELSE 'SKIPPED' END AS status FROM (SELECT id, array_to_string(list_filter(coalesce(CAST(required_variables AS JSON)::VARCHAR[], []), lambda x: x NOT IN ({', '.join(map(_q, _HAVE))})), ',') AS missing FROM step_defs)",
)
_views(
    "t57_progress",
    ("step_defs",),
    lambda df: df.where("enabled").withColumn("phase", F.expr(_PHASE)).withColumns({"i": F.row_number().over(Window.partitionBy("phase", "class_id").orderBy("step_order", "id")), "n": F.count("*").over(Window.partitionBy("phase", "class_id"))}).select("id", F.floor(F.when(F.col("phase") == 1, F.col("i") * 50 / F.col("n")).when(F.col("phase") == 2, 50 + F.col("i") * 50 / F.col("n")).otherwise(80 + F.col("i") * 20 / F.col("n"))).alias("percent")),
    f"SELECT id, CAST(floor(CASE phase WHEN 1 THEN i * 50 / n WHEN 2 THEN 50 + i * 50 / n ELSE 80 + i * 20 / n END) AS BIGINT) AS percent FROM (SELECT id, phase, row_number() OVER (PARTITION BY phase, class_id ORDER BY step_order, id) AS i, count(*) OVER (PARTITION BY phase, class_id) AS n FROM (SELECT *, {_PHASE} AS phase FROM step_defs WHERE enabled))",
)
_views(
    "r16_job_progress",
    ("steps",),
    lambda df: df.where("job_id is not null").groupBy("job_id").agg(F.count("*").alias("total"), F.count_if(F.col("status") == "COMPLETED").alias("completed"), F.max_by("step_name", F.struct("step_order", "id")).alias("phase"), F.min("started_at").alias("started")),
    "SELECT job_id, count(*) AS total, count(*) FILTER (status = 'COMPLETED') AS completed, arg_max(step_name, step_order) AS phase, min(started_at) AS started FROM steps WHERE job_id IS NOT NULL GROUP BY 1",
)
_AT = "2024-01-31 00:00:00"
_add(
    "r10_idle_sessions",
    lambda spark, d: _read(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.count("*").alias("n")).join(F.broadcast(_read(spark, d, "events").agg(F.max("ts").alias("now"))), F.lit(True)).select("user_id", "n", (F.col("last") < F.col("now") - F.expr("interval 30 minutes")).alias("gone")),
    "SELECT user_id, count(*) AS n, max(ts) < (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE AS gone FROM events GROUP BY 1",
)
_views(
    "r11_result_sweep",
    ("jobs",),
    lambda df: df.select(F.when(F.col("completed_at").isNull(), "no_ttl").when(F.col("completed_at") < F.lit("2001-07-01 00:00:00").cast("timestamp_ntz") - F.expr("interval 2 hours"), "old").otherwise("kept").alias("what")).groupBy("what").agg(F.count("*").alias("n")),
    "SELECT CASE WHEN completed_at IS NULL THEN 'no_ttl' WHEN completed_at < timestamp '2001-07-01 00:00:00' - INTERVAL 2 HOUR THEN 'old' ELSE 'kept' END AS what, count(*) AS n FROM jobs GROUP BY 1",
)

#: The text by layout, else the plain one, else the recognised one: the first of more than 50 characters.
_CHOSEN = "CASE WHEN length(trim(a)) > 50 THEN a WHEN length(trim(b)) > 50 THEN b ELSE c END"
_SOURCES = "regexp_replace(t, '[^A-Za-z ]', ''{g}) AS a, trim(t) AS b, concat('recognised: ', t) AS c"
_documents(
    "s7_text_source",
    lambda df: df.select("doc_id", F.coalesce("text", F.lit("")).alias("t")).selectExpr("doc_id", "regexp_replace(t, '[^A-Za-z ]', '') as a", "trim(t) as b", "concat('recognised: ', t) as c").select("doc_id", F.md5(F.expr(_CHOSEN)).alias("text_md5")),
    f"SELECT doc_id, md5({_CHOSEN}) AS text_md5 FROM (SELECT doc_id, {_SOURCES.format(g=", 'g'")} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
)
_KEEP = ("/th", "/la", ".pdf", "/en")
_add(
    "s10_kept_links",
    lambda spark, d: _read(spark, d, "pages").select("page_id", F.posexplode(documents.links(F.col("html"), _KEEP)).alias("pos", "href")).select("page_id", F.col("pos").cast("long").alias("pos"), "href"),
    f"""SELECT page_id, row_number() OVER (PARTITION BY page_id ORDER BY first) - 1 AS pos, href FROM (SELECT page_id, href, min(i) AS first FROM (SELECT page_id, unnest(h) AS href, unnest(range(len(h))) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages)) GROUP BY 1, 2) WHERE {' OR '.join(f"contains(href, {_q(k)})" for k in _KEEP)}""",
)
_add("s12_last_ids", lambda spark, d: _read(spark, d, "part").groupBy("p_name").agg(F.max_by("p_partkey", "p_partkey").alias("id"), F.count("*").alias("n")), "SELECT p_name, arg_max(p_partkey, p_partkey) AS id, count(*) AS n FROM part GROUP BY 1")
_BROKEN = "CASE WHEN id % 5 = 0 THEN concat(required_variables, ',') WHEN id % 7 = 0 THEN 'no json' ELSE required_variables END"
_views(
    "s13_terms_of_settings",
    ("step_defs",),
    lambda df: df.select("id", F.explode(F.from_json(F.when(F.try_parse_json(F.concat(F.lit("["), F.expr(_BROKEN), F.lit("]"))).isNotNull(), F.expr(_BROKEN)), "array<string>")).alias("term")).groupBy("term").agg(F.count("*").alias("n")),
    f"SELECT term, count(*) AS n FROM (SELECT unnest(CAST(CASE WHEN json_valid(j) THEN j END AS JSON)::VARCHAR[]) AS term FROM (SELECT {_BROKEN} AS j FROM step_defs)) GROUP BY 1",
)
_views("s18_step_rows", ("steps",), lambda df: df.select("id", "status", "started_at", F.length("output_text").cast("long").alias("n_out"), F.md5(F.left(F.repeat("output_text", F.lit(60)), F.lit(500))).alias("prompt")), "SELECT id, status, started_at, length(output_text) AS n_out, md5(left(repeat(output_text, 60), 500)) AS prompt FROM steps")
_T38 = textual.ORACLE_SQL["t38_query_metadata"]
_add("s20_chat_rows", lambda spark, d: textual._metadata(_read(spark, d, "conversations")).withColumn("session_hash", F.sha2(F.col("conv_id").cast("string"), 256)), f"SELECT *, sha256(CAST(conv_id AS VARCHAR)) AS session_hash FROM ({_T38})")
_LOCATIONS = ["klinik", "krankenhaus", "praxis", "zentrum", "institut"]
_KNOWN = [*T.TERMS, *T.DRUGS]


def _suspects(spark, d):
    """Names that may be none: short ones, parts of a term or with a term as part, places."""
    names = term_plans.phrases(_read(spark, d, "documents")).select("phrase", F.lower("phrase").alias("low"))
    part = F.exists(F.array(*map(F.lit, _KNOWN)), lambda t: (F.contains("low", t) | F.contains(t, F.col("low"))) & (t != F.col("low")))
    place = F.exists(F.array(*map(F.lit, _LOCATIONS)), lambda t: F.contains("low", t))
    return names.select("phrase", ((F.length("phrase") <= 3) | part | place).alias("suspect"))


_add(
    "pi29_suspect_names",
    _suspects,
    f"""WITH {term_plans.WORDS_SQL}, known AS (SELECT * FROM (VALUES {', '.join(f'({_q(t)})' for t in _KNOWN)}) v(t)), phrases AS (SELECT DISTINCT phrase, lower(phrase) AS low FROM runs)
SELECT phrase, length(phrase) <= 3 OR EXISTS (SELECT 1 FROM known WHERE (contains(low, t) OR contains(t, low)) AND t <> low) OR {' OR '.join(f'contains(low, {_q(x)})' for x in _LOCATIONS)} AS suspect FROM phrases""",
)
_LABEL = "CASE lang " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in answers.LANGUAGES.items()) + " ELSE upper(lang) END"
_documents(
    "t37_bilingual",
    lambda df: df.where("text is not null and lang is not null").select("doc_id", F.md5(answers.bilingual(F.left("text", F.lit(200)), F.right("text", F.lit(200)), F.col("lang"), "## Recommendations")).alias("text_md5")),
    f"SELECT doc_id, md5(concat(chr(10), chr(10), '---', chr(10), chr(10), '## Recommendations', chr(10), chr(10), '### Deutsch (Original)', chr(10), chr(10), left(text, 200), chr(10), chr(10), '### ', {_LABEL}, ' (Translation)', chr(10), chr(10), right(text, 200))) AS text_md5 FROM documents WHERE text IS NOT NULL AND lang IS NOT NULL",
)
_views(
    "t40_class_guards",
    ("classes", "step_defs"),
    lambda c, s: c.join(s.where("class_id is not null").groupBy(F.col("class_id").alias("id")).agg(F.count("*").alias("n_steps")), "id", "left").select("id", F.upper(F.trim("class_key")).alias("class_key"), (~F.col("is_system")).alias("may_rename"), (~F.col("is_system") & F.col("n_steps").isNull()).alias("may_delete")),
    "SELECT id, upper(trim(class_key)) AS class_key, NOT is_system AS may_rename, NOT is_system AND id NOT IN (SELECT class_id FROM step_defs WHERE class_id IS NOT NULL) AS may_delete FROM classes",
)
#: What a stopped program stores: the job is completed, its output the message.
_MESSAGE = "Processing was terminated."
_add(
    "d6_stored_jobs",
    lambda spark, d: flows._letters(spark, d).select("doc_id", F.lit("COMPLETED").alias("status"), F.col("stopped_at").alias("termination_step"), F.md5(F.when(F.col("status") == "TERMINATED", _MESSAGE).otherwise(F.col("output"))).alias("output_md5")),
    flows._RAN + f"SELECT doc_id, 'COMPLETED' AS status, CASE WHEN stopped THEN 'gate' END AS termination_step, md5(CASE WHEN stopped THEN {_q(_MESSAGE)} ELSE trim(regexp_replace(t, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g')) END) AS output_md5 FROM c",
)
QUERIES["t53_cost_formula"], ORACLE_SQL["t53_cost_formula"] = relational.QUERIES.pop("t53_cost_formula"), relational.ORACLE_SQL.pop("t53_cost_formula")

_documents("t8_confidences", lambda df: documents.classified(df).groupBy("document_class", F.round("confidence", 1).alias("confidence")).agg(F.count("*").alias("n")), f"SELECT document_class, round(confidence, 1) AS confidence, count(*) AS n FROM ({_T7}) GROUP BY 1, 2")
_add("r2_outcomes", lambda spark, d: flows.QUERIES["r3_bans"](spark, d).groupBy("outcome").agg(F.count("*").alias("n"), F.max("retry_after").alias("most")), f"SELECT outcome, count(*) AS n, max(retry_after) AS most FROM ({flows.ORACLE_SQL['r3_bans']}) GROUP BY 1")
_add("u2_updates", lambda spark, d: textual.QUERIES["u1_sync_plan"](spark, d).where("action = 'update'").select("name", "replaces"), f"SELECT name, replaces FROM ({textual.ORACLE_SQL['u1_sync_plan']}) WHERE action = 'update'")
_add("pi18_dictionary", lambda spark, d: term_plans._dictionary(spark, d), f"WITH {term_plans._TERMS} SELECT term FROM terms")
#: Every kind that the model-free removal knows, its marker, and in how many letters it is found.
_MARKERS = [(k, next(m for kind, _, _, m, _ in fallback.PASSES if kind == k)) for k in dict.fromkeys(p[0] for p in fallback.PASSES)]


def _catalogue(spark, d):
    found = fallback.removed(letters(spark, d), "text").select(F.explode(F.split("types", ",")).alias("kind")).groupBy("kind").agg(F.count("*").alias("n"))
    return spark.createDataFrame(_MARKERS, "kind string, marker string").join(found, "kind", "left").select("kind", "marker", F.coalesce("n", F.lit(0)).alias("n"))


QUERIES["pi31_catalogue"] = _catalogue
