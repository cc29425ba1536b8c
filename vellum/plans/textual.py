"""Queries over texts, each with the SQL that checks it where the dialects meet."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from vellum.functions import documents as docs
from vellum.functions import guard, privacy, redaction, sequence, tables
from vellum.operators import reconcile
from vellum.sources.cases import case, with_cases
from vellum.sources.overlays import spread

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


#: Queries whose expressions cost much more than a shuffle of their texts.
HEAVY = {"t7_classify_documents", "t16_output_quality", "t17_text_quality", "t19_table_score_documents", "t50_document_order", "pi4_redact_documents", "pi4_redact_text", "pi4_common_counts"}


def _table(name: str, table: str, run, sql: str | None = None) -> None:
    dealt = spread if name in HEAVY else lambda df: df
    QUERIES[name] = lambda spark, d: run(dealt(spark.read.parquet(f"{d}/{table}.parquet")))
    if sql:
        ORACLE_SQL[name] = sql


#: Edge rows for tests: queries over the small inline tables, with their SQL where there is one.
CASES: dict = {}
CASE_SQL: dict[str, str] = {}
#: Inputs that the driver's tables don't hold as such, as SQL over them that both engines read: name -> (table, SQL).
DERIVED: dict[str, tuple[str, str]] = {}


def _case(name: str, cases: tuple[str, ...], run, sql: str | None = None) -> None:
    """A query over inline rows, which tests run, and over the derived tables of the same names, if there are any, which is registered."""
    CASES[name] = lambda spark: run(*[case(spark, c) for c in cases])
    if sql:
        CASE_SQL[name] = with_cases(sql, *cases)
    if all(c in DERIVED for c in cases):
        QUERIES[name] = lambda spark, d: run(*[_derived(spark, d, c) for c in cases])
        if sql:
            ORACLE_SQL[name] = "WITH " + ", ".join(f"{c} AS ({DERIVED[c][1]})" for c in cases) + "\n" + sql


def _derived(spark, d, name):
    table, text = DERIVED[name]
    return spark.sql(text.replace("{", "{{").replace("}", "}}").replace(f"FROM {table}", f"FROM {{{table}}}"), **{table: spark.read.parquet(f"{d}/{table}.parquet")})


def _registry(year: int, where: str) -> str:
    """Registry files named after pages: number, variant, class, host, version."""
    number = "concat(lpad(cast(page_id % 900 as string), 3, '0'), '-', lpad(cast(page_id % 90 as string), 3, '0'))"
    version = f"CASE WHEN page_id % 6 = 0 THEN '' ELSE concat('_20', lpad(cast(10 + page_id % 15 + CASE WHEN page_id % 5 = 0 THEN {year} ELSE 0 END as string), 2, '0'), '-0', cast(1 + page_id % 9 as string)) END"
    name = f"concat({number}, CASE page_id % 4 WHEN 0 THEN 'l' WHEN 1 THEN 'e' ELSE '' END, '_S', cast(1 + page_id % 3 as string), '_', regexp_extract(url, '//([^/]*)/', 1), {version}, CASE WHEN page_id % 8 = 0 THEN '-verlaengert' ELSE '' END)"
    return f"CASE WHEN page_id % 7 = 0 THEN 'readme' ELSE {name} END, '.pdf') AS {{}} FROM pages{where}"


DERIVED.update(
    {
        "prompts": ("conversations", "SELECT conv_id * 100 + turn AS id, CASE WHEN turn % 3 = 1 THEN concat('{', text, '}') ELSE text END AS text FROM conversations"),
        "answers": ("documents", "SELECT doc_id AS id, CASE WHEN doc_id % 11 = 0 THEN ' ' WHEN doc_id % 11 = 1 THEN concat(' BefundBericht ', lang) ELSE CASE doc_id % 5 WHEN 0 THEN concat('Klasse: ', CASE lang WHEN 'de' THEN 'LABORWERTE' WHEN 'fr' THEN 'befundbericht' ELSE 'Arztbrief' END, ' weil ', source) WHEN 1 THEN concat('NICHT_MEDIZINISCH - kein Befund ', source) WHEN 2 THEN concat('  ', lang, ' ') WHEN 3 THEN 'stop' ELSE concat(source, ' und mehr') END END AS text FROM documents"),
        "uploads": ("documents", "SELECT doc_id AS id, concat(source, CASE doc_id % 5 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.png' WHEN 3 THEN '.doc' ELSE '.pdf' END) AS name, floor(100 * least(cast(n_chars as double) / 5000, cast(1 as double))) / 100 AS coverage, floor(100 * cast(length(replace(text, ' ', '')) as double) / greatest(length(text), 1)) / 100 AS quality, cast(CASE WHEN contains(text, '|') THEN 3 ELSE 8 END as double) / 10 AS image FROM documents"),
        "registry": ("pages", "SELECT page_id AS id, concat('https://example.org/a/', " + _registry(0, "").format("url")),
        "store": ("pages", "SELECT page_id AS id, concat(" + _registry(1, " WHERE page_id % 3 <> 0").format("name")),
        "old_columns": ("part", "SELECT p_brand AS name, min(p_type) AS type, max(p_size) > 38 AS nullable FROM part WHERE p_size < 40 AND p_brand <> 'Brand#1' GROUP BY p_brand"),
        "new_columns": ("part", "SELECT p_brand AS name, min(p_type) AS type, max(p_size) > 38 AS nullable FROM part WHERE p_size > 2 AND p_brand <> 'Brand#2' AND p_name <> 'small ring' GROUP BY p_brand"),
        "terms": ("part", "SELECT DISTINCT regexp_extract(p_name, '^[a-z]+', 0) AS term FROM part"),
        "more_terms": ("part", "SELECT DISTINCT CASE WHEN p_size % 2 = 0 THEN upper(regexp_extract(p_name, CASE WHEN p_size % 3 = 0 THEN '^[a-z]+' ELSE '[a-z]+$' END, 0)) ELSE initcap(regexp_extract(p_name, CASE WHEN p_size % 3 = 0 THEN '^[a-z]+' ELSE '[a-z]+$' END, 0)) END AS term FROM part WHERE p_size < 30 AND p_name < 'm'".replace("initcap(", "lower(")),
        "lines_of": ("lineitem", "SELECT l_orderkey AS id, array_agg(CASE WHEN l_linenumber = 2 THEN cast(0 as double) ELSE cast(l_discount as double) * 10 END) AS scores FROM lineitem GROUP BY l_orderkey"),
    }
)


def _fill(query: str, **names: object) -> str:
    for name, value in names.items():
        query = query.replace("{" + name + "}", str(value))
    return query


def _q(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


# screening
_NAMES = "list_filter([" + ", ".join(f"CASE WHEN regexp_matches(text, {_q('(?i)' + (p if not p.startswith('^') else '(?m)' + p))}) THEN '{n}' END" for n, p, _ in guard.INJECTIONS) + "], lambda x: x IS NOT NULL)"
_SEVERE = [n for n, _, c in guard.INJECTIONS if c in guard.SEVERE]
_SCREEN = f"SELECT {{key}}, array_to_string(n, ',') AS names, CAST(CASE WHEN len(n) >= 4 THEN 3 WHEN len(n) >= 2 OR len(list_intersect(n, {_SEVERE})) > 0 THEN 2 WHEN len(n) = 1 THEN 1 ELSE 0 END AS INT) AS severity FROM (SELECT {{key}}, {_NAMES} AS n FROM (SELECT {{key}}, coalesce(text, '') AS text FROM {{table}}))"


def _screen(*keys: str):
    return lambda df: guard.screened(df).select(*keys, F.array_join(F.transform("detections", lambda x: x["name"]), ",").alias("names"), "severity")


_case("t1_screen_prompts", ("prompts",), _screen("id"), _fill(_SCREEN, key="id", table="prompts"))
_table("t1_screen_conversations", "conversations", _screen("conv_id", "turn"), _fill(_SCREEN, key="conv_id, turn", table="conversations"))
_case("t3_sanitize", ("prompts",), lambda df: guard.sanitized(df).select("id", "clean", "was_modified"), "SELECT id, replace(replace(text, '{', '{{'), '}', '}}') AS clean, coalesce(contains(text, '{') OR contains(text, '}'), false) AS was_modified FROM prompts")
_GRAMS = "SELECT DISTINCT {key}, array_to_string(w[i : i + 3], ' ') AS g FROM (SELECT {key}, w, unnest(range(1, len(w) - 2)) AS i FROM (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM {table}) WHERE len(w) >= {least})"
QUERIES["j15_prompt_leakage"] = lambda spark, d: guard.leaks(spark.read.parquet(f"{d}/benchmark.parquet"), spark.read.parquet(f"{d}/documents.parquet"), "item_id", "doc_id")
ORACLE_SQL["j15_prompt_leakage"] = f"SELECT DISTINCT doc_id, item_id FROM ({_fill(_GRAMS, key='item_id', table='benchmark', least=5)}) JOIN ({_fill(_GRAMS, key='doc_id', table='documents', least=4)}) USING (g)"
_case("t5_validate_output", ("answers",), lambda df: df.select("id", guard.validated(F.col("text"), ["STOP", "BEFUNDBERICHT"]).alias("outcome")), "SELECT id, CASE WHEN coalesce(trim(text), '') = '' THEN 'empty' WHEN upper(split_part(trim(text), ' ', 1)) NOT IN ('STOP', 'BEFUNDBERICHT') THEN 'unexpected' ELSE 'ok' END AS outcome FROM answers")


# classification and scores
def _count(terms: list[str], text: str) -> str:
    return "(" + " + ".join(f"CAST(contains({text}, {_q(t)}) AS INT)" for t in terms) + ")"


_S = ", ".join(f"{_count(s, 'l')} AS s{i}, {_count(w, 'l')} AS w{i}" for i, (_, s, w) in enumerate(docs.CLASSES))
_CLASSIFY = f"""
SELECT {{key}}, ['ARZTBRIEF', 'BEFUNDBERICHT', 'LABORWERTE'][best] AS document_class,
       round((CASE WHEN [s0, s1, s2][best] > 0 THEN least(0.5::DOUBLE + top::DOUBLE / most * 0.5 + [s0, s1, s2][best] * 0.1::DOUBLE, 1) ELSE least(top::DOUBLE / most * 0.6, 0.6) END) * CASE WHEN top - sorted[2] < 2 THEN 0.7::DOUBLE ELSE 1 END, 6) AS confidence
FROM (SELECT *, list_position([t0, t1, t2], top) AS best, [{', '.join(str(3 * len(s) + len(w)) for _, s, w in docs.CLASSES)}][list_position([t0, t1, t2], top)] AS most, list_reverse_sort([t0, t1, t2]) AS sorted
      FROM (SELECT *, greatest(t0, t1, t2) AS top FROM (SELECT *, 3 * s0 + w0 AS t0, 3 * s1 + w1 AS t1, 3 * s2 + w2 AS t2 FROM (SELECT {{key}}, {_S} FROM (SELECT *, lower(coalesce(text, '')) AS l FROM {{table}})))))"""
_case("t7_classify_letters", ("letters",), lambda df: docs.classified(df).select("id", "document_class", "confidence"), _fill(_CLASSIFY, key="id", table="letters"))
_table("t7_classify_documents", "documents", lambda df: docs.classified(df).select("doc_id", "document_class", "confidence"), _fill(_CLASSIFY, key="doc_id", table="documents"))
_WORDS = r"len(list_filter(regexp_split_to_array(text, '[^\p{L}\p{N}_]+'), lambda x: regexp_full_match(x, '[a-zA-ZäöüÄÖÜß]{3,}')))"
_table(
    "t17_text_quality",
    "documents",
    lambda df: df.select("doc_id", docs.text_quality(F.col("text")).alias("quality")),
    rf"SELECT doc_id, CASE WHEN length(trim(text)) < 10 THEN 0.0::DOUBLE ELSE round(least((CASE WHEN length(text) > 100 THEN 0.2::DOUBLE ELSE 0 END) + (CASE WHEN length(text) > 500 THEN 0.2::DOUBLE ELSE 0 END) + coalesce(length(regexp_replace(text, '[^\p{{L}}]', '', 'g'))::DOUBLE / nullif(length(replace(replace(text, ' ', ''), chr(10), '')), 0), 0) * 0.4 + CASE WHEN {_WORDS} > 10 THEN 0.2::DOUBLE ELSE 0 END, 1.0), 6) END AS quality FROM documents",
)
_table(
    "t16_output_quality",
    "documents",
    lambda df: df.select("doc_id", docs.output_quality(F.col("text")).alias("quality")),
    f"SELECT doc_id, round(least(0.5::DOUBLE + 0.1::DOUBLE * (CAST(contains(text, '#') AS INT) + CAST({_count(docs.MARKERS, 'text')} > 0 AS INT) + CAST(length(text) BETWEEN 500 AND 5000 AS INT) + CAST(length(text) - length(replace(text, chr(10), '')) > 10 AS INT) + CAST({_count(docs.FRIENDLY, 'text')} >= 3 AS INT)), 1), 6) AS quality FROM documents",
)
_TABLE = rf"round(least(least({_count(docs.LAB_TERMS, 'lower(text)')} * 0.15::DOUBLE, 0.6::DOUBLE) + least(len(regexp_extract_all(lower(text), {_q(docs.UNIT)})) * 0.1::DOUBLE, 0.4::DOUBLE) + least((length(text) - length(translate(text, '|' || chr(9), '')) + len(regexp_extract_all(text, '\s{{3,}}'))) * 0.02::DOUBLE, 0.2::DOUBLE) + least(len(regexp_extract_all(text, {_q(docs.RANGE)})) * 0.05::DOUBLE, 0.2::DOUBLE), 1.0), 6)"
_case("t19_table_score", ("letters",), lambda df: df.select("id", docs.table_score(F.col("text")).alias("score")), f"SELECT id, {_TABLE} AS score FROM letters")
_table("t19_table_score_documents", "documents", lambda df: df.select("doc_id", docs.table_score(F.col("text")).alias("score")), f"SELECT doc_id, {_TABLE} AS score FROM documents")
_case("t22_quality_gate", ("uploads",), lambda df: df.select("id", docs.file_type(F.col("name")).alias("kind"), docs.quality_gate(docs.file_type(F.col("name")), F.col("coverage"), F.col("quality"), F.col("image")).alias("g")).select("id", "kind", "g.score", "g.accepted"), "SELECT id, kind, score, score >= 0.5 AS accepted FROM (SELECT id, kind, round(CASE WHEN kind = 'pdf' THEN 0.6::DOUBLE * coverage + 0.4::DOUBLE * quality ELSE image END, 6) AS score FROM (SELECT *, CASE WHEN lower(name) LIKE '%.pdf' THEN 'pdf' WHEN regexp_matches(lower(name), '\\.(jpg|jpeg|png)$') THEN 'image' ELSE 'unknown' END AS kind FROM uploads))")
_case("t32_formatting", ("bullets",), lambda df: df.select("id", docs.formatted(F.col("text")).alias("text")), "SELECT id, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?m)^•', '-', 'g'), '(?m)^  →', '  - →', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')) AS text FROM bullets")
_case("t33_merge_pages", ("pages_of",), lambda df: docs.merge_pages(df, "doc"), "SELECT doc, string_agg('--- Seite ' || page || ' ---' || chr(10) || text || chr(10), chr(10) ORDER BY page) AS merged FROM pages_of GROUP BY 1")
_case(
    "t34_smart_merge",
    ("pages_of",),
    lambda df: docs.merge_pages(df, "doc", smart=True),
    "SELECT doc, string_agg(CASE WHEN last IS NULL OR regexp_matches(last, '(,|-|und|oder|sowie)$') THEN trim(text) ELSE chr(10) || '--- Seite ' || page || ' ---' || chr(10) || chr(10) || trim(text) END, chr(10) ORDER BY page) AS merged FROM (SELECT *, rtrim(lag(trim(text)) OVER (PARTITION BY doc ORDER BY page)) AS last FROM pages_of) GROUP BY 1",
)
_E = docs.NAME.replace("(?i)", "")
_P = lambda i: f"regexp_extract(n, '{_E}', {i}, 'i')"
_D = lambda i: f"regexp_extract(n, '{docs.DATED.replace('(?i)', '')}', {i}, 'i')"
_OK = f"regexp_matches(n, '{_E}', 'i')"
_case(
    "t41_registry_entries",
    ("registry",),
    lambda df: df.select("id", docs.registry_entry(F.col("url")).alias("e")).select("id", "e.*"),
    f"SELECT id, n AS filename, CASE WHEN {_OK} THEN {_P(1)} ELSE regexp_extract(n, '^([0-9]{{3}}-[0-9]{{3}})([a-z])?', 1) END AS registry_number, CASE WHEN {_OK} THEN {_P(2)} ELSE regexp_extract(n, '^([0-9]{{3}}-[0-9]{{3}})([a-z])?', 2) END AS variant, CASE WHEN {_OK} THEN {_P(3)} ELSE '' END AS classification, CASE WHEN {_OK} THEN {_P(4)} ELSE replace(n, '.pdf', '') END AS title, CASE WHEN {_OK} THEN {_P(5)} ELSE {_D(1)} END AS version, nullif(CASE WHEN {_OK} THEN {_P(6)} ELSE {_D(2)} END, '') AS suffix FROM (SELECT id, regexp_extract(url, '[^/]*$') AS n FROM registry)",
)
_BASE = f"CASE WHEN regexp_matches(name, '{docs.DATED.replace('(?i)', '')}', 'i') THEN regexp_replace(name, '{docs.DATED.replace('(?i)', '')}', '', 'i') ELSE replace(name, '.pdf', '') END"
_case(
    "u1_sync_plan",
    ("registry", "store"),
    lambda r, s: reconcile.sync_plan(r.select(F.element_at(F.split("url", "/"), -1).alias("name")), s),
    f"SELECT CASE WHEN o.name IS NULL THEN 'add' WHEN n.name IS NULL THEN 'delete' ELSE 'update' END AS action, coalesce(n.name, o.name) AS name, CASE WHEN n.name IS NOT NULL THEN o.name END AS replaces FROM (SELECT name, {_BASE} AS key FROM (SELECT DISTINCT regexp_extract(url, '[^/]*$') AS name FROM registry) WHERE name NOT IN (SELECT name FROM store)) n FULL JOIN (SELECT name, {_BASE} AS key FROM (SELECT DISTINCT name FROM store) WHERE name NOT IN (SELECT regexp_extract(url, '[^/]*$') FROM registry)) o ON n.key = o.key",
)
_case("u3_schema_diff", ("old_columns", "new_columns"), reconcile.schema_diff, "SELECT coalesce(a.name, b.name) AS name, CASE WHEN a.name IS NULL THEN 'new' WHEN b.name IS NULL THEN 'removed' WHEN a.type IS NOT DISTINCT FROM b.type AND a.nullable IS NOT DISTINCT FROM b.nullable THEN 'common' ELSE 'modified' END AS outcome FROM old_columns a FULL JOIN new_columns b ON a.name = b.name")
_case("u4_merge_terms", ("terms", "more_terms"), reconcile.merge_terms, "SELECT term FROM terms UNION ALL SELECT min(term) AS term FROM more_terms WHERE lower(term) NOT IN (SELECT lower(term) FROM terms) GROUP BY lower(term)")
_case("pi32_excluded_terms", ("terms", "more_terms"), reconcile.without_terms, "SELECT term FROM terms WHERE lower(term) NOT IN (SELECT lower(term) FROM more_terms)")
_table("s10_page_links", "pages", lambda df: df.select("page_id", F.posexplode(docs.links(F.col("html"))).alias("pos", "href")).select("page_id", F.col("pos").cast("int").alias("pos"), "href"), """SELECT page_id, CAST(pos - 1 AS INT) AS pos, href FROM (SELECT page_id, href, row_number() OVER (PARTITION BY page_id ORDER BY first) AS pos FROM (SELECT page_id, href, min(i) AS first FROM (SELECT page_id, unnest(h) AS href, unnest(range(1, len(h) + 1)) AS i FROM (SELECT page_id, regexp_extract_all(html, 'href="([^"]+)"', 1) AS h FROM pages)) GROUP BY 1, 2))""")
_case("t13_branch_value", ("answers",), lambda df: df.select("id", docs.branch_value(F.col("text"), ["ARZTBRIEF", "BEFUNDBERICHT", "LABORWERTE"]).alias("value"), docs.stops(F.col("text"), ["Nicht_Medizinisch", "stop"]).alias("stops")), "SELECT id, coalesce(CASE WHEN contains(p, 'ARZTBRIEF') THEN 'ARZTBRIEF' WHEN contains(p, 'BEFUNDBERICHT') THEN 'BEFUNDBERICHT' WHEN contains(p, 'LABORWERTE') THEN 'LABORWERTE' END, split_part(p, ' ', 1)) AS value, upper(split_part(trim(text), ' ', 1)) IN ('NICHT_MEDIZINISCH', 'STOP') AS stops FROM (SELECT id, text, upper(trim(regexp_replace(text, '^\\s*(class|klasse|classification|dokumenttyp|antwort|answer)\\s*:\\s*', '', 'i'))) AS p FROM answers)")
QUERIES["t38_query_metadata"] = lambda spark, d: _metadata(spark.read.parquet(f"{d}/conversations.parquet"))
ORACLE_SQL["t38_query_metadata"] = r"SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS query_length, CAST(len(list_filter(regexp_split_to_array(text, '[ \t\n\x0B\f\r]+'), lambda x: x <> '')) AS BIGINT) AS query_words, sha256(text) AS query_hash FROM conversations"


def _metadata(df):
    from vellum.operators.chat import query_metadata

    return query_metadata(df.select("conv_id", "turn", "text"), "text")


# page order
_NUM = "coalesce(" + ", ".join(f"try_cast(nullif(regexp_extract(text, {_q(p)}, 1, 'i'), '') AS INT)" for p in sequence.PAGE_NUMBERS) + ")"
_HAS = lambda n, t: f"regexp_matches({t}, {_q('|'.join(f'(?:{p})' for p in sequence.SECTIONS[n]))})"
_PRIO = f"CASE WHEN {_HAS('patient_info', 'l')} OR {_HAS('header', 'left(l, 200)')} THEN 1 WHEN {_HAS('lab_values', 'l')} THEN 3 WHEN {_HAS('diagnosis', 'l')} THEN 4 WHEN {_HAS('medication', 'l')} THEN 5 WHEN {_HAS('continuation', 'right(l, 200)')} THEN 6 ELSE 2 END"
_ORDER = f"SELECT batch_id, idx, page_number, CAST(row_number() OVER (PARTITION BY batch_id ORDER BY CASE WHEN share >= 0.7 THEN CAST(page_number IS NULL AS INT) ELSE prio END, CASE WHEN share >= 0.7 THEN coalesce(page_number, 0) ELSE 0 END, idx) AS INT) AS position FROM (SELECT *, avg(CAST(page_number IS NOT NULL AS INT)) OVER (PARTITION BY batch_id) AS share FROM (SELECT batch_id, idx, {_NUM} AS page_number, {_PRIO} AS prio FROM (SELECT *, lower(text) AS l FROM {{table}})))"
_case("t50_page_order", ("sheets",), sequence.ordered, _fill(_ORDER, table="sheets"))
_BATCHES = "(SELECT doc_id // 8 AS batch_id, CAST(doc_id % 8 AS INT) AS idx, text FROM documents)"
_table("t50_document_order", "documents", lambda df: sequence.ordered(df.select(F.floor(F.col("doc_id") / 8).alias("batch_id"), (F.col("doc_id") % 8).cast("int").alias("idx"), "text")), _fill(_ORDER, table=_BATCHES))
_case("g32_moved_pages", ("sheets",), lambda df: sequence.moved_share(sequence.ordered(df)), f"SELECT batch_id, count(*) FILTER (first <> position) AS moves, round(count(*) FILTER (first <> position)::DOUBLE / count(*), 4) AS share FROM (SELECT batch_id, position, row_number() OVER (PARTITION BY batch_id ORDER BY idx) AS first FROM ({_fill(_ORDER, table='sheets')})) GROUP BY 1")
_case("t49_page_confidence", ("sheets",), lambda df: df.select("batch_id", "idx", sequence.analysis_confidence(F.col("text")).alias("confidence")), "SELECT batch_id, idx, round(least(0.5::DOUBLE + CASE WHEN coalesce(" + _NUM + ", 0) <> 0 THEN 0.3::DOUBLE ELSE 0 END + (" + " + ".join(f"CAST({_HAS(n, 'lower(text)')} AS INT)" for n in sequence.SECTIONS) + ") * 0.05::DOUBLE, 1), 6) AS confidence FROM sheets")

# scans
_case("c6_clean_scans", ("scans",), lambda df: df.select("id", tables.clean_text(F.col("text")).alias("text")))
_case("s9_mean_confidence", ("lines_of",), lambda df: df.select("id", tables.mean_confidence(F.col("scores")).alias("confidence")), "SELECT id, coalesce(round(list_sum(list_transform(scores, lambda s: coalesce(nullif(s, 0), 0.9::DOUBLE))) / nullif(len(scores), 0), 6), 0.0) AS confidence FROM lines_of")


# redaction
def _chain() -> str:
    text = "coalesce(text, '')"
    for _, pattern, placeholder in redaction.CONTACTS:
        text = f"regexp_replace({text}, {_q(pattern)}, '{placeholder}', 'g')"
    return text


#: The English passes over whole documents; a test holds them against a plain reading.
_table("pi4_redact_documents", "documents", lambda df: privacy.removed(df, "en").select("doc_id", "redacted", F.col("removals").alias("entities")), None)
_table("pi4_redact_text", "documents", lambda df: df.select("doc_id", F.md5(redaction.masked(F.coalesce("text", F.lit("")))).alias("redacted_md5")), f"SELECT doc_id, md5({_chain()}) AS redacted_md5 FROM documents")
_table("pi4_common_counts", "documents", lambda df: redaction.with_counts(df).agg(*[F.sum(f"n_{k}").alias(f"n_{k}") for k in ("email", "ip")]), "SELECT CAST(sum(len(regexp_extract_all(text, " + _q(redaction.CONTACTS[0][1]) + "))) AS BIGINT) AS n_email, CAST(sum(len(regexp_extract_all(regexp_replace(text, " + _q(redaction.CONTACTS[2][1]) + ", '[PHONE]', 'g'), " + _q(redaction.CONTACTS[3][1]) + "))) AS BIGINT) AS n_ip FROM documents")
