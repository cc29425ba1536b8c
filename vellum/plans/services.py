"""Queries over encrypted columns, changed snapshots, retried steps, memberships, answers and feedback, each with SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.functions import answers, documents, fallback, redaction
from vellum.operators import attempts, sealed, snapshots
from vellum.plans.fallback import letters
from vellum.plans.textual import ORACLE_SQL as TEXT_SQL
from vellum.plans.textual import _q
from vellum.sources.overlays import view, with_views

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

KEYS = {"v1": "first secret of the queries", "v2": "second secret of the queries"}
COLUMNS = ["email", "full_name"]
_USERS = "SELECT c_custkey AS id, replace(lower(c_name), '#', '.') || '@example.org' AS email, CASE WHEN c_custkey % 13 = 0 THEN NULL WHEN c_custkey % 17 = 0 THEN ' ' ELSE c_name END AS full_name FROM customer"


def _read(spark, d, name):
    return spark.read.parquet(f"{d}/{name}.parquet")


def _users(spark, d):
    return sealed.seal_columns(spark.sql(_USERS.replace("customer", "{customer}"), customer=_read(spark, d, "customer")), COLUMNS, "v1", KEYS["v1"])


QUERIES["f14_encrypted_search"] = lambda spark, d: sealed.search(_users(spark, d), "R.00000001", COLUMNS, KEYS, "id").select("id", *COLUMNS)
_OPEN = "SELECT id, email, CASE WHEN trim(full_name) <> '' THEN full_name END AS full_name FROM (" + _USERS + ")"
ORACLE_SQL["f14_encrypted_search"] = f"SELECT * FROM ({_OPEN}) WHERE contains(lower(email), 'r.00000001') OR contains(lower(full_name), 'r.00000001') ORDER BY id LIMIT 50"


def _by_hash(spark, d):
    asked = _read(spark, d, "orders").where("o_orderpriority like '1%'").selectExpr("concat('customer.', lpad(cast(o_custkey as string), 9, '0'), '@example.org') as value")
    return sealed.look_up(_users(spark, d), "email", asked, COLUMNS, KEYS).select("id", *COLUMNS)


QUERIES["f15_hash_lookup"] = _by_hash
ORACLE_SQL["f15_hash_lookup"] = f"SELECT * FROM ({_OPEN}) WHERE email IN (SELECT 'customer.' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') || '@example.org' FROM orders WHERE o_orderpriority LIKE '1%')"


def _round_trip(spark, d):
    rows = _users(spark, d).withColumns({"rotated": sealed.rotated(F.col("full_name"), "full_name", KEYS, "v2"), "moved": F.col("full_name")})
    return rows.select(
        "id", sealed.opened(F.col("rotated"), "full_name", KEYS).alias("full_name"), F.coalesce(F.col("rotated").startswith("v2:"), F.lit(False)).alias("is_new"),
        sealed.opened(F.col("moved"), "email", KEYS).alias("elsewhere"), sealed.is_legacy(F.lit("plain: value"), list(KEYS)).alias("legacy"), F.col("email_search").alias("search"),
    )


QUERIES["t55_rotation"] = _round_trip
ORACLE_SQL["t55_rotation"] = f"SELECT id, full_name, full_name IS NOT NULL AS is_new, CAST(NULL AS VARCHAR) AS elsewhere, true AS legacy, sha256(email) AS search FROM ({_OPEN})"

_CHANGES = """SELECT o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1000000 ELSE 0 END AS id, o_orderkey AS seq, CASE o_orderkey % 7 WHEN 0 THEN 'insert' WHEN 1 THEN 'delete' ELSE 'update' END AS op,
CASE WHEN o_orderkey % 3 = 0 THEN concat('name ', o_orderkey) END AS name, CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END AS balance FROM orders"""
_BEFORE = "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance FROM customer"


def _snapshot(spark, d):
    tables = {t: _read(spark, d, t) for t in ("customer", "orders")}
    return spark.sql(_BEFORE.replace("customer", "{customer}"), customer=tables["customer"]), spark.sql(_CHANGES.replace("FROM orders", "FROM {orders}"), orders=tables["orders"])


QUERIES["s3_next_snapshot"] = lambda spark, d: snapshots.applied(*_snapshot(spark, d), "id")
QUERIES["s3_change_log"] = lambda spark, d: snapshots.change_log(*_snapshot(spark, d), "id")
_NET = f"""before AS ({_BEFORE}), changes AS ({_CHANGES}),
based AS (SELECT *, max(seq) FILTER (op <> 'update') OVER (PARTITION BY id) AS b FROM changes),
net AS (SELECT id, arg_max(op, seq) FILTER (op <> 'update') AS base, arg_max(name, seq) FILTER (seq >= coalesce(b, seq) AND name IS NOT NULL) AS new_name, arg_max(balance, seq) FILTER (seq >= coalesce(b, seq) AND balance IS NOT NULL) AS new_balance FROM based GROUP BY id)"""
ORACLE_SQL["s3_next_snapshot"] = f"WITH {_NET} SELECT id, CASE WHEN base = 'insert' THEN new_name ELSE coalesce(new_name, name) END AS name, CASE WHEN base = 'insert' THEN new_balance ELSE coalesce(new_balance, balance) END AS balance FROM net FULL JOIN before USING (id) WHERE base = 'insert' OR (base IS NULL AND before.id IS NOT NULL)"
ORACLE_SQL["s3_change_log"] = f"WITH {_NET} SELECT net.id, CASE WHEN base = 'insert' THEN CASE WHEN before.id IS NULL THEN 'inserted' ELSE 'replaced' END WHEN base = 'delete' AND before.id IS NOT NULL THEN 'deleted' WHEN base IS NULL AND before.id IS NOT NULL THEN 'updated' ELSE 'ignored' END AS action FROM net LEFT JOIN before ON before.id = net.id"

_TRIED = "SELECT id, step_name, CAST(job_id % 5 AS INT) AS failures, CASE WHEN id % 2 = 0 THEN '503 unavailable' WHEN id % 3 = 0 THEN error_message END AS error, CAST(step_order AS INT) AS max_retries, job_id % 4 <> 1 AS retry_on_failure FROM steps"
QUERIES["d8_attempts"] = lambda spark, d: attempts.summary(attempts.attempts(spark.sql(_TRIED.replace("FROM steps", "FROM {steps}"), steps=view(spark, d, "steps"))), "step_name")
ORACLE_SQL["d8_attempts"] = with_views(
    f"""SELECT step_name, count(*) FILTER (attempt = 1) AS steps, count(*) AS attempts, CAST(sum(wait) AS BIGINT) AS waited, count(*) FILTER (attempt = 1 AND failures >= allowed) AS failed, CAST(max(attempt) AS BIGINT) AS most FROM (
SELECT *, CASE WHEN attempt <= failures AND attempt < allowed THEN (CASE WHEN contains(coalesce(error, ''), '503') THEN 5 ELSE 1 END) * attempt ELSE 0 END AS wait FROM (
SELECT *, unnest(range(1, least(failures + 1, allowed) + 1)) AS attempt FROM (SELECT step_name, coalesce(failures, 0) AS failures, error, CASE WHEN coalesce(retry_on_failure, false) THEN greatest(coalesce(max_retries, 1), 1) ELSE 1 END AS allowed FROM ({_TRIED})))) GROUP BY step_name""",
    "steps",
)


def _indexes(spark, d):
    """Columns of indexes: a class's steps name their places, the places' names come from another table."""
    part = _read(spark, d, "part")
    keys = part.groupBy((F.col("p_partkey") % 25).alias("index_id")).agg(F.collect_set("p_size").alias("places"))
    names = part.groupBy("p_size").agg(F.min("p_type").alias("name"))
    found = attempts.matched(keys, "places", names, "p_size")
    return found.groupBy("index_id").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_size", "name"))), lambda x: x["name"]), ",")).alias("columns"))


QUERIES["j13_index_columns"] = _indexes
ORACLE_SQL["j13_index_columns"] = """SELECT index_id, count(*) AS n, md5(string_agg(name, ',' ORDER BY p_size)) AS columns FROM (SELECT p_partkey % 25 AS index_id, list(DISTINCT p_size) AS places FROM part GROUP BY 1)
JOIN (SELECT p_size, min(p_type) AS name FROM part GROUP BY 1) ON list_contains(places, p_size) GROUP BY 1"""


def _variables(spark, d):
    """Which variable stands where in a step's requirements."""
    steps = view(spark, d, "step_defs").select("id", F.from_json("required_variables", "array<string>").alias("wanted"))
    known = view(spark, d, "step_defs").select(F.explode(F.from_json("required_variables", "array<string>")).alias("variable")).groupBy("variable").agg(F.count("*").alias("n_steps"))
    return attempts.matched(steps, "wanted", known, "variable").select("id", "variable", "position", "n_steps")


QUERIES["j13_required_variables"] = _variables
ORACLE_SQL["j13_required_variables"] = with_views(
    """SELECT id, variable, CAST(list_position(wanted, variable) AS BIGINT) AS position, n_steps FROM (SELECT id, CAST(required_variables AS JSON)::VARCHAR[] AS wanted FROM step_defs)
JOIN (SELECT variable, count(*) AS n_steps FROM (SELECT unnest(CAST(required_variables AS JSON)::VARCHAR[]) AS variable FROM step_defs) GROUP BY 1) ON list_contains(wanted, variable)""",
    "step_defs",
)

#: A model's answer about a feedback, in four wrappings.
_JSON = """concat('{"pii_issues":["a ', cast(id as string), '"],"recommendations":[],"overall_quality_score":', cast(id % 10 as string), ',"detailed_analysis":"x ', coalesce(comment, ''), '"}')"""
_ANSWERS = f"SELECT id, CASE id % 4 WHEN 0 THEN {_JSON} WHEN 1 THEN concat('Here it is: ', {_JSON}, ' as you wished') WHEN 2 THEN concat('no answer ', cast(id as string)) ELSE concat('{{broken ', cast(id as string), '}}') END AS text FROM feedback"


def _parsed(spark, d):
    rows = spark.sql(_ANSWERS.replace("{{", "{").replace("}}", "}").replace("{", "{{").replace("}", "}}").replace("FROM feedback", "FROM {feedback}"), feedback=view(spark, d, "feedback"))
    return rows.select("id", answers.parsed(F.col("text")).alias("a")).select("id", "a.overall_quality_score", "a.parse_error", "a.detailed_analysis", F.array_join("a.pii_issues", "|").alias("pii_issues"), F.array_join("a.translation_issues", "|").alias("translation_issues"))


QUERIES["t35_parsed_answers"] = _parsed
ORACLE_SQL["t35_parsed_answers"] = with_views(
    f"""SELECT id, CASE WHEN id % 4 < 2 THEN CAST(id % 10 AS DOUBLE) ELSE 0.0::DOUBLE END AS overall_quality_score, NOT json_ok AS parse_error, CASE WHEN json_ok THEN json->>'$.detailed_analysis' ELSE 'Raw response: ' || left(text, 1000) END AS detailed_analysis,
CASE WHEN json_ok THEN json->>'$.pii_issues[0]' ELSE '' END AS pii_issues, CASE WHEN json_ok THEN NULL ELSE 'Failed to parse AI analysis response' END AS translation_issues
FROM (SELECT id, text, CASE WHEN json_valid(text) THEN text ELSE regexp_extract(text, '\\{{[\\s\\S]*\\}}', 0) END AS json, json_valid(CASE WHEN json_valid(text) THEN text ELSE regexp_extract(text, '\\{{[\\s\\S]*\\}}', 0) END) AS json_ok FROM ({_ANSWERS.replace('{{', '{').replace('}}', '}')}))""".replace("{{", "{").replace("}}", "}"),
    "feedback",
)


def _validated(spark, d):
    rows = view(spark, d, "feedback")
    again = rows.where("id % 5 = 0").withColumn("created_at", F.expr("created_at + interval 1 day")).withColumn("overall_rating", F.col("overall_rating") + 3)
    rows = rows.unionByName(again).withColumn("faults", answers.feedback_faults(F.col("overall_rating"), F.from_json("detailed_ratings", "map<string,int>")))
    first = rows.groupBy("processing_id").agg(F.count("*").alias("n"), F.min_by("faults", "created_at").alias("faults"), F.min_by("overall_rating", "created_at").alias("rating"), F.count_if(F.size("faults") > 0).alias("n_faulty"))
    return first.select("processing_id", "n", "n_faulty", "rating", F.array_join("faults", ",").alias("faults"))


QUERIES["t43_validated_feedback"] = _validated
ORACLE_SQL["t43_validated_feedback"] = with_views(
    """SELECT processing_id, count(*) AS n, count(*) FILTER (faults <> '') AS n_faulty, arg_min(overall_rating, created_at) AS rating, arg_min(faults, created_at) AS faults FROM (
SELECT *, concat_ws(',', CASE WHEN overall_rating NOT BETWEEN 1 AND 5 THEN 'rating' END, CASE WHEN CAST(detailed_ratings->>'$.clarity' AS INT) NOT BETWEEN 1 AND 5 THEN 'value:clarity' END, CASE WHEN CAST(detailed_ratings->>'$.speed' AS INT) NOT BETWEEN 1 AND 5 THEN 'value:speed' END) AS faults
FROM (SELECT processing_id, overall_rating, detailed_ratings, created_at FROM feedback UNION ALL SELECT processing_id, overall_rating + 3, detailed_ratings, created_at + INTERVAL 1 DAY FROM feedback WHERE id % 5 = 0)) GROUP BY processing_id""",
    "feedback",
)

_CLASS = TEXT_SQL["t7_classify_documents"]
QUERIES["t11_hints"] = lambda spark, d: documents.classified(_read(spark, d, "documents")).select("doc_id", answers.hints(F.col("document_class")).alias("h")).select("doc_id", F.array_join("h.focus_areas", ",").alias("focus_areas"), F.array_join("h.special_handling", ",").alias("special_handling"))
_CASE = lambda table: "CASE document_class " + " ".join(f"WHEN {_q(k)} THEN {_q(','.join(v))}" for k, v in table.items()) + " ELSE '' END"
ORACLE_SQL["t11_hints"] = f"SELECT doc_id, {_CASE(answers.FOCUS)} AS focus_areas, {_CASE(answers.HANDLING)} AS special_handling FROM ({_CLASS})"


def _answered(spark, d):
    said = documents.classified(_read(spark, d, "documents")).select("doc_id", F.when(F.col("doc_id") % 3 == 0, "unklar").otherwise(F.concat(F.lit(" class: "), F.lower("document_class"))).alias("text"))
    return said.select("doc_id", answers.class_of_answer(F.col("text")).alias("a")).select("doc_id", "a.*")


QUERIES["t10_class_answers"] = _answered
ORACLE_SQL["t10_class_answers"] = f"SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'ARZTBRIEF' ELSE document_class END AS document_class, CASE WHEN doc_id % 3 = 0 THEN 0.5::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM ({_CLASS})"


def _tables(df):
    cells = F.transform(F.filter(F.split("text", "\n"), lambda x: F.contains(x, F.lit("|"))), lambda x: F.split(x, r"\|", -1))
    return df.where("text is not null").select("doc_id", F.size(cells).cast("long").alias("n_rows"), answers.is_table(cells).alias("is_table"))


QUERIES["t27_valid_tables"] = lambda spark, d: _tables(_read(spark, d, "documents"))
ORACLE_SQL["t27_valid_tables"] = """SELECT doc_id, CAST(len(r) AS BIGINT) AS n_rows, coalesce(len(r) >= 2 AND len(r[1]) >= 2 AND len(list_filter(flatten(r), lambda c: trim(c) <> '')) >= 0.3 * len(flatten(r)), false) AS is_table
FROM (SELECT doc_id, list_transform(list_filter(string_split(text, chr(10)), lambda x: contains(x, '|')), lambda x: string_split(x, '|')) AS r FROM documents WHERE text IS NOT NULL)"""

#: How a document is best read and how hard it is, by its text; a source takes the worst of its documents.
_FACTS = "CASE WHEN contains(text, '|') THEN 2 WHEN regexp_like(text, '[0-9]') THEN 1 ELSE 0 END AS strategy, CASE WHEN length(text) < 500 THEN 0 WHEN length(text) < 3000 THEN 1 WHEN length(text) < 10000 THEN 2 ELSE 3 END AS complexity"
_NAMES = "{0}[1 + max(strategy)] AS strategy, {1}[1 + max(complexity)] AS complexity"
QUERIES["g34_consolidated"] = lambda spark, d: (
    _read(spark, d, "documents").where("text is not null").selectExpr("source", *_FACTS.replace("END AS strategy, ", "END AS strategy;").split(";"))
    .groupBy("source").agg(F.max("strategy").alias("s"), F.max("complexity").alias("c"), F.countDistinct("strategy").alias("n_strategies"))
    .select("source", F.element_at(F.array(*map(F.lit, ("TEXT", "OCR", "VISION"))), F.col("s") + 1).alias("strategy"), F.element_at(F.array(*map(F.lit, ("SIMPLE", "MODERATE", "COMPLEX", "VERY_COMPLEX"))), F.col("c") + 1).alias("complexity"), "n_strategies", (F.col("n_strategies") > 1).alias("mixed"))
)
ORACLE_SQL["g34_consolidated"] = f"SELECT source, {_NAMES.format(['TEXT', 'OCR', 'VISION'], ['SIMPLE', 'MODERATE', 'COMPLEX', 'VERY_COMPLEX'])}, count(DISTINCT strategy) AS n_strategies, count(DISTINCT strategy) > 1 AS mixed FROM (SELECT source, {_FACTS.replace('regexp_like', 'regexp_matches')} FROM documents WHERE text IS NOT NULL) GROUP BY source"

_PAGES = "SELECT job_id, CASE WHEN status = 'COMPLETED' THEN execution_time_seconds / 50 END AS confidence, status FROM steps"
QUERIES["g33_page_confidence"] = lambda spark, d: view(spark, d, "steps").groupBy("job_id").agg((F.coalesce(F.sum(F.when(F.col("status") == "COMPLETED", F.col("execution_time_seconds") / 50)), F.lit(0.0)) / F.count("*")).alias("raw")).select("job_id", F.round("raw", 6).alias("confidence"))
ORACLE_SQL["g33_page_confidence"] = with_views(f"SELECT job_id, round(coalesce(sum(confidence), 0) / count(*), 6) AS confidence FROM ({_PAGES}) GROUP BY job_id", "steps")


def _prompts(spark, d):
    classes = view(spark, d, "classes").where("is_enabled").select("class_key", F.array_join(F.slice(F.coalesce(F.from_json("strong_indicators", "array<string>"), F.expr("cast(array() as array<string>)")), 1, 5), ", ").alias("words"))
    lines = F.array_sort(F.collect_list(F.struct("class_key", "words")))
    return classes.agg(F.array_join(F.transform(lines, lambda x: F.concat(F.lit("  - "), x["class_key"], F.lit(": "), x["words"])), "\n").alias("prompt"), F.count("*").alias("n"))


QUERIES["t39_class_prompt"] = _prompts
ORACLE_SQL["t39_class_prompt"] = with_views("SELECT string_agg('  - ' || class_key || ': ' || array_to_string((CAST(strong_indicators AS JSON)::VARCHAR[])[1:5], ', '), chr(10) ORDER BY class_key) AS prompt, count(*) AS n FROM classes WHERE is_enabled", "classes")
QUERIES["t31_fast_model"] = lambda spark, d: view(spark, d, "step_defs").select("id", answers.uses_fast_model(F.concat_ws(" ", "name", F.when(F.col("id") % 6 == 0, "Final check"), F.when(F.col("id") % 10 == 0, "LAYOUT"))).alias("fast"))
ORACLE_SQL["t31_fast_model"] = with_views("SELECT id, " + " OR ".join(f"contains(lower(concat_ws(' ', name, CASE WHEN id % 6 = 0 THEN 'Final check' END, CASE WHEN id % 10 = 0 THEN 'LAYOUT' END)), {_q(w)})" for w in answers.FAST_WORDS) + " AS fast FROM step_defs", "step_defs")
#: The newest 52 runs of each kind of action.
QUERIES["o10_newest_history"] = lambda spark, d: (
    snapshots.newest(view(spark, d, "audit"), "action", ["created_at", "id"], 52)
    .groupBy("action").agg(F.count("*").alias("n"), F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("created_at", "id"))), lambda x: x["id"].cast("string")), ",")).alias("ids"))
)
ORACLE_SQL["o10_newest_history"] = with_views("SELECT action, count(*) AS n, md5(string_agg(CAST(id AS VARCHAR), ',' ORDER BY created_at, id)) AS ids FROM (SELECT * FROM audit QUALIFY row_number() OVER (PARTITION BY action ORDER BY created_at DESC, id DESC) <= 52) GROUP BY action", "audit")


def _evaluated(spark, d):
    rows = letters(spark, d).join(_read(spark, d, "nation"), F.pmod("doc_id", F.lit(25)) == F.col("n_nationkey"))
    must = rows.withColumns({"must_go": F.array(F.concat(F.initcap("n_name"), F.lit(", Maria")), (F.col("doc_id") + 1000000).cast("string")), "must_stay": F.array(F.lit("Hämoglobin 13,5 g/dl"), F.lit("Vitamin D3"), F.lit("I50.1"), F.lit("Metformin"))})
    clean = fallback.filtered(must)
    return redaction.evaluation(clean, "must_go", "must_stay", "text", "clean").agg(F.count("*").alias("n"), F.sum("false_negatives").alias("false_negatives"), F.sum("false_positives").alias("false_positives"))


QUERIES["g30_evaluation"] = _evaluated
