"""Queries over the catalog's relational views, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.operators import chat, costs, filters, records
from vellum.sources.overlays import view, with_views

NOW = "2024-01-31 00:00:00"
JOB_NOW = "1998-08-02 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, views: tuple[str, ...], run, sql: str) -> None:
    """A query over views, and its twin."""
    QUERIES[name] = lambda spark, d: run(*[view(spark, d, v) for v in views])
    ORACLE_SQL[name] = with_views(sql, *views)


_PRICED = """priced AS (
  SELECT l.*, input_tokens + output_tokens AS total_tokens,
         input_tokens / 1000 * (CASE WHEN price_input > 0 AND price_output > 0 THEN price_input ELSE 0.54 END / 1000)
       + output_tokens / 1000 * (CASE WHEN price_input > 0 AND price_output > 0 THEN price_output ELSE 0.81 END / 1000) AS total_cost
  FROM ai_logs l LEFT JOIN models m ON l.model_name = m.name)"""


def _cost(name: str, run, sql: str) -> None:
    QUERIES[name] = lambda spark, d: run(costs.priced(view(spark, d, "ai_logs"), view(spark, d, "models")))
    ORACLE_SQL[name] = with_views("SELECT 1", "ai_logs", "models").rsplit("\n", 1)[0] + ", " + _PRICED + "\n" + sql


def _zero(x: str, digits: int) -> str:
    return f"coalesce(round({x}, {digits}), 0.0)"


_cost("g1_total_cost", costs.total_cost, f"SELECT {_zero('sum(total_cost)', 6)} AS total_cost, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS total_tokens, count(*) AS calls, {_zero('sum(total_cost) / count(*)', 6)} AS avg_cost, {_zero('sum(total_tokens) / count(*)', 0)} AS avg_tokens FROM priced")
_cost(
    "g2_cost_breakdown",
    costs.breakdown,
    "".join(
        f"{u} SELECT '{k}' AS kind, coalesce({c}, 'Unknown') AS name, round(sum(total_cost), 6) AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls FROM priced GROUP BY 2"
        for u, k, c in (("", "model", "model_name"), (" UNION ALL", "step", "step_name"))
    ),
)
_cost("g2_first_provider", costs.first_provider, "SELECT coalesce(model_name, 'Unknown') AS model, arg_min(model_provider, id) AS provider FROM priced GROUP BY 1")
QUERIES["g2_first_provider"] = lambda spark, d: costs.first_provider(costs.priced(view(spark, d, "ai_logs", place=True), view(spark, d, "models")))
_PER = "SELECT processing_id, sum(total_cost) AS cost, CAST(sum(total_tokens) AS BIGINT) AS tokens, count(*) AS calls, min(created_at) AS first_at, max(document_type) AS document_type, coalesce(string_agg(DISTINCT model_name, ',' ORDER BY model_name), '') AS models FROM priced WHERE processing_id NOT LIKE 'feedback_%' GROUP BY 1"
_cost("g5_cost_per_document", lambda x: costs.per_document(x).withColumn("cost", F.round("cost", 6)), f"SELECT * REPLACE (round(cost, 6) AS cost) FROM ({_PER})")
_cost("g3_document_statistics", costs.document_statistics, f"SELECT count(*) AS documents, {_zero('avg(cost)', 6)} AS avg_cost, {_zero('min(cost)', 6)} AS min_cost, {_zero('max(cost)', 6)} AS max_cost FROM ({_PER})")
_cost("o2_document_page", lambda x: costs.document_page(x, "tokens", 10, 20), f"SELECT * REPLACE (round(cost, 6) AS cost) FROM ({_PER}) ORDER BY tokens DESC, processing_id LIMIT 20 OFFSET 10")
_cost("g4_feedback_analysis_cost", lambda x: costs.step_cost(x, "FEEDBACK_ANALYSIS"), f"SELECT count(*) AS calls, {_zero('sum(total_cost)', 6)} AS cost, {_zero('avg(total_cost)', 6)} AS avg_cost FROM priced WHERE step_name = 'FEEDBACK_ANALYSIS'")
_cost("o6_model_shares", costs.shares, "SELECT coalesce(model_name, 'Unknown') AS model, round(sum(total_cost), 6) AS cost, round(sum(total_cost) / sum(sum(total_cost)) OVER () * 100, 2) AS share FROM priced GROUP BY 1")
_cost("g27_daily_cost", costs.daily_cost, "SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, round(sum(total_cost), 6) AS cost, count(DISTINCT processing_id) AS documents FROM priced GROUP BY 1")
_cost("f5_without_feedback", lambda x: costs.without_feedback(x).groupBy("step_name").agg(F.count("*").alias("n")), "SELECT step_name, count(*) AS n FROM priced WHERE processing_id NOT LIKE 'feedback_%' GROUP BY 1")
_cost(
    "f1_filtered_logs",
    lambda x: filters.filtered(x, {"step_name": "STEP_AF", "model_name": None, "unknown": 1}, {"created_at": "1996-01-01"}, {"created_at": "1996-12-31"}).select("id", "processing_id", F.round("total_cost", 6).alias("cost")),
    "SELECT id, processing_id, round(total_cost, 6) AS cost FROM priced WHERE step_name = 'STEP_AF' AND created_at >= '1996-01-01' AND created_at <= '1996-12-31'",
)
_cost("o3_document_log", lambda x: x.where("processing_id = 'doc_7'").orderBy("created_at", "id").select("id", "step_name", "created_at"), "SELECT id, step_name, created_at FROM priced WHERE processing_id = 'doc_7'")

_RATES = "count(*) AS requests, count(*) FILTER (status = 'success') AS successes, count(*) FILTER (status = 'error') AS errors, count(*) FILTER (status = 'rate_limited') AS rate_limited"
_RATE = "coalesce(round(count(*) FILTER (status = 'success')::DOUBLE / nullif(count(*), 0) * 100, 2), 0.0) AS success_rate"
_add(
    "g7_chat_overview",
    ("chat_logs",),
    chat.overview,
    f"SELECT {_RATES}, CAST(coalesce(sum(total_tokens), 0) AS BIGINT) AS tokens, {_zero('sum(cost_usd)', 6)} AS cost, {_zero('avg(response_time_ms) FILTER (status = $$success$$)', 2)} AS avg_response_ms, {_zero('avg(first_token_time_ms) FILTER (status = $$success$$)', 2)} AS avg_first_token_ms, {_RATE} FROM chat_logs",
)
_DAILY = f"{_RATES}, CAST(sum(total_tokens) AS BIGINT) AS tokens, round(sum(cost_usd), 6) AS cost, {_RATE}"
_add("g8_chat_daily", ("chat_logs",), chat.daily, f"SELECT CAST(CAST(created_at AS DATE) AS VARCHAR) AS day, {_DAILY} FROM chat_logs GROUP BY 1")
_add("g9_chat_hourly", ("chat_logs",), lambda x: chat.hourly(x, "2024-01-10"), f"SELECT CAST(hour(created_at) AS INT) AS hour, {_DAILY} FROM chat_logs WHERE CAST(created_at AS DATE) = '2024-01-10' GROUP BY 1")
_add("g10_cost_by_app", ("chat_logs",), chat.cost_by_app, "SELECT app_id, CAST(grouping(app_id) AS INT) AS is_total, round(sum(cost_usd), 6) AS cost, CAST(sum(prompt_tokens) AS BIGINT) AS prompt_tokens, CAST(sum(completion_tokens) AS BIGINT) AS completion_tokens, count(*) AS requests FROM chat_logs GROUP BY ROLLUP (app_id)")
_add("g11_error_breakdown", ("chat_logs",), chat.error_breakdown, "SELECT 'status' AS kind, status AS name, count(*) AS count FROM chat_logs GROUP BY 2 UNION ALL SELECT 'error_type', error_type, count(*) FROM chat_logs WHERE status <> 'success' AND error_type IS NOT NULL GROUP BY 2")
for _column in ("response_time_ms", "first_token_time_ms"):
    _add(
        f"g12_percentiles_{_column.split('_')[0]}",
        ("chat_logs",),
        lambda x, c=_column: chat.index_percentiles(x, c),
        f"SELECT l[CAST(floor(len(l) * 0.5) AS BIGINT) + 1] AS p50, l[CAST(floor(len(l) * 0.95) AS BIGINT) + 1] AS p95, l[CAST(floor(len(l) * 0.99) AS BIGINT) + 1] AS p99, l[1] AS least, l[len(l)] AS greatest, CAST(len(l) AS BIGINT) AS n FROM (SELECT list_sort(list({_column})) AS l FROM chat_logs WHERE status = 'success' AND {_column} IS NOT NULL)",
    )
_add("g13_distinct_users", ("chat_logs",), chat.distinct_users, "SELECT count(DISTINCT ip_address_hash) AS users FROM chat_logs")
_add("f2_chat_page", ("chat_logs",), lambda x: filters.newest(filters.filtered(x, {"status": "error"}), key="request_id", skip=5, limit=50).select("request_id", "error_type", "created_at"), "SELECT request_id, error_type, created_at FROM chat_logs WHERE status = 'error' ORDER BY created_at DESC, request_id LIMIT 50 OFFSET 5")
_add("f10_chat_on_day", ("chat_logs",), lambda x: filters.on_day(x, "2024-01-05").select("request_id", "status"), "SELECT request_id, status FROM chat_logs WHERE CAST(created_at AS DATE) = '2024-01-05'")
_add("s4_count_exists", ("chat_logs",), lambda x: x.where("status = 'error'").agg(F.count("*").alias("n"), (F.count("*") > 0).alias("found")), "SELECT count(*) AS n, count(*) > 0 AS found FROM chat_logs WHERE status = 'error'")
_add("s1_scan_page", ("chat_logs",), lambda x: filters.page(x, "request_id", skip=20).select("request_id", "status"), "SELECT request_id, status FROM chat_logs ORDER BY request_id LIMIT 100 OFFSET 20")
_add("s2_point_lookup", ("chat_logs",), lambda x: x.where("request_id = 77").limit(1).select("request_id", "status"), "SELECT request_id, status FROM chat_logs WHERE request_id = 77")

_add("f3_feedback_page", ("feedback",), lambda x: filters.sorted_page(x.where("data_consent_given"), "overall_rating", "created_at", "id", limit=30).select("id", "overall_rating"), "SELECT id, overall_rating FROM feedback WHERE data_consent_given ORDER BY overall_rating DESC, id LIMIT 30")
_SUB = lambda k: f"coalesce(round(avg(nullif(CAST(detailed_ratings->>'$.{k}' AS DOUBLE), 0)), 2), 0.0) AS avg_{k}"
_add(
    "g14_feedback_statistics",
    ("feedback",),
    records.feedback_statistics,
    "SELECT count(*) AS n, coalesce(round(avg(overall_rating), 2), 0.0) AS avg_rating, " + ", ".join(f"count(*) FILTER (overall_rating = {k}) AS rating_{k}" for k in range(1, 6)) + f", coalesce(round(count(*) FILTER (data_consent_given)::DOUBLE / nullif(count(*), 0) * 100, 1), 0.0) AS consent_rate, count(*) FILTER (coalesce(comment, '') <> '') AS with_comment, {_SUB('clarity')}, {_SUB('speed')} FROM feedback",
)
_add("g15_analysis_statistics", ("feedback",), records.analysis_statistics, "SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (analysis_status = '{s}') AS {s.lower()}" for s in ("PENDING", "COMPLETED", "FAILED")) + ", coalesce(round(avg(coalesce(quality_score, 0)) FILTER (analysis_status = 'COMPLETED' AND analysis_summary IS NOT NULL), 1), 0.0) AS avg_quality FROM feedback WHERE data_consent_given")
_SHOWN = "coalesce(data_consent_given AND translated_text IS NOT NULL AND original_text <> '[removed]', false)"
_add("j2_feedback_details", ("feedback", "jobs"), records.feedback_details, f"SELECT f.id, overall_rating, status, {_SHOWN.replace('data_consent_given', 'f.data_consent_given')} AS has_content, CASE WHEN {_SHOWN.replace('data_consent_given', 'f.data_consent_given')} THEN original_text END AS original_text, CASE WHEN {_SHOWN.replace('data_consent_given', 'f.data_consent_given')} THEN translated_text END AS translated_text FROM feedback f LEFT JOIN jobs ON processing_id = job_id")
_add("j5_orphaned_feedback", ("feedback", "jobs"), lambda f, j: records.orphaned_feedback(f, j.where("status = 'COMPLETED'")).select("id", "processing_id"), "SELECT id, processing_id FROM feedback f WHERE NOT coalesce(data_consent_given, false) AND NOT EXISTS (SELECT 1 FROM jobs WHERE job_id = processing_id AND status = 'COMPLETED')")
_add("f8_recent_feedback", ("feedback",), lambda x: filters.within(x, NOW, 240).select("id", "created_at"), f"SELECT id, created_at FROM feedback WHERE created_at BETWEEN timestamp '{NOW}' - INTERVAL 240 HOUR AND timestamp '{NOW}'")

_add("f6_audit_search", ("audit",), lambda x: filters.search(x, "DETAIL 9", "action", "resource_type", "resource_id", "details").select("id"), "SELECT id FROM audit WHERE action ILIKE '%DETAIL 9%' OR resource_type ILIKE '%DETAIL 9%' OR resource_id ILIKE '%DETAIL 9%' OR details ILIKE '%DETAIL 9%'")
_add("f8_recent_failed_logins", ("audit",), lambda x: filters.within(x, NOW, 48).where("action = 'LOGIN_FAILED'").groupBy("ip_address").agg(F.count("*").alias("n")), f"SELECT ip_address, count(*) AS n FROM audit WHERE action = 'LOGIN_FAILED' AND created_at BETWEEN timestamp '{NOW}' - INTERVAL 48 HOUR AND timestamp '{NOW}' GROUP BY 1")
_add("f9_audit_by_resource", ("audit",), lambda x: filters.filtered(x, {"resource_type": "resource_2", "resource_id": "6"}).select("id", "action"), "SELECT id, action FROM audit WHERE resource_type = 'resource_2' AND resource_id = '6'")
_add("o4_audit_page", ("audit",), lambda x: filters.newest(x, skip=100, limit=100).select("id", "action", "created_at"), "SELECT id, action, created_at FROM audit ORDER BY created_at DESC, id LIMIT 100 OFFSET 100")
_ACTIONS = "(VALUES " + ", ".join(f"({i}, '{a}')" for i, a in enumerate(records.ACTIONS)) + ") AS e(position, action)"
_add("g16_activity_summary", ("audit",), records.activity_summary, f"SELECT e.action, CAST(position AS INT) AS position, count(id) AS n, count(DISTINCT user_id) AS users, count(DISTINCT ip_address) AS addresses FROM {_ACTIONS} LEFT JOIN audit a ON a.action = e.action GROUP BY 1, 2")
_add("g17_counts_by_user", ("audit",), lambda x: x.groupBy("user_id", "action").agg(F.count("*").alias("n")), "SELECT user_id, action, count(*) AS n FROM audit GROUP BY 1, 2")
_add("s14_audit_export", ("audit",), lambda x: records.audit_export(x, "2024-01-05", "2024-01-06 12:00:00", 500), "SELECT id, strftime(created_at, '%Y-%m-%dT%H:%M:%S') AS created_at, user_id, action, resource_type, resource_id, ip_address, details FROM audit WHERE created_at BETWEEN '2024-01-05' AND '2024-01-06 12:00:00' ORDER BY audit.created_at DESC, id LIMIT 500")
_add("r9_audit_retention", ("audit",), lambda x: x.agg(F.count_if(F.col("created_at") < F.lit("2024-01-20").cast("timestamp_ntz")).alias("removed"), F.count_if(F.col("created_at") >= F.lit("2024-01-20").cast("timestamp_ntz")).alias("kept")), "SELECT count(*) FILTER (created_at < '2024-01-20') AS removed, count(*) FILTER (created_at >= '2024-01-20') AS kept FROM audit")
_add("u7_latest_per_session", ("audit",), lambda x: records.latest_per(x.select("user_id", "action", "created_at", "id", "details"), ["user_id", "action"], "created_at", "id"), "SELECT user_id, action, created_at, id, details FROM audit QUALIFY row_number() OVER (PARTITION BY user_id, action ORDER BY created_at DESC, id DESC) = 1")

_add("j3_failed_steps", ("steps", "jobs"), records.failed_steps, "SELECT s.id, s.job_id, step_name, error_message, s.started_at, j.status AS job_status FROM steps s JOIN jobs j ON s.job_id = j.job_id WHERE s.status = 'FAILED' ORDER BY s.started_at DESC, s.id LIMIT 20")
_add("j4_orphan_steps", ("steps", "jobs"), lambda s, j: records.orphans(s, j).select("id", "job_id"), "SELECT id, job_id FROM steps s WHERE job_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM jobs j WHERE j.job_id = s.job_id)")
_OLD = f"CASE WHEN NOT coalesce(data_consent_given, false) THEN uploaded_at < timestamp '{JOB_NOW}' - INTERVAL 1 HOUR ELSE uploaded_at < timestamp '{JOB_NOW}' - INTERVAL 90 DAY END"
_add("r5_retention_report", ("jobs", "steps", "feedback"), lambda j, s, f: records.retention_report(j, s, f, JOB_NOW), f"SELECT 'jobs' AS what, count(*) AS removed FROM jobs WHERE {_OLD} UNION ALL SELECT 'steps', count(*) FROM steps WHERE job_id IN (SELECT job_id FROM jobs WHERE {_OLD}) UNION ALL SELECT 'feedback', count(*) FROM feedback WHERE processing_id IN (SELECT job_id FROM jobs WHERE {_OLD})")
_add("r5_survivors", ("jobs",), lambda j: records.survivors(j, JOB_NOW).select("job_id"), f"SELECT job_id FROM jobs WHERE NOT ({_OLD})")
_add("r6_cleared_jobs", ("jobs",), lambda j: records.cleared(j, JOB_NOW).select("job_id", "status", "original_text", "translated_text", "content_cleared_at"), f"SELECT job_id, status, '[removed]' AS original_text, CASE WHEN translated_text IS NOT NULL THEN '[removed]' END AS translated_text, '{JOB_NOW}' AS content_cleared_at FROM jobs")
_add("r7_stalled_jobs", ("jobs",), lambda j: records.stalled(j, "1997-01-01 00:00:00"), "SELECT job_id, 'FAILED' AS status, 'no progress for 15 minutes' AS error_message FROM jobs WHERE status = 'RUNNING' AND started_at < timestamp '1997-01-01 00:00:00' - INTERVAL 15 MINUTE")
_add("w2_last_steps", ("steps",), records.last_steps, "SELECT count(*) AS n, coalesce(round(avg(execution_time_seconds), 2), 0.0) AS avg_seconds, coalesce(round(count(*) FILTER (status = 'COMPLETED')::DOUBLE / nullif(count(*), 0) * 100, 1), 0.0) AS success_rate FROM (SELECT * FROM steps WHERE status IN ('COMPLETED', 'FAILED') ORDER BY started_at DESC, id LIMIT 100)")
_add("o5_most_used_step", ("steps",), records.most_used_step, "SELECT step_name, count(*) AS n FROM steps GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1")
_PICK = lambda w: f"arg_min(output_text, lpad(CAST(step_order AS VARCHAR), 4, '0') || output_text) FILTER (regexp_matches(lower(step_name), '{w}'))"
_add("j11_job_texts", ("jobs", "steps"), records.job_texts, f"SELECT j.job_id, coalesce(p, o, original_text) AS analysis_text FROM jobs j LEFT JOIN (SELECT job_id, {_PICK('pii|privacy|datenschutz|anonym')} AS p, {_PICK('extraction|ocr|text')} AS o FROM steps WHERE job_id IS NOT NULL GROUP BY 1) s ON s.job_id = j.job_id")
_add("g27_job_success", ("jobs",), records.job_success_by_day, "SELECT CAST(CAST(uploaded_at AS DATE) AS VARCHAR) AS day, count(*) AS jobs, count(*) FILTER (status = 'COMPLETED') AS completed, round(count(*) FILTER (status = 'COMPLETED')::DOUBLE / count(*) * 100, 2) AS success_rate FROM jobs GROUP BY 1")
_add("g27_step_times", ("steps",), records.step_times, "SELECT step_name, count(*) AS n, round(avg(execution_time_seconds), 2) AS avg_seconds, round(min(execution_time_seconds), 2) AS min_seconds, round(max(execution_time_seconds), 2) AS max_seconds FROM steps GROUP BY 1")
_add("g18_step_statistics", ("steps",), records.step_statistics, "SELECT count(*) AS total, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s.lower()}" for s in ("COMPLETED", "FAILED", "RUNNING", "PENDING", "SKIPPED", "TERMINATED", "CANCELLED", "QUEUED")) + ", coalesce(round(count(*) FILTER (status = 'COMPLETED')::DOUBLE / nullif(count(*), 0), 4), 0.0) AS success_ratio FROM steps")
_add("f11_without_consent", ("jobs",), lambda j: j.where(filters.without_consent()).select("job_id"), "SELECT job_id FROM jobs WHERE data_consent_given IS FALSE OR data_consent_given IS NULL")
_add("f16_pending_jobs", ("jobs",), lambda j: filters.page(j.where("status = 'PENDING'"), "uploaded_at", "job_id", limit=50).select("job_id", "uploaded_at"), "SELECT job_id, uploaded_at FROM jobs WHERE status = 'PENDING' ORDER BY uploaded_at, job_id LIMIT 50")

_add("f4_setting_prefix", ("settings",), lambda x: filters.by_prefix(x, "enable_").select("key", "value"), "SELECT key, value FROM settings WHERE key LIKE 'enable_%'")
_add("f7_setting_search", ("settings",), lambda x: filters.search(x, "ENABLE", "key", "description").select("key"), "SELECT key FROM settings WHERE key ILIKE '%ENABLE%' OR description ILIKE '%ENABLE%'")
_add(
    "f19_typed_settings",
    ("settings",),
    lambda x: x.select("key", filters.as_bool(F.col("value")).alias("b"), filters.as_int(F.col("value"), -1).alias("i"), filters.as_float(F.col("value"), -1.0).alias("f")),
    r"SELECT key, lower(value) IN ('true', '1', 'yes', 'on') AS b, coalesce(CASE WHEN regexp_matches(value, '^[+-]?[0-9]+$') THEN try_cast(value AS BIGINT) END, -1) AS i, coalesce(CASE WHEN regexp_matches(value, '^[+-]?[0-9]+(\.[0-9]+)?$') THEN try_cast(value AS DOUBLE) END, -1.0) AS f FROM settings",
)
_ON = "key LIKE 'enable_%' AND lower(value) IN ('true', '1', 'yes', 'on')"
_add("g20_setting_statistics", ("settings",), records.settings_statistics, f"SELECT count(*) AS total, count(*) FILTER (key LIKE 'enable_%') AS flags, count(*) FILTER ({_ON}) AS enabled, count(*) FILTER (lower(value) IN ('true', 'false')) AS booleans, count(*) FILTER (regexp_matches(value, '^[0-9]+$')) AS numbers, coalesce(round(count(*) FILTER ({_ON})::DOUBLE / nullif(count(*) FILTER (key LIKE 'enable_%'), 0) * 100, 1), 0.0) AS adoption FROM settings")
_add(
    "s15_import_settings",
    ("settings",),
    lambda x: records.import_settings(x.where("value <> 'true'"), x.where("key like 'enable%'").withColumn("value", F.upper("value")), True),
    "SELECT coalesce(a.key, b.key) AS key, coalesce(b.value, a.value) AS value, CASE WHEN b.key IS NULL THEN 'kept' WHEN a.key IS NULL THEN 'imported' ELSE 'updated' END AS outcome FROM (SELECT key, value FROM settings WHERE value <> 'true') a FULL JOIN (SELECT key, upper(value) AS value FROM settings WHERE key LIKE 'enable%') b ON a.key = b.key",
)
_add("f22_rollout", ("users",), lambda x: x.select("id", *[filters.rollout(F.col("id"), p).alias(f"at_{p}") for p in (0, 30, 75, 100)], filters.rollout(F.col("id"), 100, False).alias("off")), "SELECT id, false AS at_0, b % 100 < 30 AS at_30, b % 100 < 75 AS at_75, true AS at_100, false AS off FROM (SELECT id, CAST('0x' || left(md5(CAST(id AS VARCHAR)), 8) AS BIGINT) AS b FROM users)")
_add("g22_user_statistics", ("users",), records.user_statistics, "SELECT count(*) AS total, count(*) FILTER (is_active) AS active, count(*) FILTER (role = 'ADMIN') AS admins, count(*) FILTER (role <> 'ADMIN') AS users, count(*) FILTER (failed_login_attempts >= 5) AS locked FROM users")
_add("g21_model_statistics", ("models",), lambda x: x.agg(F.count("*").alias("total"), F.count_if("is_enabled").alias("enabled"), F.count_if(~F.col("is_enabled")).alias("disabled")), "SELECT count(*) AS total, count(*) FILTER (is_enabled) AS enabled, count(*) FILTER (NOT is_enabled) AS disabled FROM models")
