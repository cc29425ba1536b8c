"""Queries over step definitions, classes, keys, flags and quotas, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vellum.operators import costs, programs
from vellum.plans.relational import _PRICED
from vellum.sources.overlays import view, with_views

NOW = "2024-01-20 00:00:00"
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _add(name: str, views: tuple[str, ...], run, sql: str) -> None:
    QUERIES[name] = lambda spark, d: run(*[view(spark, d, v) for v in views])
    ORACLE_SQL[name] = with_views(sql, *views)


def _listed(column: str) -> str:
    return f"CAST(from_json({column}, '[\"VARCHAR\"]') AS VARCHAR[])"


_add("f13_requiring_variable", ("step_defs",), lambda s: programs.requiring(s, "document_type").select("id", "name"), f"SELECT id, name FROM step_defs WHERE list_contains({_listed('required_variables')}, 'document_type')")
_add("f17_key_validity", ("api_keys",), lambda k: programs.keys_state(k, NOW), f"SELECT id, is_active AND NOT is_revoked AND (expires_at IS NULL OR expires_at >= TIMESTAMP '{NOW}') AS is_valid, is_active AND expires_at IS NOT NULL AND expires_at < TIMESTAMP '{NOW}' AS is_expired FROM api_keys")
_add("f18_access", ("members",), lambda m: programs.access(m, NOW), f"SELECT id, banned_for_good OR coalesce(banned_until > TIMESTAMP '{NOW}', false) AS is_banned, coalesce(locked_until > TIMESTAMP '{NOW}', false) AS is_locked FROM members")
_ENV, _CONFIG, _DEFAULTS = {"enable_5": "on", "enable_10": "off"}, {"enable_25": True, "multi_file": True, "enable_5": False}, {"enable_5": True, "enable_30": False, "multi_file": False, "nothing": True, "unset": False, "limit.4": True}
_add(
    "f21_feature_flags",
    ("settings",),
    lambda s: programs.flags(s, _ENV, _CONFIG, _DEFAULTS),
    """SELECT f.feature, coalesce(lower(e) IN ('true', '1', 'yes', 'on'), lower(value) IN ('true', '1', 'yes', 'on'), c, d, false) AS enabled,
       CASE WHEN e IS NOT NULL THEN 'environment' WHEN value IS NOT NULL THEN 'settings' WHEN c IS NOT NULL THEN 'config' ELSE 'default' END AS origin
FROM (VALUES ('enable_5', 'on', false, true), ('enable_10', 'off', NULL, NULL), ('enable_25', NULL, true, NULL), ('multi_file', NULL, true, false), ('enable_30', NULL, NULL, false), ('nothing', NULL, NULL, true), ('unset', NULL, NULL, false), ('limit.4', NULL, NULL, true)) f(feature, e, c, d)
LEFT JOIN (SELECT key, min(value) AS value FROM settings GROUP BY key) s ON s.key = f.feature""",
)
_add("f23_api_status", ("jobs",), lambda j: j.groupBy("status", programs.api_status(F.col("status"), F.col("user_id") % 100).alias("api_status")).agg(F.count("*").alias("n")), "SELECT status, CASE WHEN status = 'RUNNING' THEN CASE WHEN user_id % 100 < 20 THEN 'EXTRACTING_TEXT' WHEN user_id % 100 < 70 THEN 'TRANSLATING' ELSE 'LANGUAGE_TRANSLATING' END WHEN status IN ('FAILED', 'SKIPPED') THEN 'ERROR' WHEN status = 'COMPLETED' THEN 'COMPLETED' ELSE 'PENDING' END AS api_status, count(*) AS n FROM jobs GROUP BY 1, 2")
_IDS = [7, 3, 99999999, 12, 1]
_add("o7_reordered_steps", ("step_defs",), lambda s: programs.reordered(s, _IDS).select("id", F.col("step_order").cast("long").alias("step_order")), f"SELECT id, CAST(coalesce(list_position({_IDS}, id), step_order) AS BIGINT) AS step_order FROM step_defs")
_add("o8_duplicated_step", ("step_defs",), lambda s: programs.duplicated(s, 12, "copy").select("name", F.col("step_order").cast("long").alias("step_order"), "enabled", "is_branching", "class_id", "post_branching"), "SELECT 'copy' AS name, (SELECT CAST(max(step_order) + 1 AS BIGINT) FROM step_defs) AS step_order, false AS enabled, false AS is_branching, class_id, post_branching FROM step_defs WHERE id = 12")
_add("o1_phase_order", ("step_defs",), lambda s: s.withColumn("phase", programs.phase(s)).select("id", "phase", F.row_number().over(Window.partitionBy("phase").orderBy("step_order", "id")).alias("place")), "SELECT id, CAST(phase AS INT) AS phase, CAST(row_number() OVER (PARTITION BY phase ORDER BY step_order, id) AS INT) AS place FROM (SELECT *, CASE WHEN post_branching THEN 3 WHEN class_id IS NOT NULL THEN 2 ELSE 1 END AS phase FROM step_defs)")
_add("j8_branches", ("classes", "step_defs"), programs.branches, "SELECT class_key, CAST(count(s.id) AS INT) AS n_steps, coalesce(string_agg(s.name, '|' ORDER BY step_order, s.id), '') AS steps FROM classes c LEFT JOIN step_defs s ON s.class_id = c.id AND s.enabled WHERE c.is_enabled GROUP BY class_key")
_add("j9_class_in_use", ("classes", "step_defs"), lambda c, s: programs.with_steps(c, s.where("class_id % 2 = 0")), "SELECT class_key, used AS has_steps, NOT is_system AND NOT used AS may_go FROM (SELECT *, EXISTS (SELECT 1 FROM step_defs s WHERE s.class_id = c.id AND s.class_id % 2 = 0) AS used FROM classes c)")
_add("j10_most_used_name", ("steps", "step_defs"), lambda e, s: programs.most_used(e.withColumn("step_id", F.col("job_id") % 50), s), "SELECT coalesce((SELECT name FROM step_defs WHERE id = t.id), 'N/A') AS most_used_step FROM (SELECT job_id % 50 AS id FROM steps WHERE job_id IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) t")
_some = lambda c: f"CAST(count(*) FILTER (coalesce(len({_listed(c)}), 0) > 0) AS BIGINT)"
_add("g19_class_statistics", ("classes",), programs.class_statistics, f'SELECT count(*) AS total, count(*) FILTER (is_enabled) AS enabled, count(*) FILTER (NOT is_enabled) AS disabled, count(*) FILTER (is_system) AS system, count(*) FILTER (NOT is_system) AS "user", {_some("examples")} AS with_examples, {_some("strong_indicators")} AS with_strong, {_some("weak_indicators")} AS with_weak FROM classes')
_add("g23_interactions", ("chat_logs",), programs.interactions, "SELECT app_id, count(*) AS total, count(*) FILTER (status = 'success') AS success, count(*) FILTER (status = 'error') AS error, round(count(*) FILTER (status = 'success')::DOUBLE / count(*), 6) AS success_rate FROM chat_logs GROUP BY ROLLUP (app_id)")
_add("g24_system_health", ("settings",), programs.health, "SELECT count(*) FILTER (lower(value) = 'true') AS enabled, count(*) AS total, round(count(*) FILTER (lower(value) = 'true') * 100.0::DOUBLE / count(*), 1) AS adoption FROM settings WHERE key LIKE 'enable_%'")
_names = lambda which: f"md5(string_agg(name, '|' ORDER BY step_order, id) FILTER ({which}))"
_add("g25_configuration", ("step_defs",), programs.configuration, f"SELECT count(*) AS total, count(*) FILTER (enabled) AS enabled, count(*) FILTER (NOT enabled) AS disabled, {_names('enabled')} AS enabled_names, {_names('NOT enabled')} AS disabled_names FROM step_defs")
_add("g26_cache_statistics", ("chat_logs",), lambda c: programs.cache_statistics(c, NOW), f"SELECT count(*) AS total, count(*) FILTER (created_at >= TIMESTAMP '{NOW}') AS active, greatest(count(*) - count(*) FILTER (created_at >= TIMESTAMP '{NOW}'), 0) AS expired FROM chat_logs")
QUERIES["g6_document_details"] = lambda spark, d: programs.document_details(costs.priced(view(spark, d, "ai_logs"), view(spark, d, "models")), "doc_1")
ORACLE_SQL["g6_document_details"] = with_views("SELECT 1", "ai_logs", "models").rsplit("\n", 1)[0] + ", " + _PRICED + "\n" + "SELECT id, step_name, total_tokens, round(coalesce(total_cost, 0), 6) AS cost, CAST(1 AS BIGINT) AS calls FROM priced WHERE processing_id = 'doc_1' UNION ALL SELECT NULL, 'total', CAST(sum(total_tokens) AS BIGINT), round(sum(total_cost), 6), count(*) FROM priced WHERE processing_id = 'doc_1'"
_add("g28_queue_gauges", ("jobs",), lambda j: j.agg(*[F.count_if(F.col("status") == s).alias(s.lower()) for s in ("PENDING", "RUNNING", "COMPLETED")], F.count_if(F.col("status").isin("PENDING", "RUNNING")).alias("open")), "SELECT count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'RUNNING') AS running, count(*) FILTER (status = 'COMPLETED') AS completed, count(*) FILTER (status IN ('PENDING', 'RUNNING')) AS open FROM jobs")
_add("g29_hit_rate", ("chat_logs",), lambda c: c.groupBy("app_id").agg(F.round(F.when(F.count("*") > 0, F.count_if(F.col("first_token_time_ms").isNull()) / F.count("*") * 100).otherwise(0.0), 2).alias("hit_rate")), "SELECT app_id, round(count(*) FILTER (first_token_time_ms IS NULL) * 100.0::DOUBLE / count(*), 2) AS hit_rate FROM chat_logs GROUP BY 1")
_add("g31_interpolated_percentiles", ("chat_logs",), lambda c: c.groupBy("app_id").agg(*[F.round(F.percentile("response_time_ms", q / 100), 6).alias(f"p{q}") for q in (50, 90, 95, 99)]), "SELECT app_id, " + ", ".join(f"round(quantile_cont(response_time_ms, {q / 100}), 6) AS p{q}" for q in (50, 90, 95, 99)) + " FROM chat_logs GROUP BY 1")
_add("t6_filled_prompts", ("step_defs",), lambda s: programs.filled_prompts(s, {"input_text": "the text"}), "SELECT id, CASE WHEN NOT contains(t, '{') THEN t END AS prompt, CASE WHEN contains(t, '{') THEN 'missing variable: ' || regexp_extract(t, '\\{(\\w+)\\}', 1) END AS error FROM (SELECT id, replace(prompt_template, '{input_text}', 'the text') AS t FROM step_defs)")
_add("t40_class_keys", ("classes",), lambda c: c.select(F.upper(F.trim(F.concat(F.lit("  "), F.lower("class_key")))).alias("class_key"), "is_system").groupBy("class_key").agg(F.count("*").alias("n"), F.max("is_system").alias("is_system")), "SELECT class_key, count(*) AS n, bool_or(is_system) AS is_system FROM classes GROUP BY 1")
_LIMITS = [("10 minutes", 10), ("6 hours", 50), ("2 days", 200)]
_left = ", ".join(f"greatest({n} - count(*) FILTER (created_at > TIMESTAMP '{NOW}' - INTERVAL {i} AND created_at <= TIMESTAMP '{NOW}'), 0) AS left_{i.split()[1]}" for i, n in _LIMITS)
_add("r4_remaining_quota", ("chat_logs",), lambda c: programs.remaining(c, "user_id", _LIMITS, NOW), f"SELECT user_id, {_left} FROM chat_logs GROUP BY 1")
_add("r8_recent_logs", ("audit",), lambda a: a.where(F.col("created_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 7 days")).groupBy("action").agg(F.count("*").alias("kept")), f"SELECT action, count(*) AS kept FROM audit WHERE created_at >= TIMESTAMP '{NOW}' - INTERVAL 7 DAYS GROUP BY 1")
_add("r12_retryable_analyses", ("feedback",), lambda f: f.where((F.col("analysis_status") == "FAILED") & F.coalesce("data_consent_given", F.lit(False)) & (F.col("created_at") >= F.lit(NOW).cast("timestamp_ntz") - F.expr("interval 24 hours"))).orderBy("created_at", "id").limit(50).select("id", "created_at"), f"SELECT id, created_at FROM feedback WHERE analysis_status = 'FAILED' AND data_consent_given AND created_at >= TIMESTAMP '{NOW}' - INTERVAL 24 HOURS ORDER BY created_at, id LIMIT 50")
_add("s13_custom_terms", ("classes",), lambda c: c.select(F.explode(F.concat(*[F.coalesce(programs.json_list(F.col(x)), F.array().cast("array<string>")) for x in ("examples", "strong_indicators", "weak_indicators")])).alias("term")).groupBy("term").agg(F.count("*").alias("n")), "SELECT term, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT unnest({_listed(x)}) AS term FROM classes" for x in ("examples", "strong_indicators", "weak_indicators")) + ") GROUP BY 1")
