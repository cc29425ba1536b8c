"""Feedback, audit, jobs, settings and users: statistics, joins and retention."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.operators.filters import newest, percent, ratio, without_consent

# Every audited action, in order.
ACTIONS = [
    "LOGIN", "LOGIN_FAILED", "LOGOUT", "TOKEN_REFRESH", "PASSWORD_CHANGE", "USER_CREATED", "USER_UPDATED", "USER_DELETED", "USER_ACTIVATED", "USER_DEACTIVATED", "API_KEY_CREATED",
    "API_KEY_REVOKED", "PIPELINE_CREATED", "PIPELINE_UPDATED", "PIPELINE_DELETED", "SETTINGS_UPDATED", "PERMISSION_DENIED", "DATA_EXPORT", "DATA_IMPORT", "FEEDBACK_DELETED",
    "DOCUMENT_PROCESSED", "DOCUMENT_DELETED",
]
MARKER = "[removed]"


def feedback_statistics(feedback: DataFrame, details: tuple[str, ...] = ("clarity", "speed")) -> DataFrame:
    """Count, mean rating, ratings 1 to 5, consent share, comments, means of the JSON sub-ratings without 0."""
    n = F.count("*")
    stars = [F.count_if(F.col("overall_rating") == k).alias(f"rating_{k}") for k in range(1, 6)]
    sub = [F.coalesce(F.round(F.avg(F.nullif(F.get_json_object("detailed_ratings", f"$.{d}").try_cast("double"), F.lit(0.0))), 2), F.lit(0.0)).alias(f"avg_{d}") for d in details]
    return feedback.agg(
        n.alias("n"), F.coalesce(F.round(F.avg("overall_rating"), 2), F.lit(0.0)).alias("avg_rating"), *stars,
        percent(F.count_if(F.coalesce("data_consent_given", F.lit(False))), n, 1).alias("consent_rate"), F.count_if(F.coalesce("comment", F.lit("")) != "").alias("with_comment"), *sub,
    )


def analysis_statistics(feedback: DataFrame) -> DataFrame:
    """Counts per analysis status and the mean quality of what is analysed, a missing score counting 0."""
    with_consent = feedback.where(F.coalesce("data_consent_given", F.lit(False)))
    done = (F.col("analysis_status") == "COMPLETED") & F.col("analysis_summary").isNotNull()
    states = [F.count_if(F.col("analysis_status") == s).alias(s.lower()) for s in ("PENDING", "COMPLETED", "FAILED")]
    return with_consent.agg(F.count("*").alias("n"), *states, F.coalesce(F.round(F.avg(F.when(done, F.coalesce("quality_score", F.lit(0.0)))), 1), F.lit(0.0)).alias("avg_quality"))


def feedback_details(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    """Feedback with its job; the texts show only with consent and a translation."""
    found = feedback.join(jobs.select(F.col("job_id").alias("_job"), "status", "original_text", "translated_text"), F.col("processing_id") == F.col("_job"), "left")
    shown = F.coalesce("data_consent_given", F.lit(False)) & F.col("translated_text").isNotNull() & (F.col("original_text") != MARKER)
    return found.select("id", "overall_rating", "status", F.coalesce(shown, F.lit(False)).alias("has_content"), F.when(shown, F.col("original_text")).alias("original_text"), F.when(shown, F.col("translated_text")).alias("translated_text"))


def activity_summary(audit: DataFrame) -> DataFrame:
    """Events per action, 0 for those that never happened, with each action's users and addresses."""
    spark = audit.sparkSession
    actions = spark.createDataFrame([(i, a) for i, a in enumerate(ACTIONS)], "position int, action string")
    counts = audit.groupBy("action").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("ip_address").alias("addresses"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n", "users", "addresses")]
    return F.broadcast(actions).join(counts, "action", "left").select("action", "position", *zero)


def audit_export(audit: DataFrame, start: str, end: str, limit: int = 10_000) -> DataFrame:
    """The newest rows of a range with ISO times, as written to CSV."""
    inside = audit.where((F.col("created_at") >= F.lit(start).cast("timestamp_ntz")) & (F.col("created_at") <= F.lit(end).cast("timestamp_ntz")))
    rows = newest(inside, limit=limit)
    return rows.select("id", F.date_format("created_at", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "user_id", "action", "resource_type", "resource_id", "ip_address", "details")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.option("header", True).mode("overwrite").csv(path)


def failed_steps(steps: DataFrame, jobs: DataFrame, limit: int = 20) -> DataFrame:
    """The newest failed step executions with their jobs."""
    failed = steps.where("status = 'FAILED'").select("id", "job_id", "step_name", "error_message", "started_at")
    joined = failed.join(jobs.select("job_id", F.col("status").alias("job_status")), "job_id")
    return newest(joined, "started_at", "id", limit=limit)


def orphans(steps: DataFrame, jobs: DataFrame) -> DataFrame:
    """Step executions whose job isn't there. A null job is unknown, so it is no orphan."""
    return steps.where("job_id is not null").join(jobs.select("job_id"), "job_id", "left_anti")


def orphaned_feedback(feedback: DataFrame, jobs: DataFrame) -> DataFrame:
    return feedback.where(without_consent()).join(jobs.select(F.col("job_id").alias("processing_id")), "processing_id", "left_anti")


def expired(jobs: DataFrame, now: str, hours_without: int = 1, days_with: int = 90) -> DataFrame:
    """Jobs past their retention: an hour without consent, 90 days with it."""
    at = F.lit(now).cast("timestamp_ntz")
    old = F.when(without_consent(), F.col("uploaded_at") < at - F.expr(f"INTERVAL {hours_without} HOURS")).otherwise(F.col("uploaded_at") < at - F.expr(f"INTERVAL {days_with} DAYS"))
    return jobs.where(old)


def retention_report(jobs: DataFrame, steps: DataFrame, feedback: DataFrame, now: str) -> DataFrame:
    """What a purge removes: jobs, and by semi-join their steps and feedback."""
    gone = expired(jobs, now).select("job_id")
    count = lambda df, name: df.agg(F.lit(name).alias("what"), F.count("*").alias("removed"))
    return (
        count(gone, "jobs")
        .union(count(steps.join(gone, "job_id", "left_semi"), "steps"))
        .union(count(feedback.join(gone.withColumnRenamed("job_id", "processing_id"), "processing_id", "left_semi"), "feedback"))
    )


def survivors(jobs: DataFrame, now: str) -> DataFrame:
    """The jobs that stay: the complement of expired() without a join."""
    at = F.lit(now).cast("timestamp_ntz")
    return jobs.where(F.when(without_consent(), F.col("uploaded_at") >= at - F.expr("INTERVAL 1 HOURS")).otherwise(F.col("uploaded_at") >= at - F.expr("INTERVAL 90 DAYS")))


def cleared(jobs: DataFrame, now: str) -> DataFrame:
    """Jobs with their texts replaced by a marker, where there were any; figures stay."""
    mark = lambda c: F.when(F.col(c).isNotNull(), F.lit(MARKER))
    return jobs.withColumns({"original_text": mark("original_text"), "translated_text": mark("translated_text"), "content_cleared_at": F.lit(now)})


def stalled(jobs: DataFrame, now: str, minutes: int = 15) -> DataFrame:
    """Running jobs older than a limit, as they are after being failed."""
    old = jobs.where((F.col("status") == "RUNNING") & (F.col("started_at") < F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")))
    return old.select("job_id", F.lit("FAILED").alias("status"), F.concat(F.lit("no progress for "), F.lit(minutes), F.lit(" minutes")).alias("error_message"))


def last_steps(steps: DataFrame, n: int = 100) -> DataFrame:
    """Mean time and success rate of the last n executions: a top-n, then one aggregate."""
    last = steps.where("status in ('COMPLETED', 'FAILED')").orderBy(F.desc("started_at"), "id").limit(n)
    return last.agg(F.count("*").alias("n"), F.coalesce(F.round(F.avg("execution_time_seconds"), 2), F.lit(0.0)).alias("avg_seconds"), percent(F.count_if(F.col("status") == "COMPLETED"), F.count("*"), 1).alias("success_rate"))


def most_used_step(steps: DataFrame) -> DataFrame:
    return steps.groupBy("step_name").count().orderBy(F.desc("count"), "step_name").limit(1).select("step_name", F.col("count").alias("n"))


def job_texts(jobs: DataFrame, steps: DataFrame) -> DataFrame:
    """Each job's text for analysis: the first anonymising step's output, else the first extracting one's, else the original."""
    name = F.lower("step_name")
    found = lambda words: F.min_by(F.col("output_text"), F.when(name.rlike(words), F.struct("step_order", "output_text")))
    texts = steps.where("job_id is not null").groupBy("job_id").agg(found("pii|privacy|datenschutz|anonym").alias("_pii"), found("extraction|ocr|text").alias("_ocr"))
    return jobs.join(texts, "job_id", "left").select("job_id", F.coalesce("_pii", "_ocr", "original_text").alias("analysis_text"))


def job_success_by_day(jobs: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(F.col("status") == "COMPLETED")
    return jobs.groupBy(F.to_date("uploaded_at").cast("string").alias("day")).agg(n.alias("jobs"), ok.alias("completed"), percent(ok, n).alias("success_rate"))


def step_times(steps: DataFrame) -> DataFrame:
    value = lambda f, name: F.round(f("execution_time_seconds"), 2).alias(name)
    return steps.groupBy("step_name").agg(F.count("*").alias("n"), value(F.avg, "avg_seconds"), value(F.min, "min_seconds"), value(F.max, "max_seconds"))


def settings_statistics(settings: DataFrame) -> DataFrame:
    value = F.col("value")
    return settings.agg(
        F.count("*").alias("total"), F.count_if(F.col("key").like("enable_%")).alias("flags"), F.count_if(F.col("key").like("enable_%") & F.lower(value).isin("true", "1", "yes", "on")).alias("enabled"),
        F.count_if(F.lower(value).isin("true", "false")).alias("booleans"), F.count_if(value.rlike("^[0-9]+$")).alias("numbers"),
        percent(F.count_if(F.col("key").like("enable_%") & F.lower(value).isin("true", "1", "yes", "on")), F.count_if(F.col("key").like("enable_%")), 1).alias("adoption"),
    )


def import_settings(current: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Every key after an import with what happened to it: imported, updated, skipped or kept."""
    both = current.select("key", F.col("value").alias("_old")).join(incoming.select("key", F.col("value").alias("_new")), "key", "full")
    known, new = F.col("_old").isNotNull(), F.col("_new").isNotNull()
    what = F.when(new & ~known, "imported").when(new & known, "updated" if overwrite else "skipped").otherwise("kept")
    value = F.coalesce("_new", "_old") if overwrite else F.coalesce("_old", "_new")
    return both.select("key", value.alias("value"), what.alias("outcome"))


def user_statistics(users: DataFrame) -> DataFrame:
    admins = F.count_if(F.col("role") == "ADMIN")
    return users.agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"), admins.alias("admins"), (F.count("*") - admins).alias("users"), F.count_if(F.col("failed_login_attempts") >= 5).alias("locked"))


def step_statistics(steps: DataFrame) -> DataFrame:
    states = [F.count_if(F.col("status") == s).alias(s.lower()) for s in ("COMPLETED", "FAILED", "RUNNING", "PENDING", "SKIPPED", "TERMINATED", "CANCELLED", "QUEUED")]
    n, ok = F.count("*"), F.count_if(F.col("status") == "COMPLETED")
    return steps.agg(n.alias("total"), *states, ratio(ok, n, 4).alias("success_ratio"))


def latest_per(df: DataFrame, keys: list[str], time: str, tie: str) -> DataFrame:
    """Upsert by key: the row of greatest time (then tie) of each key, by an aggregate instead of a window."""
    row = F.struct(*df.columns)
    return df.groupBy(*keys).agg(F.max_by(row, F.struct(time, tie)).alias("_row")).select("_row.*")


def running_share(df: DataFrame, value: str, by: str) -> DataFrame:
    total = F.sum(value).over(Window.partitionBy(by))
    return df.withColumn("share", F.round(F.try_divide(F.col(value), total), 6))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)
