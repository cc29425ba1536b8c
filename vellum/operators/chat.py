"""Usage and latency statistics over chat logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.filters import on_day, percent


def _is(status: str) -> Column:
    return F.col("status") == status


def _mean_ok(column: str) -> Column:
    return F.coalesce(F.round(F.avg(F.when(_is("success"), F.col(column))), 2), F.lit(0.0))


def overview(logs: DataFrame) -> DataFrame:
    n, ok = F.count("*"), F.count_if(_is("success"))
    return logs.agg(
        n.alias("requests"), ok.alias("successes"), F.count_if(_is("error")).alias("errors"), F.count_if(_is("rate_limited")).alias("rate_limited"),
        F.coalesce(F.sum("total_tokens"), F.lit(0)).cast("long").alias("tokens"), F.coalesce(F.round(F.sum("cost_usd"), 6), F.lit(0.0)).alias("cost"),
        _mean_ok("response_time_ms").alias("avg_response_ms"), _mean_ok("first_token_time_ms").alias("avg_first_token_ms"), percent(ok, n).alias("success_rate"),
    )


def _rollup(logs: DataFrame, key: Column) -> DataFrame:
    n, ok = F.count("*"), F.count_if(_is("success"))
    return logs.groupBy(key).agg(
        n.alias("requests"), ok.alias("successes"), F.count_if(_is("error")).alias("errors"), F.count_if(_is("rate_limited")).alias("rate_limited"),
        F.sum("total_tokens").cast("long").alias("tokens"), F.round(F.sum("cost_usd"), 6).alias("cost"), percent(ok, n).alias("success_rate"),
    )


def daily(logs: DataFrame) -> DataFrame:
    return _rollup(logs, F.to_date("created_at").cast("string").alias("day"))


def hourly(logs: DataFrame, day: str) -> DataFrame:
    """One row per hour of a day that has requests."""
    return _rollup(on_day(logs, day), F.hour("created_at").alias("hour"))


def cost_by_app(logs: DataFrame) -> DataFrame:
    """Cost per app with prompt and completion tokens, and the total as a row of its own."""
    return logs.rollup("app_id").agg(
        F.grouping("app_id").cast("int").alias("is_total"), F.round(F.sum("cost_usd"), 6).alias("cost"), F.sum("prompt_tokens").cast("long").alias("prompt_tokens"), F.sum("completion_tokens").cast("long").alias("completion_tokens"), F.count("*").alias("requests")
    )


def error_breakdown(logs: DataFrame) -> DataFrame:
    """Rows per status, and per error type of what is no success."""
    by_status = logs.groupBy(F.lit("status").alias("kind"), F.col("status").alias("name")).count()
    failed = logs.where(~_is("success") & F.col("error_type").isNotNull())
    return by_status.union(failed.groupBy(F.lit("error_type").alias("kind"), F.col("error_type").alias("name")).count())


def index_percentiles(logs: DataFrame, column: str, quantiles: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """sorted[int(n * q)] of the successes' values, by value counts instead of one sorted list.

    Counts per distinct value are added up in order; a value answers a quantile whose place falls into its run.
    There are as many counts as distinct values; none is rounded.
    """
    from pyspark.sql import Window

    rows = logs.where(_is("success") & F.col(column).isNotNull()).select(F.col(column).alias("v"))
    counts = rows.groupBy("v").agg(F.count("*").alias("n"))
    bucket = F.floor(F.col("v"))
    totals = counts.groupBy(bucket.alias("b")).agg(F.sum("n").alias("bn"))
    before = totals.withColumn("before", F.coalesce(F.sum("bn").over(Window.orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("total", F.sum("bn").over(Window.partitionBy()))
    placed = counts.withColumn("b", bucket).join(before, "b")
    inner = Window.partitionBy("b").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("lo", F.col("before") + F.coalesce(F.sum("n").over(inner), F.lit(0)))
    at = lambda q: F.floor(F.col("total") * F.lit(q)).cast("long")
    hit = lambda q: F.max(F.when((at(q) >= F.col("lo")) & (at(q) < F.col("lo") + F.col("n")), F.col("v")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return placed.agg(*[zero(hit(q)).alias(f"p{int(q * 100)}") for q in quantiles], zero(F.min("v")).alias("least"), zero(F.max("v")).alias("greatest"), F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))


def distinct_users(logs: DataFrame) -> DataFrame:
    return logs.agg(F.count_distinct("ip_address_hash").alias("users"))


def query_metadata(rows: DataFrame, column: str) -> DataFrame:
    """Characters, white-space separated words and a hash of each query; the text isn't kept."""
    words = F.size(F.filter(F.split(F.coalesce(column, F.lit("")), r"\s+"), lambda x: x != ""))
    return rows.withColumns({"query_length": F.length(F.coalesce(column, F.lit(""))).cast("long"), "query_words": words.cast("long"), "query_hash": F.sha2(F.coalesce(column, F.lit("")), 256)}).drop(column)
