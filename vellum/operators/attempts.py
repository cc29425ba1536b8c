"""The attempts of steps that are retried: one row per attempt with its outcome and the wait behind it.

steps(id..., failures, error, max_retries, retry_on_failure): a step fails `failures` times before it would work. Without
retries it has one attempt. After a failed attempt n that is not the last, an unavailable service (503 in the error) is waited for 5 n
seconds, anything else n seconds.

Edge cases: null failures are none, null or smaller max_retries are one attempt; a null error is no 503.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNAVAILABLE_WAIT, OTHER_WAIT = 5, 1


def attempts(steps: DataFrame) -> DataFrame:
    """Every attempt: the step's columns, attempt, outcome (failed or ok), wait, status of the step."""
    allowed = F.when(F.coalesce("retry_on_failure", F.lit(False)), F.greatest(F.coalesce("max_retries", F.lit(1)), F.lit(1))).otherwise(1)
    failures = F.coalesce("failures", F.lit(0))
    rows = steps.withColumns({"_allowed": allowed, "_failures": failures}).withColumn("attempt", F.explode(F.sequence(F.lit(1), F.least(F.col("_failures") + 1, F.col("_allowed")))))
    failed = F.col("attempt") <= F.col("_failures")
    unit = F.when(F.contains(F.coalesce("error", F.lit("")), F.lit("503")), UNAVAILABLE_WAIT).otherwise(OTHER_WAIT)
    return rows.withColumns(
        {
            "outcome": F.when(failed, "failed").otherwise("ok"),
            "wait": F.when(failed & (F.col("attempt") < F.col("_allowed")), unit * F.col("attempt")).otherwise(0),
            "status": F.when(F.col("_failures") < F.col("_allowed"), "COMPLETED").otherwise("FAILED"),
        }
    ).drop("_allowed", "_failures")


def summary(log: DataFrame, *keys: str) -> DataFrame:
    """Per key: steps, attempts, seconds waited, steps failed and the most attempts of one."""
    return log.groupBy(*keys).agg(
        F.count_if(F.col("attempt") == 1).alias("steps"), F.count("*").alias("attempts"), F.sum("wait").cast("long").alias("waited"), F.count_if((F.col("attempt") == 1) & (F.col("status") == "FAILED")).alias("failed"), F.max("attempt").cast("long").alias("most")
    )


def matched(left: DataFrame, array: str, right: DataFrame, key: str) -> DataFrame:
    """Rows of left and right whose key is a member of the array, with its place in it (from 1; the first of repeats): a theta join as explode and equi-join."""
    members = left.withColumn("_members", F.array_distinct(F.filter(array, lambda x: x.isNotNull()))).select("*", F.explode("_members").alias(key)).drop("_members")
    return members.join(right, key).withColumn("position", F.array_position(array, F.col(key)))
