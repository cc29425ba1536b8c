"""Queries of the step program, the rate limiter and streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import redaction
from vellum.plans import steps
from vellum.sources.overlays import spread
from vellum.streaming import limits

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Low limits, so that the driver's sparse events meet them.
LOW = (1, 2, 3)


def _events(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("key"), "event_id", "ts")


QUERIES["r1_windows"] = lambda spark, d: limits.limited(_events(spark, d), LOW, bans=False).select("key", "event_id", "outcome")
QUERIES["r3_bans"] = lambda spark, d: limits.limited(_events(spark, d), LOW).select("key", "event_id", "outcome", "retry_after", "violations")
ORACLE_SQL["r1_windows"] = """
WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS key, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT key, rn, event_id, ts AS ms, ts AS hs, ts AS ds, 1 AS mc, 1 AS hc, 1 AS dc, 'allowed' AS outcome FROM e WHERE rn = 1
  UNION ALL
  SELECT key, rn, event_id, ms, hs, ds, mc + ok, hc + ok, dc + ok, outcome FROM (
    SELECT *, CASE WHEN mc >= 1 THEN 'minute' WHEN hc >= 2 THEN 'hour' WHEN dc >= 3 THEN 'day' ELSE 'allowed' END AS outcome,
           CASE WHEN mc >= 1 OR hc >= 2 OR dc >= 3 THEN 0 ELSE 1 END AS ok
    FROM (
      SELECT e.key, e.rn, e.event_id,
             CASE WHEN e.ts - ms >= INTERVAL 1 MINUTE THEN e.ts ELSE ms END AS ms, CASE WHEN e.ts - ms >= INTERVAL 1 MINUTE THEN 0 ELSE mc END AS mc,
             CASE WHEN e.ts - hs >= INTERVAL 1 HOUR THEN e.ts ELSE hs END AS hs, CASE WHEN e.ts - hs >= INTERVAL 1 HOUR THEN 0 ELSE hc END AS hc,
             CASE WHEN e.ts - ds >= INTERVAL 24 HOUR THEN e.ts ELSE ds END AS ds, CASE WHEN e.ts - ds >= INTERVAL 24 HOUR THEN 0 ELSE dc END AS dc
      FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)))
SELECT key, event_id, outcome FROM w"""

#: The same with the penalties: a ban leaves the state as it is, a violation counts, fades and sets the ban's end.
_MOVED = ", ".join(f"CASE WHEN banned = '' AND t - {c}s >= {w} THEN t ELSE {c}s END AS {c}s, CASE WHEN banned = '' AND t - {c}s >= {w} THEN 0 ELSE {c}c END AS {c}c" for c, w in zip("mhd", limits.WINDOWS, strict=True))
_MINUTES = "CASE " + " ".join(f"WHEN n >= {least} THEN {minutes}" for least, minutes in limits.PENALTIES) + " ELSE 0 END"
ORACLE_SQL["r3_bans"] = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT CAST(user_id AS VARCHAR) AS key, event_id, epoch(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events),
w AS (
  SELECT key, rn, event_id, t AS ms, t AS hs, t AS ds, 1 AS mc, 1 AS hc, 1 AS dc, CAST(0 AS BIGINT) AS violations, 0.0::DOUBLE AS last, 0.0::DOUBLE AS until, 'allowed' AS outcome, CAST(0 AS BIGINT) AS retry_after FROM e WHERE rn = 1
  UNION ALL
  SELECT key, rn, event_id, ms, hs, ds, mc + ok, hc + ok, dc + ok, CASE WHEN hit THEN n ELSE violations END, CASE WHEN hit THEN t ELSE last END,
         CASE WHEN NOT hit OR {_MINUTES} = 0 THEN until WHEN {_MINUTES} < 0 THEN -1 ELSE t + 60.0 * {_MINUTES} END, outcome,
         CAST(trunc(CASE outcome WHEN 'temp_ban' THEN until - t WHEN 'minute' THEN ms + 60 - t WHEN 'hour' THEN hs + 3600 - t WHEN 'day' THEN ds + 86400 - t ELSE 0 END) AS BIGINT)
  FROM (
    SELECT *, outcome IN ('minute', 'hour', 'day') AS hit, CASE WHEN outcome = 'allowed' THEN 1 ELSE 0 END AS ok,
           greatest(0, violations - greatest(0, CASE WHEN violations > 0 THEN CAST(floor((t - last) / 86400) AS BIGINT) ELSE 0 END - {limits.DECAY_AFTER_DAYS})) + 1 AS n
    FROM (
      SELECT *, CASE WHEN banned <> '' THEN banned WHEN mc >= {LOW[0]} THEN 'minute' WHEN hc >= {LOW[1]} THEN 'hour' WHEN dc >= {LOW[2]} THEN 'day' ELSE 'allowed' END AS outcome
      FROM (
        SELECT key, rn, event_id, t, banned, {_MOVED}, violations, last, until
        FROM (SELECT e.*, ms, hs, ds, mc, hc, dc, violations, last, until, CASE WHEN until < 0 THEN 'permanent_ban' WHEN until > t THEN 'temp_ban' ELSE '' END AS banned FROM w JOIN e ON e.key = w.key AND e.rn = w.rn + 1)))))
SELECT key, event_id, outcome, retry_after, violations FROM w"""


def _letters(spark: SparkSession, d: str) -> DataFrame:
    docs = spread(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text", "source"))
    return steps.run(docs, steps.LETTERS, "en", ("source",))


QUERIES["d2_step_program"] = lambda spark, d: _letters(spark, d).select("doc_id", F.md5("output").alias("output_md5"), "document_class", "status", "stopped_at", F.size("log").cast("long").alias("n_steps"))
QUERIES["d7_step_log"] = lambda spark, d: steps.step_log(_letters(spark, d)).groupBy("step", "status").agg(F.count("*").alias("n"))


def _redacted() -> str:
    text = "text"
    for _, pattern, placeholder in redaction.CONTACTS:
        text = f"regexp_replace({text}, '{pattern}', '{placeholder}', 'g')"
    return text


_RAN = f"""
WITH a AS (SELECT doc_id, text, length(text) < 40 AS stopped, {_redacted()} AS r FROM documents),
b AS (SELECT *, length(r) > 4000 AS long FROM a),
c AS (SELECT *, CASE WHEN stopped THEN text WHEN long THEN array_to_string(string_split(r, ' ')[1:20], ' ') ELSE lower(r) END AS t FROM b)
"""
ORACLE_SQL["d2_step_program"] = _RAN + r"SELECT doc_id, md5(CASE WHEN stopped THEN text ELSE trim(regexp_replace(t, '[ \t\n\x0B\f\r]+', ' ', 'g')) END) AS output_md5, CASE WHEN NOT stopped THEN CASE WHEN long THEN 'LANG' ELSE 'KURZ' END END AS document_class, CASE WHEN stopped THEN 'TERMINATED' ELSE 'COMPLETED' END AS status, CASE WHEN stopped THEN 'gate' END AS stopped_at, CAST(CASE WHEN stopped THEN 1 ELSE 7 END AS BIGINT) AS n_steps FROM c"
ORACLE_SQL["d7_step_log"] = (
    _RAN
    + """SELECT step, status, count(*) AS n FROM (
  SELECT 'gate' AS step, CASE WHEN stopped THEN 'TERMINATED' ELSE 'COMPLETED' END AS status FROM c
  UNION ALL SELECT unnest(['redact', 'classify', CASE WHEN long THEN 'shorten' ELSE 'soften' END, 'with source', 'tidy']), 'COMPLETED' FROM c WHERE NOT stopped
  UNION ALL SELECT 'with nothing', 'SKIPPED' FROM c WHERE NOT stopped) GROUP BY 1, 2"""
)


def _shared(spark: SparkSession) -> str:
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = f"file://{tempfile.mkdtemp()}"
    return found.rstrip("/")


def replayed(spark: SparkSession, stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there and returns the rows that it wrote, or its last result."""
    path = f"{_shared(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", path + "-log").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    else:
        write = lambda df, _: df.write.mode("overwrite").parquet(path)
        stream.writeStream.foreachBatch(write).option("checkpointLocation", path + "-log").outputMode(mode).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path)


def _stream(spark: SparkSession, d: str) -> DataFrame:
    schema = spark.read.parquet(f"{d}/events.parquet").schema
    return spark.readStream.schema(schema).parquet(f"{d}/events*.parquet")


QUERIES["g8_daily_stream"] = lambda spark, d: replayed(spark, limits.daily_stream(_stream(spark, d)), "complete").select(F.to_date("day").cast("string").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))
ORACLE_SQL["g8_daily_stream"] = "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"
QUERIES["r1_windows_stream"] = lambda spark, d: replayed(spark, limits.limited_stream(_stream(spark, d).select(F.col("user_id").alias("key"), "event_id", "ts"), LOW, bans=False), "append").select("key", "event_id", "outcome")
ORACLE_SQL["r1_windows_stream"] = ORACLE_SQL["r1_windows"]
