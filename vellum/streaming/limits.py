"""Rate limits with windows that start at the first message after the last one ended, and escalating bans.

The rule is sequential per key. In batch, rows are partitioned and sorted by key and time, and a task
walks through them with one key's state in hand; as a stream, the same step runs on keyed state.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOWS = (60, 3_600, 86_400)
LIMITS = (10, 50, 200)
NAMES = ("minute", "hour", "day")
# Violations from which a penalty holds, and minutes of ban (0: warning, -1: for good).
PENALTIES = ((51, -1), (21, 1_440), (11, 60), (6, 15), (3, 0))
DECAY_AFTER_DAYS = 7


@dataclass
class State:
    """What a key carries on: window starts, counts, violations, the end of a ban (-1: for good)."""

    starts: tuple[float, ...] = (-1.0, -1.0, -1.0)
    counts: tuple[int, ...] = (0, 0, 0)
    violations: int = 0
    last_violation: float = 0.0
    banned_until: float = 0.0


def step(state: State, now: float, limits: tuple[int, ...] = LIMITS, bans: bool = True) -> tuple[State, str, int]:
    """A message at a time in seconds: the new state, the outcome, and seconds to wait."""
    if bans and state.banned_until < 0:
        return state, "permanent_ban", 0
    if bans and state.banned_until > now:
        return state, "temp_ban", int(state.banned_until - now)
    fresh = [s < 0 or now - s >= w for s, w in zip(state.starts, WINDOWS, strict=True)]
    starts = tuple(now if f else s for f, s in zip(fresh, state.starts, strict=True))
    counts = tuple(0 if f else c for f, c in zip(fresh, state.counts, strict=True))
    for name, start, count, limit, window in zip(NAMES, starts, counts, limits, WINDOWS, strict=True):
        if count >= limit:
            kept = State(starts, counts, state.violations, state.last_violation, state.banned_until)
            return (violated(kept, now) if bans else kept), name, int(start + window - now)
    return State(starts, tuple(c + 1 for c in counts), state.violations, state.last_violation, state.banned_until), "allowed", 0


def violated(state: State, now: float) -> State:
    """Counts a violation, those older than a week fading by one a day, and applies the penalty."""
    days = int((now - state.last_violation) // 86_400) if state.violations else 0
    n = max(0, state.violations - max(0, days - DECAY_AFTER_DAYS)) + 1
    minutes = next((m for least, m in PENALTIES if n >= least), None)
    until = state.banned_until if not minutes else -1.0 if minutes < 0 else now + 60.0 * minutes
    return State(state.starts, state.counts, n, now, until)


OUT = "key string, event_id long, ts timestamp, outcome string, retry_after long, violations long"


def _row(key: str, event_id: int, ts, state: State, outcome: str, wait: int) -> tuple:
    return key, event_id, ts, outcome, wait, state.violations


def limited(events: DataFrame, limits: tuple[int, ...] = LIMITS, bans: bool = True) -> DataFrame:
    """events(key, event_id, ts) -> every message's outcome, in order of time (then id) per key."""
    columns = [c.split()[0] for c in OUT.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last, state = None, State()
        for batch in batches:
            rows = []
            for key, event_id, ts in zip(batch["key"], batch["event_id"], batch["ts"], strict=True):
                if key != last:
                    last, state = key, State()
                state, outcome, wait = step(state, ts.timestamp(), limits, bans)
                rows.append(_row(key, event_id, ts, state, outcome, wait))
            yield pd.DataFrame(rows, columns=columns)

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.repartition("key").sortWithinPartitions("key", "ts", "event_id").mapInPandas(walk, OUT)


#: Messages of a key that leave a stream's update at a time.
PART_ROWS = 10_000
STATE = "starts array<double>, counts array<long>, violations long, last_violation double, banned_until double"


def limited_stream(events: DataFrame, limits: tuple[int, ...] = LIMITS, bans: bool = True) -> DataFrame:
    """The same over a stream of events: a micro-batch's messages of a key are taken in order of time."""
    columns = [c.split()[0] for c in OUT.split(", ")]

    def update(key, batches, held):
        state = State(*[tuple(x) if isinstance(x, (list, tuple)) or hasattr(x, "tolist") else x for x in held.get]) if held.exists else State()
        # of a key's messages only time and id are held, sixteen bytes each, as order counts over all batches; results leave in parts
        parts = [(b["ts"].to_numpy("datetime64[ns]"), b["event_id"].to_numpy("int64")) for b in batches]
        times, ids = np.concatenate([t for t, _ in parts]), np.concatenate([i for _, i in parts])
        order = np.lexsort((ids, times))
        for at in range(0, len(order), PART_ROWS):
            rows = []
            for i in order[at : at + PART_ROWS].tolist():
                ts = pd.Timestamp(times[i])
                state, outcome, wait = step(state, ts.timestamp(), limits, bans)
                rows.append(_row(key[0], int(ids[i]), ts, state, outcome, wait))
            yield pd.DataFrame(rows, columns=columns)
        starts, counts, *rest = astuple(state)
        held.update((list(starts), [int(c) for c in counts], *rest))

    rows = events.select(F.col("key").cast("string").alias("key"), F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("timestamp").alias("ts"))
    return rows.groupBy("key").applyInPandasWithState(update, OUT, STATE, "append", "NoTimeout")


def daily_stream(events: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Events per day and type of a stream, late ones within the delay included."""
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    counts = rows.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return counts.select(F.col("window.start").alias("day"), "event_type", "n", "total")


def progress_stream(updates: DataFrame) -> DataFrame:
    """Each document's latest state of a stream of (doc, seq, state)."""
    return updates.groupBy("doc").agg(F.max_by("state", "seq").alias("state"), F.max("seq").alias("seq"))


def breaker(failures: DataFrame, key: str = "key", order: str = "seq", threshold: int = 5) -> DataFrame:
    """Per key the runs of failures that would open a breaker: gaps and islands over (ok, order)."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    runs = failures.withColumn("_island", F.sum(F.col("ok").cast("int")).over(w)).where(~F.col("ok"))
    return runs.groupBy(key, "_island").agg(F.count("*").alias("failures"), F.min(order).alias("first")).where(F.col("failures") >= threshold).drop("_island")
