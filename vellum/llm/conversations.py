"""Conversation structure repair: backward cost-to-go over rows and grammar states, then a greedy forward walk.

A conversation's rows, by turn (nulls first), are faulty when blank, when a row of the same role and text came before, or
when the last character is no sentence end. The cheapest edits make the roles' initials `(s?(ua)+)?`: keep a row
(0), give it the role that the grammar wants (2), delete it (3; a must for blank and repeated rows), insert an
empty turn (2); a truncated row that stays adds 1. The cost-to-go of every (row, state) is computed from the
end; the walk from the start then takes the ASCII-least edit of those on which the cost-to-go holds with equality.
As a state admits one role (two at the start, told apart by the row), an edit's letter fixes the state after it.

How it is spread: texts stay out of the ordering. Rows become cells (conversation, turn, role, digest of role and
text, marks, number of equal rows); a cell is a repeat if an earlier cell has its digest, which a salted join with
the earliest turns tells. Cells are range-partitioned by (conversation, turn, role, digest), so a huge conversation lies in
many tasks, where numpy turns them into runs of one byte per row, with its counts. Runs and texts then meet, sorted, per
conversation: the runs come first, give the edits, and the texts stream past, edited and hashed. What a
task holds of a conversation is the byte per row of its runs, no more than its audit, which is one value of
the result; texts are never gathered. The digest over a conversation is sequential by its definition.

The cost-to-go, less its least entry, takes few distinct values, so both passes run over a memo of (value, kind
of row) and take well below a microsecond a row.

Edge cases: null ids, roles and texts are one space (a null id is a conversation of its own), null turns come first and
count for no gap; rows of equal turn are ordered by role, then by a digest of role and text; equal rows are repeats, but for the
first; a role other than those three is kept nowhere and can be rewritten; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import io
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import bound_batches, default_parallelism, materialize, spread_join, table

SPACE = " \t\n\x0b\f\r"
DROP, EMPTY, UNEND, REPEAT, REROLE = range(5)
#: What the edits cost.
KEEP_COST, RENAME_COST, DELETE_COST, INSERT_COST, TRUNCATED_COST = 0, 2, 3, 2, 1

#: Grammar states: nothing yet, after the system's turn, after a user's, after an assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: The turn that a state wants next; at the start a kept system turn is possible as well.
NEXT = (USER, USER, ASSISTANT, USER)
NAMES = {USER: "user", ASSISTANT: "assistant"}
#: Kinds of rows, one byte each: 1 must go; else 2 + 2 * (place of the initial in INITIALS, 3 for others) + truncated.
GONE = 1
INITIALS = "sua"
#: Bits beside the kind: blank, repeated.
BLANK, SEEN = 16, 32


def damage(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) with the faults that crc32 of `conv_id:turn` modulo 20 deals: 0 drops the row,
    1 empties the text, 2 takes out `[.!?]`, 3 repeats the row, 4 makes the role user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn")).cast("binary")) % 20
    text = F.when(fault == EMPTY, "").when(fault == UNEND, F.translate(name("text"), ".!?", "")).otherwise(name("text"))
    kept = rows.select("conv_id", "turn", fault.alias("fault"), F.when(fault == REROLE, "user").otherwise(name("role")).alias("role"), text.alias("text"))
    return kept.where(F.col("fault") != DROP).select("conv_id", "turn", "role", "text", F.explode(F.array_repeat(F.lit(0), F.when(F.col("fault") == REPEAT, 2).otherwise(1))).alias("copy")).drop("copy")


def _named(rows: DataFrame) -> DataFrame:
    """Rows with the columns of their order: key (null ids as a space) and digest."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), name("role").alias("role"), name("text").alias("text"))
    digest = F.unhex(F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text").cast("binary")))
    return rows.withColumns({"key": F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), "digest": digest})


def _last(text: Column) -> Column:
    """The last character that is no white space; empty if there is none."""
    return F.right(F.rtrim(text, F.lit(SPACE)), F.lit(1))


def cells(named: DataFrame) -> DataFrame:
    """Distinct (key, turn, role, digest) with the number of equal rows, the marks of the text and whether an earlier row has the digest."""
    last = _last(F.col("text"))
    slim = named.select("key", "turn", "role", "digest", (last == "").alias("blank"), (~last.isin(".", "!", "?")).alias("open"))
    slim = slim.groupBy("key", "turn", "role", "digest", "blank", "open").agg(F.count("*").alias("n"))
    slim = slim.withColumns({"both": F.concat(F.col("key").cast("binary"), F.lit(":").cast("binary"), "digest"), "place": F.struct(F.col("turn").isNotNull(), "turn")})
    first = slim.groupBy("both").agg(F.min("place").alias("first"))
    return spread_join(slim, first, "both", "turn").select("key", "turn", "role", "digest", "blank", "open", "n", (F.col("place") != F.col("first")).alias("seen"))


RUNS = "key string, seq long, kinds binary, low long, high long, turns long"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted cells -> one row per conversation and batch: a byte per row, the turns' range, how many are distinct."""
    part, seq = TaskContext.get().partitionId(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        n = batch.column("n").to_numpy()
        blank, opened, seen = (batch.column(c).to_numpy(zero_copy_only=False).astype(bool) for c in ("blank", "open", "seen"))
        role = np.array([INITIALS.find(r[:1]) if r else -1 for r in batch.column("role").to_pylist()])
        role[role < 0] = 3
        gone = blank | seen
        kind = np.where(gone, GONE, 2 + 2 * role + opened).astype(np.uint8)
        kind |= np.where(blank, BLANK, np.where(seen, SEEN, 0)).astype(np.uint8)
        again = np.where(blank, GONE | BLANK, GONE | SEEN).astype(np.uint8)
        # the initials are needed beside the kinds of rows that go, for pairs of neighbours
        both = np.stack((kind | (role << 6).astype(np.uint8), again | (role << 6).astype(np.uint8)), 1)
        keys = batch.column("key").to_pylist()
        cut = [0] + [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]] + [len(keys)]
        turns = batch.column("turn").to_pylist()
        out: list[list] = [[] for _ in range(6)]
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            many = n[a:b]
            kinds = both[a:b, 0] if (many == 1).all() else np.repeat(both[a:b].ravel(), np.stack((np.ones_like(many), many - 1), 1).ravel())
            known = [t for t in turns[a:b] if t is not None]
            for column, value in zip(out, (keys[a], (part << 32) + seq, kinds.tobytes(), known[0] if known else None, known[-1] if known else None, len(set(known))), strict=True):
                column.append(value)
            seq += 1
        types = (pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], [f.split()[0] for f in RUNS.split(", ")])


def runs(found: DataFrame) -> DataFrame:
    """Cells in order as runs of bytes, a huge conversation's in several tasks."""
    order = [F.col("key"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("digest")]
    spread = found.repartitionByRange(default_parallelism(found.sparkSession), *order)
    return spread.sortWithinPartitions(*order).mapInArrow(_runs, RUNS)


@lru_cache(1 << 16)
def _behind(costs: tuple[int, ...], kind: int) -> tuple[tuple[int, ...], int]:
    """The cost-to-go before a row of this kind from the one behind it, as (entries less their least, that least)."""
    ways = []
    for state in range(4):
        least = DELETE_COST + costs[state]
        if kind != GONE:
            more = TRUNCATED_COST * (kind & 1)
            least = min(least, RENAME_COST + more + costs[NEXT[state]])
            kept = _kept(state, kind)
            if kept is not None:
                least = min(least, KEEP_COST + more + costs[kept])
        ways.append(least)
    return _inserted(ways)


def _inserted(ways: list[int]) -> tuple[tuple[int, ...], int]:
    for _ in range(3):
        ways = [min(c, INSERT_COST + ways[NEXT[s]]) for s, c in enumerate(ways)]
    low = min(ways)
    return tuple(c - low for c in ways), low


def _kept(state: int, kind: int) -> int | None:
    """The state after keeping the row, None where the grammar forbids it."""
    role = (kind - 2) >> 1
    if role == 0:
        return SYSTEM if state == START else None
    return role + 1 if role < 3 and role + 1 == NEXT[state] else None


#: The cost-to-go at the end: nothing at the start or after an assistant's turn, insertions elsewhere.
_FAR = 1 << 20
END = _inserted([0, _FAR, _FAR, 0])


@lru_cache(1 << 16)
def _taken(state: int, kind: int, before: tuple[int, ...], low: int, behind: tuple[int, ...]) -> tuple[str, int]:
    """The ASCII-least tight edits from a state until the row is consumed: their letters and the state behind.

    `before` is the cost-to-go before the row and `behind` behind it, both relative, low the difference of their least entries."""
    letters = ""
    while True:
        left = before[state] + low
        if left == DELETE_COST + behind[state]:
            return letters + "D", state
        if before[state] == INSERT_COST + before[NEXT[state]]:
            letters, state = letters + "I", NEXT[state]
            continue
        more = TRUNCATED_COST * (kind & 1)
        kept = _kept(state, kind)
        if kept is not None and left == KEEP_COST + more + behind[kept]:
            return letters + "K", kept
        return letters + "R", NEXT[state]


def cheapest(kinds: bytes) -> tuple[int, str]:
    """The least cost of repairing rows of these kinds, and the ASCII-least cheapest edits."""
    costs, total = END
    numbers, values, behind = {costs: 0}, [costs], array("H")
    for kind in reversed(kinds):
        behind.append(numbers[costs])
        costs, low = _behind(costs, kind)
        total += low
        if costs not in numbers:
            numbers[costs] = len(values)
            values.append(costs)
    letters, state, before = io.StringIO(), START, costs
    for kind in kinds:
        after = values[behind.pop()]
        some, state = _taken(state, kind, before, _behind(after, kind)[1], after)
        letters.write(some)
        before = after
    while before[state]:
        letters.write("I")
        state = NEXT[state]
    return total + costs[START], letters.getvalue()


class Conversation:
    """What a task keeps of one conversation: its counts, its edits, a running digest."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.parts = conv_id, []
        self.low = self.high = self.last = None
        self.turns = 0
        self.audit: str | None = None

    def add(self, kinds: bytes, low, high, turns: int) -> None:
        """The next run; a turn that goes on from the run before counts once."""
        self.parts.append(kinds)
        if turns:
            self.turns += turns - (self.high is not None and self.high == low)
            self.low = low if self.low is None else self.low
            self.high = high

    def decide(self) -> None:
        raw = np.frombuffer(b"".join(self.parts), np.uint8)
        self.parts = []
        role = raw >> 6
        fine = [0 * 4 + 1, 1 * 4 + 2, 2 * 4 + 1]
        self.illegal = int(np.count_nonzero(~np.isin(role[:-1] * 4 + role[1:], fine))) if len(raw) > 1 else 0
        self.blank, self.seen = int(np.count_nonzero(raw & BLANK)), int(np.count_nonzero(raw & SEEN))
        kinds = raw & 15
        self.truncated = int(np.count_nonzero((kinds != GONE) & (kinds % 2 == 1)))
        self.cost, self.audit = cheapest(kinds.tobytes())
        self.gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        self.at, self.state, self.done, self.hash, self.filled = 0, START, 0, hashlib.sha256(), False

    def _emit(self, role: str, text: str, out: list | None) -> None:
        if self.filled:
            self.hash.update(b"\n")
        self.filled = True
        self.hash.update(f"{role}:{text}".encode())
        if out is not None:
            out.append((self.conv_id, self.done, role, text))
        self.done += 1

    def _insert(self, out: list | None) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            self.state = NEXT[self.state]
            self._emit(NAMES[self.state], "", out)

    def pass_row(self, role: str, text: str, out: list | None) -> None:
        """One row of the damaged conversation, edited as the audit says."""
        self._insert(out)
        edit = self.audit[self.at]
        self.at += 1
        if edit == "D":
            return
        if edit == "R":
            self.state = NEXT[self.state]
            role = NAMES[self.state]
        else:
            self.state = SYSTEM if role[0] == "s" else NEXT[self.state]
        self._emit(role, text, out)

    def result(self, out: list | None) -> tuple:
        self._insert(out)
        return (self.conv_id, self.gaps, self.blank, self.seen, self.truncated, self.illegal, self.cost, self.audit, self.hash.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
TURNS = "conv_id long, position long, role string, text string"


def _repair(turns: bool):
    names = [f.split()[0] for f in (TURNS if turns else REPORT).split(", ")]
    types = [{"long": pa.int64(), "string": pa.string()}[f.split()[1]] for f in (TURNS if turns else REPORT).split(", ")]

    def rows(found: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, now, reports = None, None, []
        for batch in batches:
            edited: list | None = [] if turns else None
            columns = [batch.column(c).to_pylist() for c in ("key", "conv_id", "step", "kinds", "low", "high", "turns", "role", "text")]
            for k, conv_id, step, kinds, low, high, distinct, role, text in zip(*columns, strict=True):
                if k != key or now is None:
                    if now is not None:
                        _close(now, edited, reports)
                    key, now = k, Conversation(conv_id)
                if step == 0:
                    now.conv_id = conv_id
                elif step == 1:
                    now.add(kinds, low, high, distinct)
                else:
                    if now.audit is None:
                        now.decide()
                    now.pass_row(role, text, edited)
            if turns and edited:
                yield rows(edited)
            elif not turns and reports:
                yield rows(reports)
            reports = []
        if now is not None:
            edited = [] if turns else None
            _close(now, edited, reports)
            if edited if turns else reports:
                yield rows(edited if turns else reports)

    return run


def _close(now: Conversation, edited: list | None, reports: list) -> None:
    if now.audit is None:
        now.decide()
    reports.append(now.result(edited))


def repair(rows: DataFrame, ids: DataFrame | None = None, turns: bool = False) -> DataFrame:
    """conversations(conv_id, turn, role, text) -> a row of `REPORT` per conversation, or with `turns` the repaired turns (`TURNS`).

    `ids` names conversations that are reported even where they have no rows left."""
    bound_batches(rows.sparkSession)
    named = _named(rows)
    found = materialize(cells(named), "cells")
    none = lambda **kinds: [F.lit(None).cast(kind).alias(name) for name, kind in kinds.items()]
    order = none(turn="long", digest="binary")
    every = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct() if ids is not None else named.select("conv_id").distinct()
    heads = every.select(
        F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")).alias("key"), "conv_id", F.lit(0).alias("step"), F.lit(0).cast("long").alias("seq"), *none(kinds="binary", low="long", high="long", turns="long", role="string", text="string"), *order
    )
    middle = runs(found).select("key", F.lit(None).cast("long").alias("conv_id"), F.lit(1).alias("step"), "seq", "kinds", "low", "high", "turns", *none(role="string", text="string"), *order)
    texts = named.select("key", "conv_id", F.lit(2).alias("step"), F.lit(0).cast("long").alias("seq"), *none(kinds="binary", low="long", high="long", turns="long"), "role", "text", "turn", "digest")
    together = heads.unionByName(middle).unionByName(texts).repartition(default_parallelism(rows.sparkSession), "key")
    together = together.sortWithinPartitions("key", "step", "seq", F.col("turn").asc_nulls_first(), "role", "digest")
    return together.mapInArrow(_repair(turns), TURNS if turns else REPORT)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "conversations")
    return repair(damage(found), found.select("conv_id"))


QUERIES = {"op11_repair": op11_repair}
