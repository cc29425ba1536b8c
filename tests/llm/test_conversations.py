"""Conversation repair against a search over all edits, on the smallest table, made-up conversations and edge rows."""

import hashlib
import heapq
import itertools
import random
import zlib

import pytest
from pyspark.sql import functions as F

from vellum.llm import common, conversations

SPACE = " \t\n\x0b\f\r"
FIELDS = "conv_id long, turn long, role string, text string"


def damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        fault = zlib.crc32(f"{name(conv_id)}:{name(turn)}".encode()) % 20
        role, text = name(role), name(text)
        if fault == 0:
            continue
        text = "" if fault == 1 else text.translate({ord(c): None for c in ".!?"}) if fault == 2 else text
        out += [(conv_id, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def after(state, role):
    """The grammar's state after a role's initial, None where it forbids it."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, role))


def searched(rows):
    """Dijkstra over (row, state) by (cost, audit): no cost-to-go, no greedy walk."""
    seen, faults = set(), []
    for _, role, text in rows:
        faults.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    heap, settled = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, at, state, made = heapq.heappop(heap)
        if at == len(rows) and state in ("", "a"):
            break
        if (at, state) in settled:
            continue
        settled.add((at, state))
        for name in ("user", "assistant"):
            if (to := after(state, name[0])) is not None:
                heapq.heappush(heap, (cost + 2, audit + "I", at, to, (*made, f"{name}:")))
                if at < len(rows) and faults[at] in ("", "truncated"):
                    heapq.heappush(heap, (cost + 2 + (faults[at] != ""), audit + "R", at + 1, to, (*made, f"{name}:{rows[at][2]}")))
        if at < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, state, made))
            if faults[at] in ("", "truncated") and (to := after(state, rows[at][1][:1])) is not None:
                heapq.heappush(heap, (cost + (faults[at] != ""), audit + "K", at + 1, to, (*made, f"{rows[at][1]}:{rows[at][2]}")))
    turns = [r[0] for r in rows if r[0] is not None]
    return {
        "gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
        **{k: faults.count(k) for k in ("blank", "duplicate", "truncated")},
        "illegal": sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows)),
        "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(made).encode()).hexdigest(),
    }


def digest(role, text):
    return hashlib.md5(f"{len(role)}:{role}{text}".encode()).digest()


def expected(rows, ids):
    groups = {i: [] for i in ids}
    for conv_id, turn, role, text in rows:
        groups[conv_id].append((turn, " " if role is None else role, " " if text is None else text))
    for group in groups.values():
        group.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), digest(r[1], r[2])))
    return {i: searched(group) for i, group in groups.items()}


def compared(found, want):
    got = {r.conv_id: r.asDict() for r in found.collect()}
    assert got.keys() == want.keys()
    for i, row in want.items():
        assert {k: got[i][k] for k in row} == row, i


def test_query_against_search(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").collect()]
    found = conversations.op11_repair(spark, sf)
    assert found.count() == len({r[0] for r in rows})
    compared(found, expected(damaged(rows), {r[0] for r in rows}))


def test_damage(spark):
    rows = [(i // 8, i % 8 if i % 11 else None, "assistant" if i % 2 else "system", f"Text {i}! Yes?" if i % 7 else None) for i in range(400)] + [(None, 1, None, "x"), (None, None, None, None)]
    got = sorted(map(tuple, conversations.damage(spark.createDataFrame(rows, FIELDS).withColumn("fault", F.lit(1))).collect()), key=repr)
    assert got == sorted(damaged(rows), key=repr)


@pytest.mark.parametrize("seed", range(3))
def test_made_up_conversations(spark, seed):
    """All roles, faults, ties, null fields, in short conversations."""
    rng = random.Random(seed)
    texts = ["", " \t", "Yes.", "No!", "open", "Why? ", "é… ende", None, "Yes."]
    rows = [(c, rng.choice([None, *range(6)]), rng.choice(["user", "user", "assistant", "assistant", "system", "tool", "", None]), rng.choice(texts) if rng.random() < 0.5 else f"Turn {rng.random()}{rng.choice('.!?x')}") for c in range(150) for _ in range(rng.randint(1, 9))]
    rows += [(None, 1, "assistant", "Only one.")]
    found = conversations.repair(spark.createDataFrame(rows, FIELDS).withColumns({"key": F.lit("x"), "seq": F.lit(2), "step": F.lit(0)}), spark.createDataFrame([(10**6,)], "conv_id long").union(spark.createDataFrame(rows, FIELDS).select("conv_id")))
    compared(found, expected(rows, {r[0] for r in rows} | {10**6}))


def test_huge_conversation(spark):
    """One conversation in many runs, with a third of equal rows, in linear time; the audit is the walk's."""
    rng = random.Random(5)
    rows = [(7, t // 2, rng.choice(["user", "assistant"]), f"{t}.") for t in range(6000)] + [(7, 5000, "user", "again.")] * 3000
    r = conversations.repair(spark.createDataFrame(rows, FIELDS)).first()
    assert r.audit.count("D") >= 2999 and r.duplicate == 2999 and r.gaps == 2000
    want = expected(rows, {7})[7]
    assert {k: r[k] for k in want} == want


def test_repaired_turns(spark):
    rows = [(1, 0, "assistant", "Hello."), (1, 1, "user", "Hi."), (2, 0, "system", "Rules."), (2, 1, "user", "So?"), (2, 2, "assistant", "Yes."), (3, 0, "user", " ")]
    got = [tuple(r) for r in conversations.repair(spark.createDataFrame(rows, FIELDS), turns=True).orderBy("conv_id", "position").collect()]
    assert got == [(1, 0, "user", ""), (1, 1, "assistant", "Hello."), (1, 2, "user", "Hi."), (1, 3, "assistant", ""), (2, 0, "system", "Rules."), (2, 1, "user", "So?"), (2, 2, "assistant", "Yes.")]
    again = conversations.repair(spark.createDataFrame([(c, p, r, t or "filled.") for c, p, r, t in got], FIELDS)).collect()
    assert all(r.illegal == 0 and r.cost == 0 and set(r.audit) <= {"K"} for r in again)


def test_nothing(spark):
    none = spark.createDataFrame([], FIELDS)
    assert conversations.repair(none).count() == 0
    r = conversations.repair(none, spark.createDataFrame([(4,)], "conv_id long")).first()
    assert (r.conv_id, r.cost, r.audit, r.repaired_sha256) == (4, 0, "", hashlib.sha256(b"").hexdigest())
