"""Encrypted columns, snapshots, retries, memberships, answers and feedback on made-up rows and edges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vellum.functions import answers
from vellum.operators import attempts, sealed, snapshots

KEYS = {"v1": "one secret", "v2": "another secret"}
VALUES = [None, "", "  ", "a", "Grüße 😀", "x" * 5000, "v1:not sealed", "v3:other", "plain: text"]


def test_sealed_values(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(VALUES)], "id int, value string")
    rows = df.withColumn("box", sealed.sealed(F.col("value"), "value", "v1", KEYS["v1"])).persist()
    for r in rows.withColumns({"back": sealed.opened(F.col("box"), "value", KEYS), "other": sealed.opened(F.col("box"), "name", KEYS), "wrong": sealed.opened(F.col("box"), "value", {"v1": "no"})}).collect():
        if not (r.value or "").strip():
            assert r.box is None and r.back is None
        else:
            assert r.box.startswith("v1:") and r.back == r.value and r.other is None and r.wrong is None
    turned = rows.withColumn("new", sealed.rotated(F.col("box"), "value", KEYS, "v2")).select("value", "box", "new", sealed.opened(F.col("new"), "value", {"v2": KEYS["v2"]}).alias("back"), sealed.rotated(F.col("new"), "value", KEYS, "v2").alias("again")).collect()
    assert all(r.back == (r.value if (r.value or "").strip() else None) and (r.new is None or r.new.startswith("v2:")) for r in turned)
    # equal values have unequal boxes, but equal search hashes
    twice = spark.createDataFrame([("a",), ("a",)], "value string").select(sealed.sealed(F.col("value"), "value", "v1", "k").alias("box"), sealed.search_hash(F.col("value")).alias("hash")).collect()
    assert twice[0].box != twice[1].box and twice[0].hash == twice[1].hash
    assert df.select(F.count_if(sealed.search_hash(F.col("value")).isNull())).first()[0] == 2


def test_legacy_and_broken_values(spark):
    df = spark.createDataFrame([("plain",), ("v9:abc",), ("v1:%%%",), ("v1:AAAA",), (None,), ("a:v1:x",)], "value string")
    got = {r.value: (r.legacy, r.out) for r in df.select("value", sealed.is_legacy(F.col("value"), list(KEYS)).alias("legacy"), sealed.opened(F.col("value"), "c", KEYS).alias("out")).collect()}
    assert got["plain"] == (True, "plain") and got["v9:abc"] == (True, "v9:abc") and got["a:v1:x"] == (True, "a:v1:x")
    assert got["v1:%%%"] == (False, None) and got["v1:AAAA"] == (False, None) and got[None][1] is None


def test_search_and_look_up(spark):
    people = [(i, f"user{i}@x.de", f"Name {i}" if i % 3 else None) for i in range(200)]
    boxes = sealed.seal_columns(spark.createDataFrame(people, "id int, email string, full_name string"), ["email", "full_name"], "v1", KEYS["v1"])
    found = sealed.search(boxes, "AME 1", ["email", "full_name"], KEYS, "id", 5).collect()
    assert [r.id for r in found] == [1, 10, 11, 13, 14]
    wanted = spark.createDataFrame([("user7@x.de",), ("user7@x.de",), ("nobody",), ("",), (None,)], "value string")
    assert [(r.id, r.email, r.full_name) for r in sealed.look_up(boxes, "email", wanted, ["email", "full_name"], KEYS).collect()] == [(7, "user7@x.de", "Name 7")]


def fold(rows, changes):
    """Changes one after another."""
    state = {k: list(v) for k, *v in rows}
    for op, seq, key, *new in sorted((c for c in changes if None not in c[:3] and c[0] in snapshots.OPS), key=lambda c: (c[1], c[0], [(x is not None, x) for x in c[3:]])):
        if op == "insert":
            state[key] = new
        elif op == "delete":
            state.pop(key, None)
        elif key in state:
            state[key] = [b if b is not None else a for a, b in zip(state[key], new, strict=True)]
    return sorted((k, *v) for k, v in state.items())


@pytest.mark.parametrize("seed", range(4))
def test_snapshots(spark, seed):
    rng = random.Random(seed)
    rows = [(k, f"n{k}", k) for k in range(25)]
    changes = [(rng.choice(["insert", "update", "update", "delete", "other", None]), rng.choice([None, *range(40)]), rng.choice([None, *range(35)]), rng.choice([None, "a", "b"]), rng.choice([None, 1, 2])) for _ in range(300)]
    before = spark.createDataFrame(rows, "id int, name string, n int")
    new = spark.createDataFrame(changes, "op string, seq int, id int, name string, n int")
    after = snapshots.applied(before, new, "id")
    key = lambda t: tuple((x is not None, x) for x in t)
    assert sorted(map(tuple, after.collect()), key=key) == sorted(fold(rows, changes), key=key)
    assert sorted(map(tuple, snapshots.applied(after, new, "id").collect()), key=key) == sorted(map(tuple, after.collect()), key=key)
    log = {r.id: r.action for r in snapshots.change_log(before, new, "id").collect()}
    changed = {c[2] for c in changes if None not in c[:3] and c[0] in snapshots.OPS}
    assert log.keys() == changed
    kept = {r[0] for r in fold(rows, changes)}
    assert all((k in kept) == (a in ("inserted", "replaced", "updated")) for k, a in log.items())


def test_snapshots_without_changes(spark):
    before = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "id int, name string")
    none = spark.createDataFrame([], "op string, seq int, id int, name string")
    assert sorted(map(str, snapshots.applied(before, none, "id").collect())) == sorted(map(str, before.collect()))
    assert snapshots.change_log(before, none, "id").count() == 0
    again = snapshots.applied(before, spark.createDataFrame([("update", 1, 1, "z")], "op string, seq int, id int, name string"), "id")
    assert sorted(str(r.name) for r in again.collect()) == ["c", "z", "z"]


def test_newest(spark):
    df = spark.range(1000).selectExpr("id % 3 as k", "id as at", "id")
    got = snapshots.newest(df, "k", ["at", "id"], 4)
    assert sorted((r.k, r.id) for r in got.collect()) == [(k, i) for k in range(3) for i in sorted(x for x in range(1000) if x % 3 == k)[-4:]]
    assert "WindowGroupLimit" in got._jdf.queryExecution().toString()


def test_attempts(spark):
    rows = [(1, 0, None, 3, True), (2, 1, "HTTP 503", 3, True), (3, 5, "503", 3, True), (4, 2, "boom", 3, True), (5, 2, "boom", 3, False), (6, None, None, None, None), (7, 1, "x", 0, True)]
    got = attempts.attempts(spark.createDataFrame(rows, "id int, failures int, error string, max_retries int, retry_on_failure boolean")).orderBy("id", "attempt").collect()
    assert [(r.id, r.attempt, r.outcome, r.wait, r.status) for r in got] == [
        (1, 1, "ok", 0, "COMPLETED"), (2, 1, "failed", 5, "COMPLETED"), (2, 2, "ok", 0, "COMPLETED"), (3, 1, "failed", 5, "FAILED"), (3, 2, "failed", 10, "FAILED"), (3, 3, "failed", 0, "FAILED"),
        (4, 1, "failed", 1, "COMPLETED"), (4, 2, "failed", 2, "COMPLETED"), (4, 3, "ok", 0, "COMPLETED"), (5, 1, "failed", 0, "FAILED"), (6, 1, "ok", 0, "COMPLETED"), (7, 1, "failed", 0, "FAILED"),
    ]


def test_membership(spark):
    left = spark.createDataFrame([(1, ["b", "a", "b", None]), (2, []), (3, None), (4, ["z"])], "id int, names array<string>")
    right = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "name string, n int")
    assert sorted((r.id, r.name, r.n, r.position) for r in attempts.matched(left, "names", right, "name").collect()) == [(1, "a", 1, 2), (1, "b", 2, 1)]


def test_parsed_answers(spark):
    whole = json.dumps({"pii_issues": ["x"], "overall_quality_score": 7.5, "recommendations": [], "detailed_analysis": "ok"})
    texts = [whole, f"Sure:\n```json\n{whole}\n``` bye", "nothing", "{broken}", "a } b { c", None, "", '{"overall_quality_score": 3} and {"x": 1}', "{}"]
    got = spark.createDataFrame([(t,) for t in texts], "text string").select(answers.parsed(F.col("text")).alias("a")).select("a.*").collect()
    assert [r.parse_error for r in got] == [False, False, True, True, True, True, True, True, False]
    assert got[0] == got[1] and got[0].overall_quality_score == 7.5 and got[0].pii_issues == ["x"] and got[0].translation_issues is None
    assert got[2].detailed_analysis == "Raw response: nothing" and got[2].translation_issues == ["Failed to parse AI analysis response"] and got[5].overall_quality_score == 0


def test_feedback_and_hints(spark):
    rows = [(3, {"clarity": 5, "speed": None}), (0, {"clarity": 0, "foo": 3}), (None, {}), (6, None), (5, {"speed": 6, "accuracy": 1})]
    got = [r.f for r in spark.createDataFrame(rows, "rating int, details map<string,int>").select(answers.feedback_faults(F.col("rating"), F.col("details")).alias("f")).collect()]
    assert got == [[], ["rating", "key:foo", "value:clarity"], ["rating"], ["rating"], ["value:speed"]]
    h = spark.createDataFrame([("LABORWERTE",), ("?",), (None,)], "c string").select(answers.hints(F.col("c")).alias("h")).select("h.*").collect()
    assert h[0].focus_areas == answers.FOCUS["LABORWERTE"] and h[1].focus_areas == h[2].special_handling == []


def test_tables_and_models(spark):
    cases = [([["a", "b"], ["", "c"]], True), ([["a", "b"]], False), ([["a"], ["b"]], False), ([["", "a"], ["", ""], ["", ""]], False), ([], False)]
    df = spark.createDataFrame(cases, "rows array<array<string>>, want boolean")
    assert df.where(F.coalesce(answers.is_table(F.col("rows")), F.lit(False)) != F.col("want")).count() == 0
    assert [r.f for r in spark.createDataFrame([("Check the LAYOUT",), ("translate",), (None,)], "t string").select(answers.uses_fast_model(F.col("t")).alias("f")).collect()] == [True, False, False]
