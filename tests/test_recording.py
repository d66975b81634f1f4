"""Recording rules and alert histories in several runs against one."""

import pytest
from pyspark.sql import functions as F

from tidegauge.operators import history as H
from tidegauge.operators import recording as M

RULES = [
    M.Quotient("s:bad:ratio", "s:bad:count", "s:all:count"),
    M.Recorded("s:all:count", "rows", ["s"]),
    M.Recorded("s:bad:count", "rows", ["s"], where="value < 0"),
    M.Recorded("k:value:min", "rows", ["k", "s"], "min"),
    M.Recorded("k:min:sum", "k:value:min", ["k"], "sum"),
    M.Recorded("other:count", "others", []),
]


def rows(n):
    return [((None, "", "a", "b")[i % 4], "xyz"[i % 3], i * 7 % 100, float(i % 11 - 4)) for i in range(n)]


def run(spark, folder, *runs):
    for data, upto in runs:
        frame = spark.createDataFrame(data, "s string, k string, u long, value double").withColumn("ts", F.timestamp_micros("u"))
        M.record(spark, {"rows": (frame, "ts"), "others": (frame.where("s = 'a'"), "ts")}, RULES, str(folder), 5, 20, 0, upto)
    return sorted((r.rule, r.slot, str(r.labels), r.t, r.value) for r in M.read(spark, str(folder)).collect())


def test_runs_over_growing_input_equal_one(spark, tmp_path):
    data = rows(300)
    whole = run(spark, tmp_path / "one", (data, 90))
    upto = lambda t: [r for r in data if r[2] <= t]
    assert run(spark, tmp_path / "three", (upto(33), 33), (upto(40), 40), (data, 93)) == whole
    assert run(spark, tmp_path / "three", (data, 90)) == whole  # again
    want = {}
    for s, _, u, v in data:
        t = -(-u // 5) * 5
        if 0 < t <= 90:
            n = want.setdefault((s or "", t), [0, 0])
            n[0] += 1
            n[1] += v < 0
    got = {(r.labels[0]["value"], r.t): r.value for r in M.read(spark, str(tmp_path / "one")).where("rule = 's:bad:ratio'").collect()}
    assert got == {k: bad / n for k, (n, bad) in want.items() if bad}
    least = {}
    for s, k, u, v in data:
        t = -(-u // 5) * 5
        if 0 < t <= 90:
            least[k, s or "", t] = min(v, least.get((k, s or "", t), 99))
    sums = {(r.labels[0]["value"], r.t): r.value for r in M.read(spark, str(tmp_path / "one")).where("rule = 'k:min:sum'").collect()}
    assert sums == {(k, t): sum(v for (x, _, y), v in least.items() if (x, y) == (k, t)) for k, _, t in least}
    assert M.progress(spark, str(tmp_path / "three")) == dict.fromkeys((r.name for r in RULES), 90)


def test_a_later_run_writes_only_its_slots(spark, tmp_path):
    data = rows(300)
    run(spark, tmp_path / "s", (data, 60))
    old = {p: p.stat().st_mtime_ns for p in (tmp_path / "s" / "series").rglob("*.parquet")}
    run(spark, tmp_path / "s", (data, 90))
    kept = [p for p in old if p.exists() and p.stat().st_mtime_ns == old[p]]
    assert {p.parent.name for p in kept} == {"slot=0", "slot=1", "slot=2"} and len(kept) == len(old)


def test_rules_in_a_circle_raise():
    with pytest.raises(ValueError, match="each other"):
        M.levels([M.Recorded("a", "b"), M.Recorded("b", "a"), M.Recorded("c", "rows")])
    assert [[r.name for r in level] for level in M.levels(RULES)] == [["s:all:count", "s:bad:count", "k:value:min", "other:count"], ["s:bad:ratio", "k:min:sum"]]


def test_history_of_three_evaluations(spark, tmp_path):
    firing = {"a": [1, 2, 3, 4, 5, 9, 10], "b": [3, 6, 7], None: [4, 5, 6, 7, 8, 9, 10, 11, 12], "c": [12]}
    states = spark.createDataFrame([(s, t, "firing") for s, points in firing.items() for t in points] + [("a", 8, "pending"), ("z", 1, "pending")], "s string, t long, state string")
    one = H.History(spark, str(tmp_path / "one"), ["s"], "s string")
    one.merge(states, 1, None, 12)
    three = H.History(spark, str(tmp_path / "three"), ["s"], "s string")
    for before, at in ((None, 4), (4, 7), (4, 7), (7, 12)):  # one is repeated
        three.merge(states, 1, before, at)
    rows = lambda df: sorted(map(tuple, df.collect()))
    want = [("", 4, 13, True), ("a", 1, 6, False), ("a", 9, 11, False), ("b", 3, 4, False), ("b", 6, 8, False), ("c", 12, 13, True)]
    assert rows(one.intervals(12)) == rows(three.intervals(12)) == want
    assert rows(three.intervals(4)) == [("", 4, 5, True), ("a", 1, 5, True), ("b", 3, 4, False)]
    assert rows(three.intervals(12, 3)) == [r for r in want if r[2] > 9]
    three.forget(12, 5)
    assert sorted(p.name for p in (tmp_path / "three").glob("evaluated=*")) == ["evaluated=12"]
    assert rows(three.intervals(12, 3)) == [r for r in want if r[2] > 9]
    three.merge(states.where("false"), 1, 12, 14)
    assert rows(three.intervals(14, 3)) == [("", 4, 13, False), ("c", 12, 13, False)]
