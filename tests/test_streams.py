"""Streams against their batch forms: replayed in several deliveries, stopped and started again, with silence and late rows."""

import time

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.operators import alerts as A
from tidegauge.operators import vectors as V
from tidegauge.streaming import ingest as I
from tidegauge.streaming import rules as R

FOLDER = "/root/testdata/sf0.001"
HOUR, DAY = L.duration("1h"), L.duration("1d")
START, END = 1_704_067_200_000_000, 1_706_659_200_000_000
SCHEMA = "s string, u long, _clock boolean"


def replay(spark, tmp_path, deliveries, build, *restart_after):
    """The rows appended after deliveries of ``(s, u)``, a micro-batch each; with ``restart_after``, a query ends after each of these."""
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        for k, rows in enumerate(deliveries):
            marked = [(*r, False) if len(r) == 2 else r for r in rows]
            spark.createDataFrame(marked, SCHEMA).coalesce(1).write.mode("append").parquet(source)
            time.sleep(0.02)  # files go by their time
            if k + 1 in (*restart_after, len(deliveries)):
                stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_micros("u"))
                built = build(stream)
                R.append_all(built, out, state).awaitTermination()
        return spark.read.schema(built.schema).parquet(out)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


CLOCK = [(None, END + 9 * DAY, True)]


@pytest.fixture(scope="module")
def events(spark):
    rows = spark.read.parquet(f"{FOLDER}/events.parquet").where("event_type in ('error', 'view')").select("event_type", L.micros("ts").alias("u")).orderBy("u").collect()
    return [(r.event_type, r.u) for r in rows]


def parts(rows, n):
    return [rows[k * len(rows) // n : (k + 1) * len(rows) // n] for k in range(n)] + [CLOCK]


@pytest.mark.parametrize("n,restart", [(1, None), (3, 2), (8, 5)])
def test_holds_replayed(spark, tmp_path, events, n, restart):
    rule = A.Rule("X", over=0, hold=2 * HOUR)
    got = replay(spark, tmp_path, parts(events, n), lambda rows: R.hold_stream(R.step_counts(rows, "ts", HOUR, ["s"], "1 hour"), rule, HOUR, START, END, ["s"]), restart)
    batch = spark.createDataFrame(events, "s string, u long").withColumn("ts", F.timestamp_micros("u"))
    want = A.states(V.count_over_time(batch, "ts", HOUR, HOUR, ["s"]).withColumnRenamed("n", "value"), rule, HOUR, START, END, ["s"])
    told = sorted((r.s, r.t, r.state) for r in got.collect())
    assert [x for x in told if x[2] != "resolved"] == sorted((r.s, r.t, r.state) for r in want.collect())
    firing = {(s, t) for s, t, x in told if x == "firing"}
    assert [(s, t) for s, t, x in told if x == "resolved"] == sorted((s, t + HOUR) for s, t in firing if (s, t + HOUR) not in firing and t < END)


@pytest.mark.parametrize("n,restart", [(1, None), (3, 1), (8, 3)])
def test_dead_man_replayed(spark, tmp_path, events, n, restart):
    silent = [r for r in events if r[0] == "error" or r[1] < START + 8 * DAY]  # one falls silent for good
    got = replay(spark, tmp_path, parts(silent, n), lambda rows: R.deadman_stream(R.step_counts(rows, "ts", 6 * HOUR, ["s"], "1 hour"), 6 * HOUR, START + DAY, END, 15 * HOUR, ["s"]), restart)
    gaps = A.missing(spark.createDataFrame(silent, "s string, u long"), "u", ["s"], 6 * HOUR, START + DAY, END)
    want = A.cooled_down(gaps, ["s"], 6 * HOUR, 15 * HOUR)
    assert sorted((r.s, r.t) for r in got.where("kind = 'missing'").collect()) == sorted((r.s, r.t) for r in want.collect())
    missing = {(r.s, r.t) for r in gaps.collect()}
    assert {(r.s, r.t) for r in got.where("kind = 'back'").collect()} == {(s, t + 6 * HOUR) for s, t in missing if (s, t + 6 * HOUR) not in missing and t < END}
    left = {r.s: r.t for r in R.last_told(got, ["s"]).collect()}
    assert left == {s: max(t for x, t in ((r.s, r.t) for r in want.collect()) if x == s) for s, t in missing if t == END}


def test_late_rows_of_a_judged_step_change_nothing(spark, tmp_path):
    deliveries = [[("a", START + 1), ("a", START + 5 * HOUR)], [(None, START + 7 * HOUR)], [("a", START + 2 * HOUR)], CLOCK]
    got = replay(spark, tmp_path, deliveries, lambda rows: R.hold_stream(R.step_counts(rows, "ts", HOUR, ["s"], "1 hour"), A.Rule("X", over=0, hold=HOUR), HOUR, START, END, ["s"]))
    assert sorted((r.s, r.t - START) for r in got.collect()) == [("", 7 * HOUR), ("a", HOUR), ("a", 5 * HOUR)]


def test_kept_late_and_resent_lines_are_all_that_was_sent(spark, tmp_path):
    at = lambda h: START + int(h * HOUR)
    deliveries = [[("a", at(1)), ("b", at(10)), (None, at(9))], [("b", at(10)), ("late", at(1)), ("c", at(9.5)), ("", at(9)), ("d", at(20))], [("late", at(1)), ("late", at(2)), ("e", at(21)), ("e", at(21)), ("d", at(20))]]
    kept = replay(spark, tmp_path, deliveries, lambda rows: I.once(rows.select("s", "u", "ts"), "ts", ["s", "u"], "2 hours"), 1, 2)
    assert sorted((r.s, (r.u - START) / HOUR) for r in kept.collect()) == [("", 9), ("a", 1), ("b", 10), ("c", 9.5), ("d", 20), ("e", 21)]
    sent = spark.createDataFrame([r for d in deliveries for r in d], "s string, u long")
    lost = I.unkept(sent, kept, ["s", "u"])
    assert sorted((r.s, r.late, r.resent) for r in lost.collect()) == [("", 0, 1), ("b", 0, 1), ("d", 0, 1), ("e", 0, 1), ("late", 1, 0), ("late", 2, 0)]
    assert kept.count() + sum(r.late + r.resent for r in lost.collect()) == sent.count()


def test_bursts_are_told_once_and_late_lines_are_not_counted(spark, tmp_path):
    deliveries = [[("a", START + k) for k in range(3)] + [("a", START + 3 * HOUR)], [("b", START + 5 * HOUR)], [("a", START + 5), ("b", START + 5 * HOUR + 1)], CLOCK]
    got = replay(spark, tmp_path, deliveries, lambda rows: I.bursts(rows.select("s", "ts"), "ts", ["s"], "1 hour", 1, "1 hour"), 1, 2)
    assert sorted((r.s, r.u - START, r.n) for r in got.select("s", "n", F.unix_micros("start").alias("u")).collect()) == [("a", 0, 3), ("b", 5 * HOUR, 2)]



def test_many_series_share_the_state_of_a_group(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "BUCKETS", 3)
    beats = [(k, s, START + (k % 5) * DAY + 7) for k in range(60) for s in ('a"]', "")] + [(None, "a", START + 7), (2**60 + 1, "b", START + 7)]
    rows = spark.createDataFrame([(*r, False) for r in beats], "k long, s string, u long, _clock boolean")
    source, out, state = (str(tmp_path / x) for x in ("in", "out", "state"))
    for part in (rows, spark.createDataFrame([(None, None, END + 9 * DAY, True)], rows.schema)):
        part.coalesce(1).write.mode("append").parquet(source)
        time.sleep(0.02)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    try:
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source).withColumn("ts", F.timestamp_micros("u"))
        told = R.deadman_stream(R.step_counts(stream, "ts", DAY, ["k", "s"], "1 hour"), DAY, START + DAY, END, 3 * DAY, ["k", "s"])
        query = R.append_all(told, out, state)
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    at = lambda u: u + -u % DAY
    want = [(k, s, t) for k, s, u in beats for a, b in ((START + DAY, at(u)), (at(u) + DAY, END + 1)) for t in range(a, b, 3 * DAY)]
    got = [(r.k, r.s, r.t) for r in spark.read.schema(told.schema).parquet(out).where("kind = 'missing'").collect()]
    assert told.schema["k"].dataType.simpleString() == "bigint" and sorted(map(str, got)) == sorted(map(str, want))
    kept = [o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"] if "transformWithState" in o["operatorName"]]
    assert kept and 0 < max(kept) <= 9  # at most a state, a timer and its index a group; there are over 60 series
