"""Hand-computed cases for what SQL over the driver's tables doesn't show."""

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.functions import lines as P
from tidegauge.operators import alerts as A
from tidegauge.operators import tables as J
from tidegauge.operators import objects as O
from tidegauge.operators import vectors as V
from tidegauge.sources import tables as S
from tidegauge.streaming import ingest


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def samples(spark, rows):
    return spark.createDataFrame(rows, "s string, u long, value double").withColumn("ts", F.timestamp_micros("u"))


def test_matchers_are_anchored_and_missing_is_empty(spark):
    df = spark.createDataFrame([("etcd",), ("my-etcd",), (None,)], "job string")
    assert [r.job for r in df.where(L.matches("job", "etcd")).collect()] == ["etcd"]
    assert df.where(L.differs("job", "etcd")).count() == 2
    assert df.where(L.equals("job", "")).count() == 1
    assert df.where(L.one_of("job", None)).count() == 2


def test_values_and_keys(spark):
    r = one(spark, L.number(F.lit("1.5")).alias("a"), L.number(F.lit("x")).alias("b"), L.default(F.lit(""), "-").alias("c"), L.whole(F.lit(3.0)).alias("d"), L.whole(F.lit(2.25)).alias("e"), L.bar(F.lit(250)).alias("f"))
    assert (r.a, r.b, r.c, r.d, r.e, r.f) == (1.5, 0.0, "-", "3", "2.3", "███")
    r = one(spark, L.series_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1"))).alias("k"), L.merged(F.create_map(F.lit("a"), F.lit("1")), F.create_map(F.lit("a"), F.lit("2"))).alias("m"))
    assert (r.k, r.m) == ("a=1,b=2", {"a": "2"})
    assert L.duration("168h") == 604_800_000_000


def test_range_is_open_at_the_start(spark):
    df = samples(spark, [("a", 0, 1.0), ("a", 10, 1.0)])
    assert df.where(V.in_range("ts", 10, 10)).count() == 1
    grid = V.count_over_time(df, "ts", 10, 20, ["s"]).orderBy("t").collect()
    assert [(r.t, r.n) for r in grid] == [(0, 1), (10, 2), (20, 1)]


def test_counters(spark):
    s = 1_000_000
    df = samples(spark, [("a", 10 * s, 10.0), ("a", 20 * s, 14.0), ("a", 30 * s, 2.0), ("b", 10 * s, 5.0)])
    r = V.increase(df, ["s"], "ts", "value", 30 * s, 30 * s).collect()
    assert [(x.s, x.increase) for x in r] == [("a", 6.0)]  # the fall counts as 2; one sample gives none
    r = V.extrapolated(df, ["s"], "ts", "value", 30 * s, 30 * s).collect()
    assert [(x.s, round(x.increase, 6)) for x in r] == [("a", 9.0)]  # over 20 s seen, and 10 s before that


def test_binary_vectors(spark):
    v = lambda rows: spark.createDataFrame(rows, "s string, value double")
    a, b = v([("x", 1.0), ("y", 2.0)]), v([("x", 0.0), ("z", 1.0)])
    assert [(r.s, r.value) for r in V.ratio(a, b, ["s"]).collect()] == [("x", None)]
    assert [(r.s, r.value) for r in V.added([a, b], ["s"]).collect()] == [("x", 1.0)]
    assert sorted(r.s for r in V.otherwise(a, b, ["s"]).collect()) == ["x", "y", "z"]
    assert V.otherwise(a, b, []).count() == 2 and V.otherwise(a.where("false"), b, []).count() == 2
    assert V.total(a.where("false"), "value", []).count() == 0
    assert V.absent(a).count() == 0 and V.absent(a.where("false")).count() == 1


def test_histogram_quantile(spark):
    def at(q, rows):
        return [r.value for r in V.histogram_quantile(q, spark.createDataFrame(rows, "le string, value double"), []).collect()]

    assert at(0.5, [("1", 10.0), ("2", 10.0), ("+Inf", 10.0)]) == [0.5]
    assert at(0.9, [("1", 0.0), ("2", 0.0), ("+Inf", 5.0)]) == [2.0]
    assert at(0.5, [("1", 0.0), ("+Inf", 0.0)]) == []
    assert at(0.5, [("1", 2.0), ("2", 1.0), ("4", 4.0), ("+Inf", 4.0)]) == [1.0]


def test_hold_needs_every_point(spark):
    rows = [("a", 0, 5.0), ("a", 1, 5.0), ("a", 2, 5.0), ("a", 4, 5.0)]
    out = A.states(spark.createDataFrame(rows, "s string, t long, value double"), A.Rule("X", 1, hold=2), 1, 0, 5, ["s"])
    assert [(r.t, r.state) for r in out.orderBy("t").collect()] == [(0, "pending"), (1, "pending"), (2, "firing"), (4, "pending")]


def test_dead_man_and_cooldown(spark):
    minute = L.duration("1m")
    beats = spark.createDataFrame([("a", t * minute) for t in (5, 10, 85, 90)], "s string, u long")
    gaps = A.missing(beats, "u", ["s"], 5 * minute, 5 * minute, 95 * minute)
    assert [r.t // minute for r in gaps.orderBy("t").collect()] == [*range(15, 85, 5), 95]
    told = A.cooled_down(gaps, ["s"], 5 * minute, 30 * minute)
    assert [r.t // minute for r in told.orderBy("t").collect()] == [15, 45, 75, 95]


def test_lines(spark):
    r = one(spark, P.masked(F.lit("at 10.0.0.1 0xBEEF n=1234567")).alias("m"), P.capture(F.lit("no"), "x(.)").alias("c"), P.image_name(F.lit("docker.io/a/b:1@sha256:ff"), "hub", "p").alias("i"), P.image_name(F.lit("hub/p/b:1"), "hub", "p").alias("j"), P.yaml_scalar(F.lit("it's: x")).alias("y"), P.yaml_scalar(F.lit("plain")).alias("z"))
    assert (r.m, r.c, r.i, r.j, r.y, r.z) == ("at IP X n=N", None, "hub/p/b:1", "hub/p/b:1", "'it''s: x'", "plain")


def test_relabel(spark):
    df = spark.createDataFrame([("x_bucket", "10.0.0.1:2379"), ("x_bucket_total", "host")], "name string, address string")
    assert [r.name for r in J.relabelled(df, [{"action": "drop", "source": ["name"], "regex": ".*_bucket"}]).collect()] == ["x_bucket_total"]
    out = J.relabelled(df, [{"action": "replace", "source": ["address"], "regex": r"([^:]+):\d+", "target": "instance", "replacement": "$1"}])
    assert [r.instance for r in out.orderBy("name").collect()] == ["10.0.0.1", None]


def test_snapshot_round_trip(spark, tmp_path):
    (tmp_path / "a.txt").write_text("ns|x|1|-1.0\nbad line\nns|y|4|2.5\n")
    a = S.snapshot(spark, str(tmp_path / "a.txt"))
    assert {(r.name, r.restarts) for r in a.where("name is not null and restarts is not null").collect()} == {("x", 1), ("y", 4)}
    S.write_snapshot(a, str(tmp_path / "b"))
    b = spark.createDataFrame([("ns", "y", 7, 0.0), ("ns", "z", 9, 0.0)], S.SNAPSHOT)
    assert [(r.name, r.delta) for r in J.snapshot_delta(S.snapshot(spark, str(tmp_path / "b")), b, ["ns", "name"], "restarts").collect()] == [("y", 3)]


def test_stream_equals_batch(spark, tmp_path):
    folder = tmp_path / "var/log/pods/shop_web-1_uid/app"
    folder.mkdir(parents=True)
    (folder / "0.log").write_text("2024-01-01T00:00:00.5Z stderr F boom\nnot a log line\n2024-01-01T00:30:00Z stdout P half\n")
    glob = str(tmp_path / "var/log/pods/*/*/*.log")
    batch = S.read_pod_logs(spark, glob, "n1")
    assert [(r.namespace, r.pod, r.container, r.stream, r.line) for r in batch.orderBy("time").collect()] == [("shop", "web-1", "app", "stderr", "boom"), ("shop", "web-1", "app", "stdout", "half")]
    ingest.append_by_day(ingest.tail(spark, glob, node="n1"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    kept = spark.read.parquet(str(tmp_path / "out")).drop("day")
    assert sorted(map(tuple, kept.select(*batch.columns).collect())) == sorted(map(tuple, batch.collect()))
    bursts = ingest.bursts(ingest.tail(spark, glob), "time", ["namespace"], "1 hour", 1)
    run = bursts.writeStream.format("memory").queryName("bursts").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert [(r.namespace, r.n) for r in spark.table("bursts").collect()] == [("shop", 2)]


def test_a_series_must_come_once(spark):
    once = spark.createDataFrame([("x", 1.0)], "s string, value double")
    twice = spark.createDataFrame([("x", 1.0), ("x", 2.0)], "s string, value double")
    for f in (lambda: V.ratio(once, twice, ["s"]), lambda: V.added([twice, once], ["s"])):
        with pytest.raises(Exception, match="more than once"):
            f().collect()
    assert [r.value for r in V.scalar_ratio(once.select("value"), once.select("value")).collect()] == [1.0]
    assert V.scalar_ratio(once.select("value"), once.select("value").where("false")).count() == 0


@pytest.mark.parametrize("name", ["log_rate_by", "count_by_series", "topk_by", "autoscale", "windows_in_one_scan", "counter_increase_reset", "counter_rate_by"])
def test_ranges_reach_the_scan(spark, name):
    from tidegauge.plans import catalogue

    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts," in plan and "LessThanOrEqual(ts," in plan


def test_told_times_stream_through_pieces(spark):
    times = [(k, t) for k in (None, 1, 2) for t in range(0, 500, 7 + (k or 0))] + [(1, 5), (1, 5), (2, 10_000)]
    got = sorted((str(r.k), r.t) for r in A.emitted(spark.createDataFrame(times, "k long, t long"), "k", "t", 20).collect())
    want = []
    for k in (None, 1, 2):
        last = None
        for t in sorted(t for x, t in times if x == k):
            if last is None or t - last >= 20:
                want.append((str(k), last := t))
    assert got == sorted(want)


def test_nested_lists_that_are_missing(spark):
    rows = spark.createDataFrame([(1, None, ["a"]), (2, [], None), (3, ["s"], ["a"])], "i int, silenced_by array<string>, inhibited_by array<string>")
    assert {(r.i, r.active, r.silenced, r.inhibited) for r in O.alert_flags(rows).collect()} == {(1, False, False, True), (2, True, False, False), (3, False, True, True)}
    lines = spark.createDataFrame([("s", 1, "P", "a"), ("s", 2, "F", "b"), ("s", 3, "F", "c"), ("s", 4, "P", "d")], "s string, i int, flag string, line string")
    for stretch in (None, 1, 2, 100):
        assert sorted((r.first, r.line) for r in O.joined_lines(lines, ["s"], ["i"], "flag", "line", stretch).collect()) == [(1, "ab"), (3, "c"), (4, "d")]


def test_arrays_maps_and_sizes_at_their_edges(spark):
    rows = spark.createDataFrame([(None, {"a": 1, "b": 2}, None, "1.5K"), (["x"], {"a": 1}, {"a": 5}, "2T"), ([], {}, {}, "K"), (list("abcdefg"), None, {"a": 1}, None)], "tags array<string>, spec map<string,bigint>, status map<string,bigint>, size string")
    out = rows.select(O.last(F.col("tags"), 5).alias("t"), O.with_entry(F.col("spec"), F.col("status"), F.lit(0).cast("long")).alias("e"), O.size_bytes(F.col("size")).alias("b")).collect()
    assert [r["t"] for r in out] == [[], ["x"], [], list("cdefg")]
    assert [None if r["e"] is None else sorted(map(tuple, r["e"])) for r in out] == [[("a", 1, 0), ("b", 2, 0)], [("a", 1, 5)], [], None]
    assert [r["b"] for r in out] == [1536.0, 2.0 * 1024**4, None, None]
