"""Windows and counters from panes against loops over all rows; null labels and session zones."""

import random
from itertools import pairwise

import pytest
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.operators import alerts as A
from tidegauge.operators import objects as O
from tidegauge.operators import panes as N
from tidegauge.operators import tables as J
from tidegauge.operators import vectors as V

SCHEMA = "s string, u long, value double"


def rows(seed, n, span):
    rnd = random.Random(seed)
    return [(rnd.choice(["a", "b", None, ""]), rnd.randrange(span), rnd.choice([None, *range(-5, 50)])) for _ in range(n)]


def frame(spark, data):
    data = [(s, u, None if v is None else float(v)) for s, u, v in data]
    return spark.createDataFrame(data, SCHEMA).withColumn("ts", F.timestamp_micros("u"))


@pytest.mark.parametrize("step,window,start,end", [(10, 60, 0, 900), (7, 30, 3, 700), (25, 10, 5, 900), (1, 1000, 0, 1500), (50, 50, 0, 900)])
def test_windows_against_all_rows(spark, step, window, start, end):
    data = rows(step, 150, 800)
    got = {(r.s, r.t): (r.n, r.sum, r.min, r.max) for r in N.over_windows(frame(spark, data), "ts", "value", step, window, start, end, ["s"]).collect()}
    want = {}
    for t in range(start, end + 1, step):
        for s in ("a", "b", ""):
            inside = [v for x, u, v in data if (x or "") == s and t - window < u <= t]
            known = [v for v in inside if v is not None]
            if inside:
                want[s, t] = (len(inside), sum(known) if known else None, min(known, default=None), max(known, default=None))
    assert got == want
    assert {(r.s, r.t): r.n for r in N.over_windows(frame(spark, data), "ts", None, step, window, start, end, ["s"]).collect()} == {k: v[0] for k, v in want.items()}
    assert N.over_windows(frame(spark, []), "ts", "value", step, window, start, end, ["s"]).count() == 0


def test_windows_shuffle_panes_only(spark):
    from tidegauge.plans import catalogue, inventory  # noqa: F401

    for name in ("grid_overlap", "grid_extremes", "counter_rate_grid"):
        plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "GreaterThan(ts," in plan and "LessThanOrEqual(ts," in plan
        assert plan.index("Generate explode") < plan.index("Exchange hashpartitioning") and "Generate" not in plan[plan.index("Exchange hashpartitioning") :]


def test_counters_against_all_samples(spark):
    data = [(s, u, abs(v)) for s, u, v in rows(9, 200, 900) if v is not None]
    data = list({(s or "", u): (s, u, v) for s, u, v in data}.values())
    panes = N.counter_panes(frame(spark, data), "ts", "value", 5, ["s"])
    for of in (panes, N.coarser(panes, 20, ["s"])):
        got = {(r.s, r.t): (r.increase, r.n) for r in N.counters_on_grid(of, 20, 60, 0, 1000, ["s"]).collect()}
        want = {}
        for t in range(0, 1001, 20):
            for s in ("a", "b", ""):
                inside = sorted((u, v) for x, u, v in data if (x or "") == s and t - 60 < u <= t)
                if len(inside) > 1:
                    want[s, t] = (sum(b if b < a else b - a for (_, a), (_, b) in pairwise(inside)), len(inside))
        assert got == want
    one = {r.s: r.increase for r in V.extrapolated(frame(spark, data), ["s"], "ts", "value", 400, 60).collect()}
    grid = {r.s: r.extrapolated for r in N.rate_on_grid(frame(spark, data), "ts", "value", 20, 60, 0, 1000, ["s"]).where("t = 400").collect()}
    assert one.keys() == grid.keys() and all(abs(one[s] - grid[s]) < 1e-9 for s in one)


def test_any_pairing_of_summaries_is_the_same(spark):
    parts = [(1, 5.0, 2, 9.0, 4.0, 2), (3, 2.0, 3, 2.0, 0.0, 1), None, (4, 7.0, 6, 1.0, 3.0, 3)]
    one = spark.range(1).select(*[F.lit(p).cast(N.SUMMARY).alias(f"x{i}") if p is None else F.struct(*map(F.lit, p)).cast(N.SUMMARY).alias(f"x{i}") for i, p in enumerate(parts)])
    x = [F.col(f"x{i}") for i in range(4)]
    j = N.joined
    r = one.select(j(j(j(x[0], x[1]), x[2]), x[3]).alias("a"), j(x[0], j(x[1], j(x[2], x[3]))).alias("b"), j(j(x[0], x[1]), j(x[2], x[3])).alias("c")).first()
    assert r.a == r.b == r.c and tuple(r.a) == (1, 5.0, 6, 1.0, 4.0 + 2.0 + 5.0 + 3.0, 6)


def test_a_missing_label_is_the_empty_one(spark):
    v = lambda rows: spark.createDataFrame(rows, "s string, t long, value double")
    fired = A.states(v([(None, 0, 5.0), (None, 1, 5.0), ("", 2, 5.0), ("a", 0, 0.0)]), A.Rule("X", 1, hold=2), 1, 0, 5, ["s"])
    assert [(r.s, r.t, r.state) for r in fired.orderBy("t").collect()] == [("", 0, "pending"), ("", 1, "pending"), ("", 2, "firing")]
    gaps = A.missing(v([(None, 2, 0.0), (None, 4, 0.0), ("", 5, 0.0)]), "t", ["s"], 1, 1, 6)
    assert sorted(r.t for r in gaps.collect()) == [1, 3, 6]
    a, b = v([(None, 0, 6.0), ("x", 0, 1.0)]).drop("t"), v([("", 0, 2.0)]).drop("t")
    assert [(r.s, r.value) for r in V.ratio(a, b, ["s"]).collect()] == [("", 3.0)]
    assert [(r.s, r.value) for r in V.added([a, b, b], ["s"]).collect()] == [("", 10.0)]
    assert sorted((r.s, r.value) for r in V.otherwise(a, b, ["s"]).collect()) == [("", 6.0), ("x", 1.0)]
    assert sorted((r.s, r.value) for r in O.upsert(a, b, ["s"]).collect()) == [("", 2.0), ("x", 1.0)]
    assert [(r.s, r.delta) for r in J.snapshot_delta(b, a, ["s"], "value").collect()] == [("", 4.0)]
    with pytest.raises(Exception, match="more than once"):
        V.ratio(a.union(b), b, ["s"]).collect()
    longs = spark.createDataFrame([(None, 1), (2, 2)], "k long, value int")
    assert L.matched(longs, longs.withColumnRenamed("value", "w"), ["k"]).count() == 2


def test_gaps_before_between_and_after(spark):
    beats = spark.createDataFrame([("a", u) for u in (1, 11, 12, 40, 300)] + [("b", -50), ("b", 500)], "s string, u long")
    got = {}
    for r in A.missing(beats, "u", ["s"], 10, 20, 90).collect():
        got.setdefault(r.s, []).append(r.t)
    assert {k: sorted(v) for k, v in got.items()} == {"a": [30, 50, 60, 70, 80, 90], "b": list(range(20, 91, 10))}


@pytest.mark.parametrize("zone", ["America/New_York", "Asia/Kolkata"])
def test_times_without_zone_are_utc(spark, zone):
    from tidegauge.plans import catalogue, inventory  # noqa: F401

    names = ["windows_in_one_scan", "counter_increase_extrapolated", "grid_overlap", "min_staleness", "count_over_time_by"]
    folder = "/root/testdata/sf0.001"
    want = {n: sorted(map(tuple, catalogue.QUERIES[n](spark, folder).collect())) for n in names}
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        assert {n: sorted(map(tuple, catalogue.QUERIES[n](spark, folder).collect())) for n in names} == want
        ts = spark.createDataFrame([("2024-03-10 02:30:00.000001",), ("1960-01-01 00:00:00.5",), (None,)], "s string").select(F.col("s").cast("timestamp_ntz").alias("n"))
        assert [r.u for r in ts.select(L.micros("n").alias("u")).collect()] == [1710037800000001, -315619199500000, None]
        zoned = spark.range(3).select(F.timestamp_micros(F.col("id") * 10).alias("ts"))
        assert [r.u for r in zoned.where(V.in_range("ts", 10, 10)).select(L.micros("ts").alias("u")).collect()] == [10]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_patterns_match_to_the_very_end(spark):
    df = spark.createDataFrame([("etcd",), ("etcd\n",), ("a\netcd",)], "job string")
    assert [r.job for r in df.where(L.matches("job", "etcd|x")).collect()] == ["etcd"]
    assert J.relabelled(df, [{"action": "keep", "source": ["job"], "regex": "etcd"}]).count() == 1
    assert A.routed(df.withColumnRenamed("job", "alertname"), [("etcd", None)], "chat").count() == 2


def test_quantiles_at_low_bounds(spark):
    def at(q, data):
        return [r.value for r in V.histogram_quantile(q, spark.createDataFrame(data, "le string, value double"), []).collect()]

    low = [("-1", 5.0), ("+Inf", 10.0)]
    assert at(0.3, low) == [-1.0] and at(0.7, low) == [-1.0] and at(0, low) == [-1.0]
    assert at(0, [("1", 0.0), ("2", 4.0), ("+Inf", 4.0)]) == [0.0] and at(1, [("1", 1.0), ("2", 4.0), ("+Inf", 4.0)]) == [2.0]
    assert at(0.5, [("-2", 0.0), ("0", 4.0), ("+Inf", 4.0)]) == [-1.0]
    assert at(1.5, low) == [float("inf")] and at(-1, low) == [float("-inf")] and at(0.5, [("1", 3.0)]) == []


def test_keys_tell_maps_apart(spark):
    maps = [{"a": "1,b=2"}, {"a": "1", "b": "2"}, {"a": "1", "b": None}, {"a": "1"}, {"a": "1", "b": ""}, {}, {"a\\": "1"}]
    keys = [r.k for r in spark.createDataFrame([(m,) for m in maps], "m map<string,string>").select(L.series_key("m").alias("k")).collect()]
    assert keys[1] == "a=1,b=2" and len(set(keys)) == 5 and keys[2] == keys[3] == keys[4] and keys[5] == "(total)"


def test_selectors_need_every_pair(spark):
    objects = spark.createDataFrame([(1, {"k": "1"}), (1, {"k": "1"}), (2, {"k": "1", "j": "2"})], "o long, labels map<string,string>")
    wanted = spark.createDataFrame([("s", "k", "1"), ("s", "j", "2"), ("s", "j", "2")], "selector string, k string, v string")
    assert [(r.selector, r.o) for r in J.selected(objects, "o", "labels", wanted).collect()] == [("s", 2)]


def test_first_match_and_sums_of_nothing(spark):
    out = spark.createDataFrame([("An ERROR token",), ("none",), (None,)], "x string").select(J.first_match(F.col("x"), ["token", "Error"]).alias("m")).collect()
    assert [r.m for r in out] == ["token", "other", "other"]
    nested = spark.createDataFrame([(None,), ([(1,), (None,)],)], "c array<struct<n:int>>")
    assert [r.s for r in nested.select(O.array_sum("c", "n").alias("s")).collect()] == [0, 1]
