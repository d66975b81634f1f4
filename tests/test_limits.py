"""Token buckets against a loop."""

import random

import pytest

from tidegauge.operators import limits
from tidegauge.plans import streams

SECOND = limits.SECOND


def loop(rows, rate, burst):
    out, state = [], {}
    for tenant, at, n, size in sorted(rows, key=lambda r: (r[1], r[2])):
        level, last = state.get(tenant, (burst * SECOND, at))
        level = min(level + rate * (at - last), burst * SECOND)
        ok = size * SECOND <= level
        state[tenant] = level - size * SECOND * ok, at
        out.append((tenant, at, n, size, ok))
    return sorted(out)


@pytest.mark.parametrize("stretch", [3 * SECOND, 40 * SECOND, 10_000 * SECOND])
def test_verdicts_equal_a_loop(spark, stretch):
    rnd = random.Random(stretch)
    rows, at = [], 0
    for n in range(1500):  # a hot tenant with bursts, lulls and long overload
        at += rnd.choice([0, 1, 1000, SECOND // 3, SECOND, 2 * SECOND] + [60 * SECOND] * (n % 97 == 0))
        rows.append(("hot", at, n, rnd.choice([0, 1, 5, 20, 90, 101])))
    rows += [(rnd.choice("ab"), rnd.randrange(400 * SECOND), 5000 + n, rnd.randrange(60)) for n in range(150)]
    frame = spark.createDataFrame(rows, "tenant string, at long, n long, size long")
    got = limits.within_limit(frame, "tenant", "at", ["n"], "size", 16, 100, stretch)
    assert sorted(map(tuple, got.select("tenant", "at", "n", "size", "accepted").collect())) == loop(rows, 16, 100)


def test_odd_rows(spark):
    rows = [(None, 0, 1, 90), ("", 1, 2, 90), ("x", None, 3, 1), ("x", -5, 4, None), ("x", -4, 5, -7), ("x", 0, 6, 101)]
    frame = spark.createDataFrame(rows, "tenant string, at long, n long, size long")
    got = {r.n: (r.tenant, r.accepted) for r in limits.within_limit(frame, "tenant", "at", ["n"], "size", 1, 100, SECOND).collect()}
    assert got == {1: ("", True), 2: ("", False), 3: ("x", False), 4: ("x", True), 5: ("x", True), 6: ("x", False)}
    assert limits.within_limit(frame.where("false"), "tenant", "at", ["n"], "size", 1, 100, SECOND).count() == 0


def test_overloaded_tenants_are_cut(spark):
    """The query's limit refuses some rows and not all."""
    rows = streams.ingest_limit(spark, "/root/testdata/sf0.001").collect()
    assert 0 < sum(r.accepted for r in rows) < len(rows)
