"""Whitening and clustering of embeddings against exact arithmetic, on the registered queries and on odd rows."""

import hashlib
import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.llm import clustering, registry, whitening
from tidegauge.llm.quantised import quantised

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "vec_id long, embedding array<double>"


def whole(v):
    return [min(max(math.floor(256 * c), -(1 << 63)), (1 << 63) - 1) for c in v]


def covariance(xs):
    """Exactly, over the distinct vectors."""
    xs = sorted(set(map(tuple, xs)))
    n, sums = len(xs), [sum(c) for c in zip(*xs, strict=True)]
    return n, sums, [[Fraction(sum((n * x[i] - sums[i]) * (n * x[j] - sums[j]) for x in xs), n**3) for j in range(len(sums))] for i in range(len(sums))]


def check_whitened(rows, vectors):
    xs = {i: whole(v) for i, v in vectors.items()}
    n, sums, v = covariance(xs.values())
    assert {(r.vec_id, r.component) for r in rows} == {(i, k) for i in xs for k in range(1, min(4, len(sums)) + 1)}
    exact = np.array([[float(c) for c in row] for row in v])
    e, u = np.linalg.eigh(exact)
    e, u = e[::-1], u[:, ::-1]
    mean = [Fraction(s, n) for s in sums]
    for k in range(1, min(4, len(sums)) + 1):
        mine = {r.vec_id: r for r in rows if r.component == k}
        want = {i: sum(float(c - m) * u[d, k - 1] for d, (c, m) in enumerate(zip(x, mean, strict=True))) / math.sqrt(e[k - 1]) for i, x in xs.items()}
        sign = math.copysign(1, sum(want[i] * mine[i].whitened for i in xs))
        for i, x in xs.items():
            r = mine[i]
            assert abs(r.whitened - sign * want[i]) < 1e-7 and r.n == n and abs(r.explained / (e[k - 1] / np.trace(exact)) - 1) < 1e-6
            assert r.deviation == sum((n * c - s) ** 2 for c, s in zip(x, sums, strict=True)) and r.identity_error < 1e-9


def test_op11_against_exact_covariance(spark):
    rows = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id < 150")
    check_whitened(whitening.whiten(rows).collect(), {r.vec_id: r.embedding for r in rows.collect()})
    n = spark.read.parquet(f"{FOLDER}/embeddings.parquet").count()
    assert len(registry.QUERIES["op11_whitening"](spark, FOLDER).collect()) == 4 * n


def test_op11_keeps_small_spreads_far_from_zero(spark):
    rng = np.random.default_rng(3)
    vectors = {i: (1e8 + np.round(rng.normal(size=5) * [8, 4, 2, 1, 1], 2)).tolist() for i in range(300)}
    rows = spark.createDataFrame([(i, v) for i, v in vectors.items()], SCHEMA).repartition(7)
    check_whitened(whitening.whiten(rows).collect(), vectors)


def test_products_are_exact_and_merge():
    rng = np.random.default_rng(4)
    x = rng.integers(-(1 << 40), 1 << 40, (1000, 6))
    want = [[sum(int(a) * int(b) for a, b in zip(x[:, i], x[:, j], strict=True)) for j in range(6)] for i in range(6)]
    total = whitening.Products(6)
    for part in np.array_split(x, 9):
        one = whitening.Products(6)
        one.add(part.astype(float))
        total.merge(one.hi, one.lo)
    for i in range(6):
        for j in range(6):
            got = Fraction(float(total.hi[i, j])) + Fraction(float(total.lo[i, j]))
            assert abs(got - want[i][j]) <= abs(want[i][j]) * Fraction(1, 1 << 70) + (1 << 25)
    high = rng.normal(size=(50, 3)) * [1e-9, 1, 1e9]
    high[:, 1] = 0
    low = high * 2.0**-54
    parts = whitening.slices(high, low)
    assert np.abs(sum(parts[::-1]) - high).max() <= 1e-7 and all(np.isfinite(p).all() for p in parts)


ODD = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (None, [0.5, -1.0]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]), (6, []), (7, [1.0, 2.0, 3.0]), (8, [-0.0, 0.0]), (9, [0.25, 1e-9])]


def test_op11_on_odd_rows(spark):
    rows = spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("x").alias(c) for c in ("x", "n", "component", "i", "hi")])
    got = whitening.whiten(rows).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == [(0, 1), (0, 2), (1, 1), (1, 1), (1, 2), (1, 2), (8, 1), (8, 2), (9, 1), (9, 2)]
    assert {r.n for r in got} == {4} and max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(rows.where("false")).count() == 0 and whitening.whiten(rows.where("vec_id in (2, 6)")).count() == 0
    same = whitening.whiten(rows.where("vec_id = 1")).collect()
    assert [(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0.0, 0.0)] * 4
    huge = whitening.whiten(spark.createDataFrame([(1, [1e300, 1.0]), (2, [0.0, 0.0]), (3, [1e5, 3.0])], SCHEMA)).collect()
    assert {r.vec_id: r.deviation for r in huge}[1] is None and len(huge) == 6


def brute_clusters(vectors, size, k, rounds, seed):
    kept = [(i, whole(v)) for i, v in vectors if v is not None and len(v) == size and all(c is not None and math.isfinite(c) for c in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), np.array(r[1], "<i8").tobytes()))
    centres = [x for _, x in order[:k]]
    far = lambda x, c: sum((a - b) ** 2 for a, b in zip(x, c, strict=True))
    assign = lambda: [min(range(len(centres)), key=lambda c: (far(x, centres[c]), c)) for _, x in kept]
    for _ in range(rounds):
        of = assign()
        for c in set(of):
            own = [x for (_, x), a in zip(kept, of, strict=True) if a == c]
            centres[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    of = assign()
    d = [far(x, centres[a]) for (_, x), a in zip(kept, of, strict=True)]
    total = {a: sum(y for y, b in zip(d, of, strict=True) if a == b) for a in of}
    sha = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    fits = lambda n: n if n < 1 << 63 else None
    return sorted((str(i), a, fits(y), fits(total[a]), fits(sum(d)), sha(centres[a])) for (i, _), a, y in zip(kept, of, d, strict=True))


@pytest.mark.parametrize("kind", ["plain", "ties", "few", "huge"])
def test_op13_against_all_distances(spark, kind):
    rng = np.random.default_rng(6)
    size = {"plain": 20}.get(kind, 3)
    vectors = [(i, (rng.normal(size=size) + i % 3).tolist()) for i in range(120)]
    if kind == "ties":
        vectors = [(i, (rng.integers(0, 3, size) / 128).tolist()) for i in range(90)] + [(None, [0.0] * size), (3, [0.0] * size)]
    if kind == "few":
        vectors = vectors[:4] + [(9, None), (9, [1.0]), (9, [None] * size), (9, [float("nan")] * size)]
    if kind == "huge":
        vectors += [(500 + i, (rng.normal(size=size) * 1e12).tolist()) for i in range(9)] + [(700, [1e300] * size)]
    rows = spark.createDataFrame(vectors, SCHEMA).select("*", F.lit(1).alias("x"), F.lit(2).alias("cluster"), F.lit(3).alias("sums"))
    got = clustering.cluster(rows, size, 7, 3, 2).collect()
    assert sorted((str(r.vec_id), *r[1:]) for r in got) == brute_clusters(vectors, size, 7, 3, 2)
    assert clustering.cluster(rows.where("false"), size).count() == 0


def test_bounds_hold_and_spare_distances():
    rng = np.random.default_rng(8)
    centres = rng.integers(-300, 300, (40, 64))
    x = centres[rng.integers(0, 40, 500)] + rng.integers(-20, 20, (500, 64))
    near = clustering.Nearest(centres.tolist())
    all_ = ((x[:, None] - centres[None]) ** 2).sum(axis=2)
    assert (near.bounds(*clustering.block_norms(x)) <= all_).all()
    best, distance = near.of(x, *clustering.block_norms(x))
    assert (best == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert near.exact < 0.2 * all_.size


def test_quantised_values(spark):
    rows = spark.createDataFrame([(1, [-0.001, 0.001, 1e300, -1e300])], SCHEMA)
    assert np.frombuffer(quantised(rows).first().x, "<i8").tolist() == [-1, 0, (1 << 63) - 1, -(1 << 63)]
