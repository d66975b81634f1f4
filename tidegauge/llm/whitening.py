"""Embedding whitening: covariance in double-double over the distinct vectors, then eigenvectors of the small matrix.

Centred values are cut in slices of 22 bits. The products of two slices over a block of 256 vectors are exact in a
double (an error-free transformation), and are added with TwoSum to a high and a low part. Tasks send these parts, which
are merged in the same way. The matrix of the dimensions, whose size doesn't depend on the rows, is solved by LAPACK's
reduction to tridiagonal form with divide and conquer.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.quantised import entries, quantised
from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import text_parts

COMPONENTS = 4
#: Vectors in a block, and bits in a slice: 2 * BITS + log2(BLOCK) may not be over 53.
BLOCK, BITS, SLICES = 256, 22, 4
#: Groups in which the tasks' matrices are merged first.
MERGED = 64
_MOMENTS = "dim int, n long, s decimal(38,0)"
_PARTS = "i int, hi array<double>, lo array<double>"


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sum as a double, and what it lacks."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


class Products:
    """The sum of outer products of vectors, as a high and a low matrix."""

    def __init__(self, size: int):
        self.hi, self.lo = np.zeros((size, size)), np.zeros((size, size))

    def _plus(self, hi: np.ndarray, lo: np.ndarray | float = 0.0) -> None:
        s, e = two_sum(self.hi, hi)
        self.hi, self.lo = two_sum(s, self.lo + lo + e)

    def add(self, high: np.ndarray, low: np.ndarray | float = 0.0) -> None:
        """Rows ``high + low``, any number of them."""
        low = np.broadcast_to(low, high.shape)
        for s in range(0, len(high), BLOCK):
            parts = slices(high[s : s + BLOCK], low[s : s + BLOCK])
            for i in range(SLICES):
                for j in range(i, SLICES - i):
                    exact = parts[i].T @ parts[j]
                    self._plus(exact)
                    if i != j:
                        self._plus(exact.T)

    def merge(self, hi: np.ndarray, lo: np.ndarray) -> None:
        self._plus(hi, lo)


def slices(high: np.ndarray, low: np.ndarray) -> list[np.ndarray]:
    """Matrices that add up to ``high + low`` but for less than 2 ** -(BITS * SLICES - 2) of a column's largest entry; in
    each, a column holds multiples of one power of two, of at most BITS bits."""
    top = np.abs(high).max(axis=0)
    unit = np.ldexp(1.0, np.frexp(top)[1] - (BITS - 1))
    out, rest = [], high
    for _ in range(SLICES):
        part = np.rint(rest / unit) * unit
        rest, low = two_sum(rest - part, low)
        out.append(part)
        unit = unit * 2.0**-BITS
    return out


def moments(fit: DataFrame, size: int) -> tuple[int, list[int]]:
    """The number of vectors and the exact sum of each dimension: one row a dimension comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * size
        for part in text_parts(batches, 2048):
            x = entries(part.column("x"), size)
            n += len(x)
            if len(x):
                wide = x.astype(object) if max(x.max(), -int(x.min())) >= 1 << 50 else x
                sums = [s + int(v) for s, v in zip(sums, wide.sum(axis=0), strict=True)]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(size), pa.int32()), pa.array([n] * size), pa.array(map(Decimal, sums), pa.decimal128(38, 0))], ["dim", "n", "s"])

    rows = fit.mapInArrow(run, _MOMENTS).groupBy("dim").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("dim").collect()
    return (rows[0].n, [int(r.s) for r in rows]) if rows else (0, [])


class Centred:
    """x - S / n as a high and a low part, and its exact squares."""

    def __init__(self, n: int, sums: list[int]):
        self.n, self.sums = n, sums
        mean = [Fraction(s, n) for s in sums]
        self.high = np.array([float(m) for m in mean])
        self.low = np.array([float(m - Fraction(h)) for m, h in zip(mean, self.high.tolist(), strict=True)])
        self._whole = np.array([s & (1 << 64) - 1 for s in sums], np.uint64).view(np.int64)

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        d, e = two_sum(x.astype(np.float64), -self.high)
        return two_sum(d, e - self.low)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - S) ** 2; None if that is no 64-bit number. Those that are, are right modulo 2 ** 64."""
        about = np.square(x * float(self.n) - np.array(self.sums, np.float64)).sum(axis=1) / 2.0**63
        with np.errstate(over="ignore"):
            y = x * np.int64(self.n) - self._whole
            out = np.square(y).sum(axis=1).tolist()
        for k in np.flatnonzero(about > 0.99):
            exact = sum((self.n * v - s) ** 2 for v, s in zip(x[k].tolist(), self.sums, strict=True)) if about[k] < 1.01 else 1 << 63
            out[k] = exact if exact < 1 << 63 else None
        return out


def summed_products(fit: DataFrame, size: int, values: Callable, width: int) -> np.ndarray:
    """The sum of outer products of ``values(x)``, ``(high, low)`` of ``width`` columns each, over all vectors of ``fit``.

    Each task sends its matrix row by row. The rows of one number are merged in MERGED groups, then to one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, some = Products(width), False
        for part in text_parts(batches, 2048):
            if part.num_rows:
                total.add(*values(entries(part.column("x"), size)))
                some = True
        for i in range(width if some else 0):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([total.hi[i]]), pa.array([total.lo[i]])], ["i", "hi", "lo"])

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        total = Products(1)
        total.hi = total.lo = np.zeros((1, width))
        for hi, lo in zip(rows["hi"], rows["lo"], strict=True):
            total.merge(np.asarray(hi)[None], np.asarray(lo)[None])
        return pd.DataFrame({"i": rows["i"].iloc[:1], "hi": [total.hi[0]], "lo": [total.lo[0]]})

    parts = fit.mapInArrow(run, _PARTS).withColumn("g", F.pmod(F.spark_partition_id(), F.lit(MERGED)))
    rows = parts.groupBy("i", "g").applyInPandas(merged, _PARTS).groupBy("i").applyInPandas(merged, _PARTS).orderBy("i").collect()
    return np.array([r.hi for r in rows])  # the low part is below its last bit


class Whitening:
    """Unit eigenvectors of the covariance by falling eigenvalue; those without variance whiten to nothing."""

    def __init__(self, centred: Centred, covariance: np.ndarray, most: int = COMPONENTS):
        self.centred = centred
        values, vectors = np.linalg.eigh(covariance)
        order = np.argsort(-values, kind="stable")[:most]
        self.values, self.vectors = values[order], vectors[:, order]
        trace = float(np.trace(covariance))
        self.some = self.values > trace * len(covariance) * 2.0**-52
        self.explained = np.where(self.some, self.values / (trace or 1.0), 0.0)

    def of(self, x: np.ndarray) -> np.ndarray:
        """The whitened values, a column a component that has variance."""
        high, low = self.centred.of(x)
        v = self.vectors[:, self.some]
        return (high @ v + low @ v) / np.sqrt(self.values[self.some])


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)``: a row a vector and component.

    Rows of ``vectors (vec_id, embedding, ...)`` whose vector is null or has a null or non-finite entry are dropped, and
    those of another length than most distinct vectors (ties: the longer), as a covariance needs one length. Each
    distinct vector counts once in the fit; each row gets its result, null and repeated vec_ids too. Vectors have at
    most as many components as entries. A component without variance has a null ``whitened`` and explains 0. A deviation
    that doesn't fit a long is null. An empty table gives an empty one; other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "whitening")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    schema = f"vec_id {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    distinct = scratch.save(quantised(vectors).select("x").distinct(), "distinct")
    length = (F.octet_length("x") / 8).cast("int").alias("size")
    found = distinct.groupBy(length).count().where("size > 0").orderBy(F.desc("count"), F.desc("size")).first()
    if found is None:
        return vectors.sparkSession.createDataFrame([], schema)
    size = found["size"]
    fit = distinct.where(F.octet_length("x") == 8 * size)
    n, sums = moments(fit, size)
    centred = Centred(n, sums)
    white = Whitening(centred, summed_products(fit, size, centred.of, size) / n, components)
    error = 0.0
    if (k := int(white.some.sum())):
        ones = lambda x: (np.hstack([white.of(x), np.ones((len(x), 1))]), 0.0)  # noqa: E731  the last column gives the means
        both = summed_products(fit, size, ones, k + 1) / n
        error = float(np.abs(both[:k, :k] - np.outer(both[k, :k], both[k, :k]) - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
        count = len(white.some)
        for part in text_parts(batches, 2048):
            x = entries(part.column("x"), size)
            out = np.full((len(x), count), np.nan)
            out[:, white.some] = white.of(x)
            each = np.repeat(np.arange(len(x)), count)
            yield pa.RecordBatch.from_arrays([
                part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), len(x))), pa.array(np.full(len(each), n)),
                pa.array(centred.deviation(x), pa.int64()).take(pa.array(each)), pa.array(out.ravel(), from_pandas=True), pa.array(np.tile(white.explained, len(x))), pa.array(np.full(len(each), error)),
            ], names)

    return quantised(vectors, size).mapInArrow(run, schema)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of each embedding, with the fit's figures."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
