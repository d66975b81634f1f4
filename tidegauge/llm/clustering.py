"""Centroid clustering of whole-number vectors: exact rounds, in which bounds from block norms spare most distances.

A vector is compressed to the sum and the squared norm of each block of its entries. Within a block, the parts along
and across the block's mean are separate, and the Cauchy-Schwarz inequality bounds the product of the parts across. So
``|x - c|^2 >= |x|^2 + |c|^2 - 2 * sum over blocks of (sum_x * sum_c / width + across_x * across_c)``. The centroid of the
least bound gives a distance to beat; the others get an exact distance only where their bound doesn't exceed it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.quantised import SCALE, entries, quantised
from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import text_parts

SIZE, CENTROIDS, ROUNDS, SEED = 64, 40, 5, 2
#: Entries in a block.
WIDTH = 8
#: Entries up to here in size have distances that fit a 64-bit number, for vectors of up to 1024 of them.
PLAIN = 1 << 25
#: What rounding may add to a bound, in parts of the norms.
SLACK = 1e-9


def block_norms(x: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """The sums of each row's blocks, and their squared norms; the last block may be shorter."""
    starts = np.arange(0, x.shape[1], width)
    x = x.astype(np.float64)
    return np.add.reduceat(x, starts, axis=1), np.add.reduceat(x * x, starts, axis=1)


class Nearest:
    """The nearest of fixed centroids, exactly; of equal distances, the smaller number's."""

    def __init__(self, centroids: list[list[int]]):
        big = max((abs(v) for c in centroids for v in c), default=0) > PLAIN
        self.centroids = np.array(centroids, object if big else np.int64)
        self.size = len(centroids[0])
        self.widths = np.diff(np.append(np.arange(0, self.size, WIDTH), self.size))
        self.along, self.across, self.norm = self._compressed(*block_norms(self.centroids))
        self.exact = 0

    def _compressed(self, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        along = sums / np.sqrt(self.widths)
        return along, np.sqrt(np.maximum(squares - along * along, 0.0)), squares.sum(axis=1)

    def bounds(self, sums: np.ndarray, squares: np.ndarray) -> np.ndarray:
        """Of each vector and centroid, what their squared distance is at least."""
        along, across, norm = self._compressed(sums, squares)
        both = norm[:, None] + self.norm[None]
        return both * (1 - SLACK) - 2 * (along @ self.along.T + across @ self.across.T)

    def _distance(self, x: np.ndarray, c: np.ndarray) -> np.ndarray:
        d = x - self.centroids[c]
        self.exact += len(d)
        return (d * d).sum(axis=1)

    def of(self, x: np.ndarray, sums: np.ndarray, squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number and the squared distance of each row's nearest centroid."""
        if len(x) and max(x.max(), -int(x.min())) > PLAIN:
            x = x.astype(object)
        least = self.bounds(sums, squares)
        best = least.argmin(axis=1)
        distance = self._distance(x, best)
        least[np.arange(len(x)), best] = np.inf  # done
        for c in range(len(self.centroids)):
            rows = np.flatnonzero(least[:, c] <= distance.astype(np.float64) * (1 + SLACK))
            d = self._distance(x[rows], np.full(len(rows), c))
            better = (d < distance[rows]) | (d == distance[rows]) & (c < best[rows])
            best[rows[better]], distance[rows[better]] = c, d[better]
        return best, distance


def compressed(rows: DataFrame, size: int) -> DataFrame:
    """``(vec_id, x, sums, squares)``: what every round reads."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, 2048):
            blocks = block_norms(entries(part.column("x"), size))
            flat = [pa.array([r.tobytes() for r in b], pa.binary()) for b in blocks]
            yield pa.RecordBatch.from_arrays([*part.columns, *flat], [*part.schema.names, "sums", "squares"])

    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary, sums binary, squares binary")


def _batches(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    blocks = -(-size // WIDTH)
    for part in text_parts(batches, 2048):
        yield part, entries(part.column("x"), size), *(entries(part.column(c), blocks).view("<f8") for c in ("sums", "squares"))


def cluster_sums(rows: DataFrame, centroids: list[list[int]]) -> list:
    """A row ``(cluster, n, s0, s1, ...)`` of exact sums for each non-empty cluster: a task sends one of each."""
    size = len(centroids[0])
    names = [f"s{i}" for i in range(size)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(centroids)
        n = np.zeros(len(centroids), np.int64)
        total = np.zeros((len(centroids), size), object)
        for _, x, sums, squares in _batches(batches, size):
            best, _ = near.of(x, sums, squares)
            wide = x.astype(object) if len(x) and max(x.max(), -int(x.min())) > PLAIN else x
            n += np.bincount(best, minlength=len(n))
            for c in np.unique(best):
                total[c] += np.array(wide[best == c].sum(axis=0).tolist(), object)
        some = np.flatnonzero(n)
        sums = [pa.array([Decimal(int(v)) for v in total[some, i]], pa.decimal128(38, 0)) for i in range(size)]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n[some]), *sums], ["cluster", "n", *names])

    parts = rows.mapInArrow(run, "cluster int, n long, " + ", ".join(f"{c} decimal(38,0)" for c in names))
    return parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in names]).collect()


def cluster(vectors: DataFrame, size: int = SIZE, k: int = CENTROIDS, rounds: int = ROUNDS, seed: int = SEED) -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256)`` of each row of ``vectors (vec_id, embedding, ...)`` kept.

    Kept are vectors of exactly ``size`` finite entries. The ``k`` of them with the least sha256 of ``<seed>:<vec_id>``
    are the first centroids (rows of one vec_id by their entries; a null vec_id comes last); with fewer vectors there are
    fewer. Null and repeated vec_ids get a row for a row. An empty table gives an empty one; other columns are ignored.
    Entries over 2 ** 25 are reckoned with Python's integers. A distance or inertia that doesn't fit a long is null.
    """
    spark, scratch = vectors.sparkSession, Scratch(vectors.sparkSession, "clustering")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    rows = scratch.save(compressed(quantised(vectors, size), size), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = rows.orderBy(order.asc_nulls_last(), "x").select("x").limit(k).collect()
    if not first:
        return spark.createDataFrame([], f"vec_id {kind}, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = [np.frombuffer(r.x, "<i8").tolist() for r in first]
    for _ in range(rounds):
        for r in cluster_sums(rows, centroids):
            centroids[r.cluster] = [int(s) // r.n for s in r[2:]]  # Python's division rounds down

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near = Nearest(centroids)
        for part, x, sums, squares in _batches(batches, size):
            best, distance = near.of(x, sums, squares)
            exact = pa.array([Decimal(int(d)) for d in distance], pa.decimal128(38, 0)) if distance.dtype == object else pa.array(distance).cast(pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(best.astype(np.int32)), exact], ["vec_id", "cluster", "distance"])

    near = scratch.save(rows.mapInArrow(run, f"vec_id {kind}, cluster int, distance decimal(38,0)"), "nearest")
    sums = {r.cluster: int(r.s) for r in near.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows at most
    text = lambda c: hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()
    told = [(c, Decimal(s), Decimal(sum(sums.values())), text(centroids[c])) for c, s in sums.items()]
    each = spark.createDataFrame(told, "cluster int, cluster_inertia decimal(38,0), inertia decimal(38,0), centroid_sha256 string")
    long = lambda c: F.col(c).try_cast("long").alias(c)
    return near.join(F.broadcast(each), "cluster").select("vec_id", "cluster", long("distance"), long("cluster_inertia"), long("inertia"), "centroid_sha256")  # k rows at most


def _sql() -> str:
    distance = "list_sum(list_transform(list_zip(x, y), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    near = f"SELECT vec_id, x, c, {distance} AS d FROM v, {{0}} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY d, c) = 1"
    parts = [
        f"v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda e: floor({SCALE} * e::DOUBLE)::BIGINT) AS x FROM embeddings WHERE len(embedding) = {SIZE} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {SIZE})",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h)::INT - 1 AS c, x AS y FROM (SELECT sha256('{SEED}:' || vec_id) AS h, x FROM v ORDER BY h LIMIT {CENTROIDS}))",
    ]
    for r in range(ROUNDS):
        parts += [
            f"a{r} AS MATERIALIZED ({near.format(f'c{r}')})",
            f"s{r} AS MATERIALIZED (SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{r}, range(1, {SIZE + 1}) t(i) GROUP BY c, i)",
            f"c{r + 1} AS MATERIALIZED (SELECT c{r}.c, coalesce(z, y) AS y FROM c{r} LEFT JOIN (SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS z FROM s{r} GROUP BY c) USING (c))",
        ]
    last = f"c{ROUNDS}"
    parts.append(f"e AS MATERIALIZED ({near.format(last)})")
    return f"""WITH {', '.join(parts)} SELECT vec_id, e.c AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY e.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
sha256(array_to_string(y, ',')) AS centroid_sha256 FROM e JOIN {last} USING (c)"""


OP13_SQL = _sql()


def op13_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cluster of each embedding after five exact rounds, with its distance and the clusters' figures."""
    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
