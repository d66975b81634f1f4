"""Connected components: union-find within bounded parts of the links, then alternating large-star and small-star steps
(Kiveris et al., 2014) over what the parts leave."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch

#: Links that one task joins at first, about; fewer links than that need no further step.
PART_LINKS = 100_000


def _lowest(edges: DataFrame, key: str, value: str) -> DataFrame:
    return edges.groupBy(F.col(key).alias("centre")).agg(F.min(value).alias("low"))


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours move to the least node around it."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = _lowest(both, "a", "b").select("centre", F.least("centre", "low").alias("low"))
    return both.join(low, F.col("a") == F.col("centre")).where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its smaller neighbours move to the least of these."""
    low = _lowest(edges, "a", "b")
    moved = edges.join(low, F.col("a") == F.col("centre")).where("b > low").select(F.col("b").alias("a"), F.col("low").alias("b"))
    return moved.unionByName(low.select(F.col("centre").alias("a"), F.col("low").alias("b")))


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of one part, each node with the least node that they connect it to."""
    up: dict[int, int] = {}

    def top(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    pairs = [(x, top(x)) for x in list(up)]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in pairs], pa.int64()), pa.array([y for _, y in pairs], pa.int64())], ["a", "b"])


def connected_components(links: DataFrame, scratch: Scratch, part_links: int = PART_LINKS) -> DataFrame:
    """``(node, root)`` of every node in ``links (a, b)``; root is the component's least node.

    Nodes are longs in Spark's order; self links and nulls are ignored. Parts of about ``part_links`` links are joined
    alone; beyond one part, rounds of an aggregate and a join on the node follow, never a list of a node's neighbours,
    each written to the shared folder. It ends when a round changes nothing, which the paper bounds by the squared
    logarithm of the number of nodes.
    """
    edges = links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before, n = scratch.save(edges, "links"), None, 0
    parts = 1 + edges.count() // part_links
    edges = scratch.save(edges.repartition(parts).mapInArrow(_stars, "a long, b long"), "edges0")
    while parts > 1:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1)))).first()
        if now == before or not now[0]:
            break
        before, n = now, n + 1
        edges = scratch.save(_small_star(_large_star(edges).distinct()).distinct(), f"edges{n}")
        scratch.drop(f"edges{n - 1}")
    scratch.drop("links")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
