"""Near-duplicate documents by SimHash, found with the generalised pigeonhole principle.

Two fingerprints that differ in at most ``tau`` of 64 bits, cut into partitions that get ``u`` units each with
``sum(u) = tau + 1``, differ in less than ``u`` bits of at least one partition (Qin et al., GPH, ICDE 2018). A
partition of ``u`` units is probed by the keys that leave out each choice of ``u - 1`` of its bits. Bits that are
correlated share a partition; the number of partitions and the units come from a dynamic programme that weighs the
keys written against the candidates that the block histograms of all fingerprints predict.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.components import connected_components
from tidegauge.llm.scratch import Scratch
from tidegauge.llm.similar import similar_groups
from tidegauge.llm.texts import apart, shingle_bounds

ALL = (1 << 64) - 1
#: Rows of one bucket that are compared with each other; a larger bucket is cut by further bits instead.
BUCKET_ROWS = 4096
#: Relative costs of writing a key and of comparing a pair.
KEY_COST, PAIR_COST = 1.0, 0.005
_BIT = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.float64)


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, width: int) -> int:
    """The 64-bit SimHash of a text's word shingles; 0 for a text without words, and for null."""
    words = text.lower().split() if text else []
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in zip(*shingle_bounds(words, width), strict=True)], "<u8")
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ _BIT for k in range(8)])
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """``(doc_id, fp)`` of each row of ``docs``, fp as a signed long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([signed(fingerprint(t, width)) for t in texts], dtype="int64")

    return docs.select("doc_id", of(F.col("text").cast("binary")).alias("fp"))


# ---- layout of the keys ----------------------------------------------------------------------------------------


def bit_counts(fps: DataFrame) -> np.ndarray:
    """How many fingerprints have bits i and j both set: 64 x 64 sums over all rows."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64))
        for batch in batches:
            x = np.unpackbits(batch.column(0).to_numpy().view("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += x.T @ x
        i, j = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(i * 64 + j), pa.array(total[i, j])], ["cell", "n"])

    out = np.zeros(64 * 64)
    for cell, n in fps.select("fp").mapInArrow(partial, "cell long, n double").groupBy("cell").agg(F.sum("n")).collect():  # 4096 cells at most
        out[cell] = n
    return out.reshape(64, 64)


def correlated_order(both: np.ndarray, n: int) -> list[int]:
    """Bits in an order that keeps correlated ones together: each next bit is the one most correlated with the eight before it."""
    p = np.diag(both) / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(corr, 0)
    order = [int(corr.max(axis=1).argmax())]
    while len(order) < 64:
        gain = corr[order[-8:]].sum(axis=0)
        gain[order] = -1
        order.append(int(gain.argmax()))
    return order


def block_histograms(fps: DataFrame, order: list[int], width: int = 8) -> np.ndarray:
    """Counts over all rows of the values of each run of ``width`` bits in ``order``: 64 / width x 2 ** width."""
    place = np.array(order, dtype=np.uint64)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64 // width, 1 << width), np.int64)
        for batch in batches:
            x = batch.column(0).to_numpy().view("<u8")
            for k in range(64 // width):
                value = sum((((x >> place[k * width + i]) & np.uint64(1)) << np.uint64(i) for i in range(width)), np.zeros(len(x), np.uint64))
                total[k] += np.bincount(value.astype(np.int64), minlength=1 << width)
        k, v = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k * (1 << width) + v), pa.array(total[k, v])], ["cell", "n"])

    out = np.zeros(64 // width << width)
    for cell, n in fps.select("fp").mapInArrow(partial, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # 2048 cells
        out[cell] = n
    return out.reshape(64 // width, -1)


def bit_distances(histograms: np.ndarray) -> np.ndarray:
    """Of each bit in the order, the chance that two rows differ in it, from the blocks' distance distributions."""
    width = int(np.log2(histograms.shape[1]))
    values, out = np.arange(histograms.shape[1]), []
    for h in histograms:
        p = h / max(h.sum(), 1)
        # Correlated bits differ together: the block's chance of no difference, spread over its bits.
        same = max(float((p * p).sum()), 1e-9)
        differ = [2 * float(p[values >> i & 1 == 1].sum()) * float(p[values >> i & 1 == 0].sum()) for i in range(width)]
        free = np.log(np.maximum(1 - np.array(differ), 1e-9))
        scale = np.log(same) / free.sum() if free.sum() < -1e-9 else 1.0
        out += list(1 - np.exp(free * min(scale, 1.0)))
    return np.array(out)


def _within(chances: np.ndarray, limit: int) -> float:
    """The chance of at most ``limit`` differences."""
    dist = np.zeros(limit + 2)
    dist[0] = 1
    for c in chances:
        dist[1:] = dist[1:] * (1 - c) + dist[:-1] * c
        dist[0] *= 1 - c
        dist[limit + 1] = 0
    return float(dist[: limit + 1].sum())


def allocate(order: list[int], chances: np.ndarray, n: int, tau: int) -> list[int]:
    """The masks of the cheapest layout: over 2 to 8 partitions, the units of each by dynamic programming."""
    best: tuple[float, list[tuple[list[int], int]]] = (np.inf, [])
    for m in range(2, min(9, tau + 2)):
        edges = [round(64 * k / m) for k in range(m + 1)]
        plan: dict[int, tuple[float, list[tuple[list[int], int]]]] = {0: (0.0, [])}
        for a, b in zip(edges, edges[1:], strict=False):
            cost = {0: 0.0} | {u: n * KEY_COST * comb(b - a, u - 1) + n * n / 2 * PAIR_COST * _within(chances[a:b], u - 1) for u in range(1, min(tau + 1, 4) + 1)}
            step: dict[int, tuple[float, list[tuple[list[int], int]]]] = {}
            for spent, (so_far, chosen) in plan.items():
                for u, c in cost.items():
                    if spent + u <= tau + 1 and so_far + c < step.get(spent + u, (np.inf,))[0]:
                        step[spent + u] = (so_far + c, [*chosen, (order[a:b], u)])
            plan = step
        if tau + 1 in plan and plan[tau + 1][0] < best[0]:
            best = plan[tau + 1]
    return [mask for bits, u in best[1] for mask in _masks(tuple(bits), u)]


@lru_cache(maxsize=4096)
def _masks(bits: tuple[int, ...], units: int, fixed: int = 0) -> list[int]:
    if not units:
        return []
    full = sum(1 << b for b in bits)
    return [fixed | full & ~sum(1 << b for b in out) for out in combinations(bits, units - 1)]


def refine(mask: int, tau: int) -> tuple[list[int], bool]:
    """Masks that find, among rows that agree on ``mask``, all pairs within tau; True if every row of their buckets is within tau."""
    free = tuple(b for b in range(64) if not mask >> b & 1)
    if comb(len(free), min(tau, len(free))) <= 1024:
        return [ALL & ~sum(1 << b for b in out) for out in combinations(free, min(tau, len(free)))], True
    parts = max(2, min(len(free) // 8, (tau + 1 + 1) // 2))
    cuts = [round(len(free) * k / parts) for k in range(parts + 1)]
    units = [(tau + 1) // parts + (k < (tau + 1) % parts) for k in range(parts)]
    return [m for k in range(parts) for m in _masks(free[cuts[k] : cuts[k + 1]], units[k], mask)], False


# ---- probing and verifying -------------------------------------------------------------------------------------


def _bucket_links(fp: np.ndarray, tau: int) -> tuple[list[int], list[int]]:
    """A spanning forest of the links in one bucket, breadth first: each row is compared with those not yet reached."""
    left, queue, a, b = fp.copy(), [], [], []
    while len(left) or queue:
        if not queue:
            queue, left = [left[0]], left[1:]
        x = queue.pop()
        near = np.bitwise_count(left ^ x) <= tau
        if near.any():
            found = left[near]
            a += [int(x)] * len(found)
            b += found.tolist()
            queue += list(found)
            left = left[~near]
    return a, b


def _links_of(mask: np.ndarray, key: np.ndarray, fp: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links in a sorted stretch of whole buckets."""
    start = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (mask[1:] != mask[:-1])]))
    length = np.diff(np.append(start, len(fp)))
    a, b = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint64)]
    small = np.repeat(length <= 8, length)
    for lag in range(1, 8):  # all small buckets at once
        i = np.flatnonzero(small[:-lag] & (key[lag:] == key[:-lag]) & (mask[lag:] == mask[:-lag]))
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= tau]
        a.append(fp[i])
        b.append(fp[i + lag])
    for s, n in zip(start[length > 8].tolist(), length[length > 8].tolist(), strict=True):
        x, y = _bucket_links(fp[s : s + n], tau)
        a.append(np.array(x, np.uint64))
        b.append(np.array(y, np.uint64))
    return np.concatenate(a), np.concatenate(b)


def _linker(tau: int):
    """mapInArrow function over rows sorted by (mask, key); holds one bucket more than a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.uint64)] * 3

        def out(cols: list[np.ndarray]) -> pa.RecordBatch:
            a, b = _links_of(*cols, tau)
            pairs = np.unique(np.stack([a, b]).view(np.int64), axis=1) if len(a) else np.zeros((2, 0), np.int64)
            return pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])

        for batch in batches:
            held = [np.concatenate([h, batch.column(k).to_numpy().view(np.uint64)]) for k, h in enumerate(held)]
            if not len(held[0]):
                continue
            differ = np.flatnonzero((held[0] != held[0][-1]) | (held[1] != held[1][-1]))
            if len(differ):  # all but the last bucket are whole
                cut = differ[-1] + 1
                yield out([h[:cut] for h in held])
                held = [h[cut:] for h in held]
        if len(held[0]):
            yield out(held)

    return run


def fingerprint_links(fps: DataFrame, scratch: Scratch, tau: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(a, b)``: links that connect all of the distinct, non-null ``fp`` values within ``tau`` bits of each other.

    ``fps`` is a written table. Buckets of more than ``bucket_rows`` fingerprints are cut by further bits, again and
    again, until a bucket's rows are all within ``tau`` of each other and one link each is enough; so no bucket is
    compared beyond that size, and none is skipped.
    """
    n = fps.count()
    order = correlated_order(bit_counts(fps), n)
    masks = allocate(order, bit_distances(block_histograms(fps, order)), n, tau)
    rows = fps.select("fp", F.explode(F.array(*[F.lit(signed(m)) for m in masks])).alias("mask"))
    found, level = [], 0
    while True:
        keyed = rows.select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        large = scratch.save(keyed.groupBy("mask", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > bucket_rows).select("mask", "key"), f"large{level}")
        some = not large.isEmpty()
        cold = keyed.join(large, ["mask", "key"], "left_anti") if some else keyed
        found.append(cold.repartition("mask", "key").sortWithinPartitions("mask", "key").mapInArrow(_linker(tau), "a long, b long"))
        if not some:
            break
        hot = keyed.join(large, ["mask", "key"]).select("mask", "fp")
        finer = {r[0]: refine(r[0] & ALL, tau) for r in large.select("mask").distinct().collect()}  # masks, not rows
        table = fps.sparkSession.createDataFrame([(m, signed(x), near) for m, (xs, near) in finer.items() for x in xs], "mask long, finer long, near boolean")
        hot = scratch.save(hot.join(F.broadcast(table), "mask").select(F.col("finer").alias("mask"), "fp", "near").distinct(), f"hot{level}")
        near = hot.where("near").select("mask", F.col("mask").bitwiseAND(F.col("fp")).alias("key"), "fp")
        least = near.groupBy("mask", "key").agg(F.min("fp").alias("b"))
        found.append(near.join(least, ["mask", "key"]).where("fp <> b").select(F.col("fp").alias("a"), "b"))
        rows, level = hot.where("not near").select("fp", "mask"), level + 1
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def near_duplicates(docs: DataFrame, width: int = 3, tau: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of every row of ``docs (doc_id, text, ...)``.

    component_id is the least doc_id that is reachable by links of at most ``tau`` differing bits.

    Null texts, and texts without words, have fingerprint 0 and are linked like any other. Rows with a null doc_id get
    the least doc_id of their component, null if it has none. Repeated rows get a row each. An empty table gives an
    empty one. Other columns are ignored, whatever their names. A text of any length is one value in one task.
    """
    spark: SparkSession = docs.sparkSession
    scratch = Scratch(spark, "simhash")
    return fingerprint_components(scratch.save(fingerprints(docs, width), "own"), scratch, tau, bucket_rows)


def fingerprint_components(own: DataFrame, scratch: Scratch, tau: int = 3, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``(doc_id, fp, component_id)`` of each row of the written table ``own (doc_id, fp)``, see ``near_duplicates``."""
    first = scratch.save(own.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "first")
    links = fingerprint_links(first, scratch, tau, bucket_rows)
    member = connected_components(links, scratch)
    rooted = first.join(member.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "doc_id", F.coalesce("root", "fp").alias("root"))
    label = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    return own.join(rooted.select("fp", "root").join(label, "root").select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 5, min_jaccard: float = 0.8) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that of the least doc_id.

    Groups are connected by all pairs that share ``min_jaccard`` of their shingles. Candidates come from SimHash first: members
    of a fingerprint component are checked exactly. As SimHash differs in more bits than any small bound for a good part of the
    pairs at 0.8, an exact join completes these groups. A row is named by doc_id and
    text, so a different text under a kept doc_id, or under none, stays unless its own group has a lesser row; rows
    without a doc_id come last, and rows that repeat both go too.
    """
    scratch = Scratch(docs.sparkSession, "keep")
    prints = scratch.save(fingerprints(docs.select(F.xxhash64("text").alias("doc_id"), "text")).distinct(), "prints")  # a row a text
    alike = scratch.save(fingerprint_components(prints, scratch).select(F.col("doc_id").alias("body"), F.col("component_id").alias("token")), "alike")
    groups = scratch.save(similar_groups(docs, width, min_jaccard, alike=alike), "groups")
    name = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "body")
    rows = groups.groupBy("doc_id", "body", "root").agg(F.count(F.lit(1)).alias("n")).withColumn("salt", F.pmod(F.xxhash64("doc_id", "body"), F.lit(64)))
    low = rows.groupBy("root", "salt").agg(F.min(name).alias("first")).groupBy("root").agg(F.min("first").alias("first"), F.collect_list("salt").alias("salts"))
    first = low.select("root", "first", F.explode("salts").alias("salt"))  # a large group is dealt out by salts
    told = rows.join(first.hint("merge"), ["root", "salt"]).select(F.col("doc_id").alias("_d"), F.col("body").alias("_b"), (~name.eqNullSafe(F.col("first"))).alias("_gone"), "n").where("_gone or n > 1").drop("n")
    told = scratch.save(told, "told")
    columns = docs.columns
    mine = apart(docs)
    marked = docs.withColumn(mine("own"), F.xxhash64("text")).join(told.select(*[F.col(c).alias(mine(c)) for c in told.columns]).hint("merge"), (F.col(mine("own")) == F.col(mine("_b"))) & F.col("doc_id").eqNullSafe(F.col(mine("_d"))), "left")
    repeated = marked.where(~F.col(mine("_gone"))).dropDuplicates(["doc_id", mine("own")])
    return marked.where(F.col(mine("_gone")).isNull()).unionByName(repeated).select(*columns)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of each document."""
    out = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
