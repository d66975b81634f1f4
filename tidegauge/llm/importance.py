"""Quality by importance resampling: hashed n-gram models of target and raw text, sampled by Gumbel top-k (Xie et al., DSIR, 2023)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import hash_sample, text_parts, word_hashes

BUCKETS = 1 << 17
#: The part of the labelled good documents whose ratio the number of kept documents is set to reach.
SPARED = 0.98
#: Labelled rows that the target model is fitted on at most; beyond that, a sample by hash.
MAX_LABELLED = 20_000
SEED = 42


def ngram_buckets(text: bytes, buckets: int = BUCKETS) -> np.ndarray:
    """The buckets of the words and pairs of words of a text in lower case."""
    h = word_hashes(text.lower().split())
    with np.errstate(over="ignore"):
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
    pairs ^= pairs >> np.uint64(32)
    return (np.concatenate([h, pairs]) % np.uint64(buckets)).astype(np.int64)


def ngram_totals(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all of ``texts (text)``."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for part in text_parts(batches):
            found = [ngram_buckets(text or b"", buckets) for text in part.column("text").to_pylist()]
            total += np.bincount(np.concatenate(found), minlength=buckets)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for bucket, n in texts.select(F.col("text").cast("binary").alias("text")).mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = n
    return out


def log_ratios(target: np.ndarray, raw: np.ndarray, pseudo: float = 4.0, least_z: float = 3.0) -> np.ndarray:
    """log(p_target / p_raw) of each bucket, both models smoothed by ``pseudo`` counts on the target's scale.

    A ratio shrinks by the part of it that chance explains: to 0 where the target's count is within ``least_z`` standard
    deviations of what the raw model expects. So n-grams that are too rare to tell say nothing, and good documents that
    the target model hasn't seen score like those that it was fitted on.
    """
    share = target.sum() / max(1, raw.sum())
    expected = share * raw
    z = np.abs(target - expected) / np.sqrt(expected * (1 - share) + 1e-9)
    return np.log((target + pseudo) / (expected + pseudo)) * np.maximum(0.0, 1 - (least_z / np.maximum(z, 1e-9)) ** 2)


def kth_largest(keys: DataFrame, column: str, k: int) -> float | None:
    """The k-th largest value of a double column of a written table, exactly: its bits are found 16 at a time by counting."""
    # The order of doubles as longs: negative ones have their other bits flipped. Shifts by 48, 32, 16 and 0 bits.
    bits = keys.select(_order_bits(column).alias("b"))
    prefix, left = None, k
    for shift in (48, 32, 16, 0):
        rows = bits if prefix is None else bits.where(F.shiftright("b", shift + 16) == prefix)
        counts = sorted(rows.groupBy(F.shiftright("b", shift).alias("p")).count().collect(), reverse=True)  # 65,536 rows at most
        for p, n in counts:
            if left <= n:
                prefix = p
                break
            left -= n
        else:
            return None
    b = prefix if prefix >= 0 else prefix ^ ((1 << 63) - 1)
    return float(np.int64(b).view(np.float64))


def _order_bits(column: str):
    @F.pandas_udf("long")
    def of(values):
        b = values.to_numpy(np.float64).view(np.int64)
        return values.__class__(np.where(b < 0, b ^ np.int64((1 << 63) - 1), b))

    return of(F.col(column))


def resample(docs: DataFrame, labels: DataFrame, keep: float | None = None, seed: int = SEED, most: int = MAX_LABELLED, spared: float = SPARED) -> DataFrame:
    """``(doc_id, log_ratio, gumbel_key, kept)`` of each row of ``docs (doc_id, text, ...)``.

    The target model counts the n-grams of the documents that ``labels (doc_id, quality, toxic)`` calls good and not
    toxic; the raw model those of all documents. A document's log_ratio is the sum over its n-grams; its key adds Gumbel
    noise from the hash of (doc_id, seed). The ``keep`` share with the largest keys is kept, which draws without
    replacement in proportion to the ratios; without ``keep``, as many as have at least the ratio that a part ``spared``
    of the labelled good documents reach. Ties with the last key are kept too.

    A null text counts as empty: log_ratio 0. Null and repeated doc_ids get a row for a row. Without labels all ratios
    are 0; an empty table gives an empty one; other columns are ignored. A text of any length is read whole.
    """
    scratch = Scratch(docs.sparkSession, "importance")
    known = hash_sample(labels.where("doc_id is not null"), "doc_id", most)
    good = known.where((F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)).select("doc_id").distinct()
    raw = ngram_totals(docs)
    target = ngram_totals(docs.join(F.broadcast(good), "doc_id", "left_semi"))  # most is the bound
    ratios = log_ratios(target, raw) if target.any() else np.zeros(BUCKETS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            sums = [float(ratios[ngram_buckets(t or b"")].sum()) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sums, pa.float64())], ["doc_id", "log_ratio"])

    scored = docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, log_ratio double")
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    scored = scratch.save(scored.withColumn("gumbel_key", F.col("log_ratio") - F.log(-F.log(unit))), "scored")
    n = scored.count()
    if keep is None:
        cut = scored.join(F.broadcast(good), "doc_id").agg(F.percentile("log_ratio", 1 - spared)).first()[0]  # most is the bound
        keep = scored.where(F.col("log_ratio") >= cut).count() / n if cut is not None else 1.0
    last = kth_largest(scored, "gumbel_key", max(1, round(keep * n))) if n else None
    return scored.withColumn("kept", F.col("gumbel_key") >= F.lit(last if last is not None else 0.0))


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log importance ratio, the Gumbel key and whether it is sampled, for each document."""
    return resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
