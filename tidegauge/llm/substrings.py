"""Removal of repeated passages by seed and extend.

Seeds: of every ``length`` consecutive words (a window), the run of SEED_WORDS words with the least hash is its anchor
(winnowing, Schleimer et al., 2003), so windows with the same words have the same anchor, and one anchor serves a run
of neighbouring windows. Documents are joined on anchors; those that occur in one document only are done.

Extension: an anchor reaches to both sides over all the words of its windows. Occurrences that agree over all of them
form a class, in which all but the least document's windows are repeats. Only where one anchor has several classes, at
the ends of a repeat, are the windows of each class's least document compared one by one. Neighbouring repeated
windows merge to maximal repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import run_hashes, text_parts, word_hashes

LENGTH = 50
SEED_WORDS = 11
_RUN = "doc_id long, body long, h long, c1 long, c2 long, start int, n int"
_WINDOW = "doc_id long, body long, w1 long, w2 long, start int"


def least_of_each(values: np.ndarray, width: int) -> np.ndarray:
    """Where the least of each ``width`` neighbours is; of equal ones, the last."""
    value, at, size = values, np.arange(len(values)), 1
    while size < width:
        step = min(size, width - size)
        right = value[step:] <= value[:-step]
        value, at = np.where(right, value[step:], value[:-step]), np.where(right, at[step:], at[:-step])
        size += step
    return at


def anchor_runs(words: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each run of windows with the same anchor: the anchor's hash, the first window and their number."""
    seed = min(SEED_WORDS, length)
    hashes = run_hashes(word_hashes(words), seed)
    anchor = least_of_each(hashes, length - seed + 1)
    start = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    return hashes[anchor[start]].view(np.int64), start, np.diff(np.append(start, len(anchor)))


def _ends(words: list[bytes]) -> np.ndarray:
    """Where each word ends, plus one, in the words joined by one space; 0 first."""
    return np.concatenate([[0], np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))])


def _digests(joined: bytes, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """128-bit hashes of stretches of the joined words, as two longs each."""
    digest = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join(digest(joined[a:b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)), "<i8").reshape(-1, 2)


def _find_runs(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            found: list[list[np.ndarray]] = []
            for doc, body, text in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.split()
                if len(words) < length:
                    continue
                h, start, n = anchor_runs(words, length)
                place = _ends(words)
                c = _digests(b" ".join(words), place[start], place[start + n - 1 + length] - 1)
                found.append([np.full(len(h), doc), np.full(len(h), body), h, c[:, 0], c[:, 1], start.astype(np.int32), n.astype(np.int32)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["doc_id", "body", "h", "c1", "c2", "start", "n"])

    return run


def _find_windows(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            found: list[list[np.ndarray]] = []
            for doc, body, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = text.split()
                start = np.unique(np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans]))
                place = _ends(words)
                w = _digests(b" ".join(words), place[start], place[start + length] - 1)
                found.append([np.full(len(w), doc), np.full(len(w), body), w[:, 0], w[:, 1], start.astype(np.int32)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*found, strict=True)], ["doc_id", "body", "w1", "w2", "start"])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    """``body`` tells rows with the same doc_id and different texts apart."""
    return docs.select("doc_id", F.xxhash64("text").alias("body"), F.col("text").cast("binary").alias("text"))


def _by_text(spans: DataFrame) -> DataFrame:
    return spans.groupBy("doc_id", "body").agg(F.collect_list(F.struct("start", "n")).alias("spans"))


def repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH) -> DataFrame:
    """``(doc_id, body, spans)``: the runs of windows, as (start, n), whose words also start in a document with a smaller doc_id."""
    texts = _texts(docs.where("doc_id is not null and text is not null"))
    runs = scratch.save(texts.mapInArrow(_find_runs(length), _RUN), "runs")
    context = ["h", "c1", "c2"]
    classes = runs.groupBy(*context).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"))
    anchors = classes.groupBy("h").agg(F.min("low").alias("least"), F.max("low").alias("most"), F.max("high").alias("top")).where("least < top")
    shared = classes.join(anchors, "h").select(*context, "low", "high", (F.col("least") < F.col("most")).alias("mixed")).where("mixed or low < high")
    seeds = runs.join(shared.hint("merge"), context).where("doc_id > low or mixed")
    seeds = scratch.save(seeds.select("doc_id", "body", "start", "n", (F.col("doc_id") > F.col("low")).alias("repeat")), "seeds")
    scratch.drop("runs")
    ends = scratch.save(_by_text(seeds.where("not repeat")), "ends")
    windows = texts.join(ends.hint("merge"), ["doc_id", "body"]).select("doc_id", "body", "text", "spans").mapInArrow(_find_windows(length), _WINDOW)
    windows = scratch.save(windows, "windows")
    first = windows.groupBy("w1", "w2").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    later = windows.join(first.hint("merge"), ["w1", "w2"]).where("doc_id > low").select("doc_id", "body", "start", F.lit(1).alias("n"))
    return scratch.save(_by_text(seeds.where("repeat").select("doc_id", "body", "start", "n").unionByName(later)), "repeats")


def _cut(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            out = []
            for doc, text, spans in zip(*(c.to_pylist() for c in part.columns), strict=True):
                words = (text or b"").split()
                edge = np.zeros(len(words) + 1, np.int64)
                for s in spans or ():  # the merged windows are the maximal repeats
                    edge[s["start"]] += 1
                    edge[s["start"] + s["n"] - 1 + length] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g] if spans else words
                bounds = np.flatnonzero(np.diff(np.concatenate([[0], gone, [0]]))).tolist()
                out.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode(), [{"first": a, "after": b} for a, b in zip(bounds[::2], bounds[1::2], strict=True)]))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("first", pa.int32()), ("after", pa.int32())]))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)] if out else [pa.array([], t) for t in kinds], ["doc_id", "n_words", "n_removed", "kept", "removed"])

    return run


def dedup_substrings(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept, removed)`` of each row of ``docs (doc_id, text, ...)``.

    A window is ``length`` consecutive words of one document. Words that are covered by a window whose words also start
    in a document with a smaller doc_id are removed; windows are judged on the input. kept: the other words, joined by
    one space; removed: the maximal removed runs of words, as (first, after).

    Null texts have no words. A row without a doc_id is neither cut nor a reason to cut; rows that share a doc_id are
    not repeats of each other, and get a row for a row. An empty table gives an empty one; other columns are ignored. A
    text of any length is one value in one task; a passage may repeat any number of times.
    """
    found = repeats(docs, Scratch(docs.sparkSession, "substrings"), length)
    joined = _texts(docs).join(found.hint("merge"), ["doc_id", "body"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_cut(length), "doc_id long, n_words long, n_removed long, kept string, removed array<struct<first int, after int>>")


def op4_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many words each document has and loses, and the digest of the kept ones."""
    out = dedup_substrings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))
