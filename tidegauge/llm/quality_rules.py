"""Quality rules: gradient-boosted trees over document statistics, after two fixed base rules."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import hash_sample, text_parts
from tidegauge.llm.trees import Forest, fit

#: Labelled rows that the trees are fitted on at most; beyond that, a sample by hash.
MAX_LABELLED = 20_000
#: Documents whose chance of good quality is below this are not kept.
LEAST_CHANCE = 0.35
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_digits", "n_upper", "n_marks", "n_distinct", "n_single"]
#: Features in the order of the matrix, and whether a higher value may only raise (1) or lower (-1) the chance.
MONOTONE = {"log_words": 0, "mean_word": 0, "symbol_rate": -1, "dup_line_rate": -1, "repeat_rate": -1, "digit_rate": 0, "upper_rate": 0, "mark_rate": 0, "distinct_rate": 0, "line_words": 0, "single_rate": 0}
_BYTE = np.arange(256)
_SYMBOL = np.isin(_BYTE, list(b"#*$%&|<>"))
_SPACE = np.isin(_BYTE, list(b" \t\n\r\x0b\x0c"))
_LEAD = (_BYTE & 0xC0) != 0x80
_DIGIT = np.isin(_BYTE, list(b"0123456789"))
_UPPER = np.isin(_BYTE, list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"))
_MARK = np.isin(_BYTE, list(b".,;:!?"))


def repeated_words(words: list[bytes], width: int = 3) -> tuple[int, int]:
    """Words in windows of ``width`` words found at least twice, the first included; and the number of different words."""
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(words) < width:
        return 0, len(number)
    code, room = ids[: len(ids) - width + 1], len(number)
    for k in range(1, width):
        if room > (1 << 62) // len(number):  # of different codes there are no more than windows
            code = np.unique(code, return_inverse=True)[1]
            room = len(code)
        code, room = code * len(number) + ids[k : len(ids) - width + 1 + k], room * len(number)
    order = np.argsort(code, kind="stable")
    same = code[order[1:]] == code[order[:-1]]
    twice = np.concatenate([[False], same]) | np.concatenate([same, [False]])
    covered = np.zeros(len(words) + 1, np.int64)
    np.add.at(covered, order[twice], 1)
    np.add.at(covered, order[twice] + width, -1)
    return int((np.cumsum(covered)[:-1] > 0).sum()), len(number)


def statistics(text: bytes) -> tuple[int, ...]:
    """The values of STATS for one text."""
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words = text.split()
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeats, distinct = repeated_words(words)
    single = sum(len(w) == 1 for w in words)
    of = lambda kind: int(counts[kind].sum())
    return len(words), of(_LEAD & ~_SPACE), of(_SYMBOL), len(lines) - len(set(lines)), repeats, len(lines), of(_DIGIT), of(_UPPER), of(_MARK), distinct, single


def document_stats(docs: DataFrame) -> DataFrame:
    """``(doc_id, *STATS)`` of each row of ``docs``, all long; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            rows = [statistics(t or b"") for t in part.column("text").to_pylist()]
            columns = np.array(rows, np.int64).reshape(-1, len(STATS)).T
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *map(pa.array, columns)], ["doc_id", *STATS])

    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS))


def features(stats: np.ndarray) -> np.ndarray:
    """The features of MONOTONE, from rows of STATS."""
    words, chars, symbols, dup, repeats, lines, digits, upper, marks, distinct, single = stats.T.astype(np.float64)
    w, c = np.maximum(words, 1), np.maximum(chars, 1)
    return np.stack([np.log1p(words), chars / w, symbols / c, dup / np.maximum(lines, 1), repeats / w, digits / c, upper / c, marks / w, distinct / w, words / np.maximum(lines, 1), single / w], axis=1)


def base_failed() -> "F.Column":
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def fit_rules(stats: DataFrame, labels: DataFrame, most: int = MAX_LABELLED) -> Forest | None:
    """Trees fitted on ``quality`` of about ``most`` labelled documents at most; None without any.

    A doc_id counts once, with the best of its labels and the least of its rows, so that the bound holds for any table.
    """
    named = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    rows = hash_sample(named, "doc_id", most)
    once = stats.join(F.broadcast(rows), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(*STATS)).alias("s")).select("doc_id", "quality", "s.*")  # most is the bound
    known = once.where(~base_failed()).orderBy("doc_id").toPandas()
    if known.empty:
        return None
    return fit(features(known[STATS].to_numpy()), known["quality"].to_numpy(np.float64), list(MONOTONE.values()))


def quality_rules(docs: DataFrame, labels: DataFrame, least: float = LEAST_CHANCE, most: int = MAX_LABELLED) -> DataFrame:
    """``(doc_id, *STATS, base_failed, chance, kept)`` of each row of ``docs (doc_id, text, ...)``.

    base_failed: fewer than 50 words, or more than half of them in repeated three-word windows. Others are kept if the
    trees, fitted on ``labels (doc_id, quality, ...)``, give a chance of at least ``least``; without labels the chance
    is null and all others are kept. A null text counts as empty and fails. Null and repeated doc_ids get a row for a
    row; an empty table gives an empty one; other columns are ignored. A text of any length is read whole, in one task.
    """
    stats = Scratch(docs.sparkSession, "rules").save(document_stats(docs), "stats")
    forest = fit_rules(stats, labels, most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.stack([batch.column(c).to_numpy() for c in STATS], axis=1)
            chance = pa.array(forest.scores(features(x))) if forest else pa.nulls(len(x), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, chance], [*batch.schema.names, "chance"])

    scored = stats.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in STATS) + ", chance double")
    return scored.withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & (F.coalesce("chance", F.lit(1.0)) >= least))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base statistics, whether they fail, and the verdict for each document."""
    out = quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "chance")
