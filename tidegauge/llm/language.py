"""Language identification: TF-IDF n-gram vectors against several centroids per language, with rejection by distance."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.texts import text_parts

UNKNOWN = "und"
#: Hash buckets of the character n-grams of one to three characters.
BUCKETS = 4096
#: Different labelled texts per language that the centroids are clustered from at most, chosen by hash; document frequencies use all.
PER_LANGUAGE = 500
CENTROIDS = 4
#: A text is rejected if its similarity is below this part of what the least similar hundredth of its centroid's texts have.
REJECT = 0.4
_LETTER = regex.compile(r"\p{L}")


def ngram_counts(text: str, buckets: int = BUCKETS) -> np.ndarray:
    """Counts of the hashed n-grams of one to three characters, in lower case, each run of other characters than letters as one space."""
    a = np.frombuffer(re.sub(r"[\W\d_]+", " ", f" {text.lower()} ").encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    total = np.zeros(buckets, np.int64)
    code = np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(3):
            code = code[: len(a) - n] * np.uint64(0x100000001B3) + a[n:] + np.uint64(n + 1)
            mixed = (code ^ code >> np.uint64(31)) * np.uint64(0x9E3779B97F4A7C15)
            total += np.bincount((mixed >> np.uint64(40)).astype(np.int64) % buckets, minlength=buckets)
    return total


def vector(text: str, idf: np.ndarray) -> np.ndarray:
    """The normalised TF-IDF vector, with square roots of the counts."""
    v = np.sqrt(ngram_counts(text, len(idf))) * idf
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


@dataclass
class Centroids:
    idf: np.ndarray
    languages: list[str]
    centres: np.ndarray
    owner: np.ndarray
    radius: np.ndarray

    def nearest(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text, its language's place, the cosine, and whether it is too far away."""
        cosine = np.stack([vector(t, self.idf) for t in texts]) @ self.centres.T
        best = cosine.argmax(axis=1)
        top = cosine[np.arange(len(texts)), best]
        return self.owner[best], np.clip(top, 0.0, 1.0), top < self.radius[best]


def _cluster(x: np.ndarray, k: int, rounds: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Spherical k-means from far-apart first centres; and each row's centre."""
    centres = [x.mean(axis=0)]
    while len(centres) < min(k, len(x)):
        centres.append(x[np.max(x @ np.stack(centres).T, axis=1).argmin()])
    c = np.stack(centres)
    for _ in range(rounds):
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
        own = (x @ c.T).argmax(axis=1)
        c = np.stack([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))])
    c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c, (x @ c.T).argmax(axis=1)


def document_frequencies(docs: DataFrame, buckets: int = BUCKETS) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs`` each n-gram bucket occurs, and the number of texts."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(buckets + 1, np.int64)
        for part in text_parts(batches):
            for text in part.column("text").to_pylist():
                seen[:buckets] += ngram_counts(text, buckets) > 0
                seen[buckets] += 1
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets + 1)), pa.array(seen)], ["bucket", "n"])

    out = np.zeros(buckets + 1, np.int64)
    for bucket, n in docs.select("text").mapInArrow(partial, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket
        out[bucket] = n
    return out[:buckets], int(out[buckets])


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, centroids: int = CENTROIDS, reject: float = REJECT) -> Centroids | None:
    """Centroids learned from ``docs (doc_id, text, lang)``, null texts and langs left out; None if nothing is left."""
    known = docs.where("text is not null and lang is not null")
    seen, n = document_frequencies(known)
    if not n:
        return None
    idf = np.log((1 + n) / (1 + seen)) + 0.1
    known = known.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = known.groupBy("lang", "h").agg(F.count(F.lit(1)).alias("n")).groupBy("lang").agg(F.count(F.lit(1)).alias("count"))
    share = F.least(F.lit(1.0), F.lit(1.3 * per_language) / F.col("count"))
    drawn = known.join(F.broadcast(counts), "lang").where((F.pmod(F.xxhash64("h", F.lit("fit")), F.lit(1 << 20)) <= share * (1 << 20)))  # a row a language
    some: dict[str, list[str]] = {}
    for row in drawn.groupBy("lang", "h").agg(F.first("text").alias("text")).orderBy("lang", "h").toLocalIterator():
        if len(some.setdefault(row["lang"], [])) < per_language:
            some[row["lang"]].append(vector(row["text"], idf))
    languages, centres, owner, radius = sorted(some), [], [], []
    for i, lang in enumerate(languages):
        x = np.stack(some[lang])
        c, own = _cluster(x, centroids)
        cosine = (x * c[own]).sum(axis=1)
        for j in range(len(c)):
            centres.append(c[j])
            owner.append(i)
            radius.append(reject * float(np.quantile(cosine[own == j], 0.01)) if (own == j).any() else 2.0)
    return Centroids(idf, languages, np.stack(centres), np.array(owner), np.array(radius))


def identify(docs: DataFrame, model: Centroids | None) -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` and ``rejected`` added.

    The prediction is the nearest centroid's language, from the text alone; the score is its cosine. A text that is
    null or has no letter, or any text without a model, is ``und``, 0 and rejected; one that is farther from its nearest
    centroid than the model allows is rejected too, with the nearest language named. Columns of ``docs`` with these
    three names are replaced; any others stay. Repeated rows get a row for a row; an empty table gives an empty one. A
    text of any length is read whole, in one task.
    """
    own = [f for f in docs.schema.fields if f.name not in ("lang_pred", "score", "rejected")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            texts = part.column("text").to_pylist()
            lang, score, rejected = [UNKNOWN] * len(texts), [0.0] * len(texts), [True] * len(texts)
            legible = [i for i, t in enumerate(texts) if model and t and _LETTER.search(t)]
            if legible:
                for i, place, cosine, far in zip(legible, *(x.tolist() for x in model.nearest([texts[i] for i in legible])), strict=True):
                    lang[i], score[i], rejected[i] = model.languages[place], cosine, far
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], [*part.schema.names, "lang_pred", "score", "rejected"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
    return docs.select(*[f"`{f.name}`" for f in own]).mapInArrow(run, f"{schema}, lang_pred string, score double, rejected boolean")


def held_out() -> "F.Column":
    """A quarter of the documents, which are never learned from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def keep_identified(docs: DataFrame) -> DataFrame:
    """``docs`` without those that a model learned from their own ``lang`` rejects."""
    model = fit(docs.where(~held_out()).select("doc_id", "text", "lang"))
    return identify(docs, model).where("not rejected").select(*docs.columns)


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of each document, learned from those that aren't held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    model = fit(docs.where(~held_out()))
    return identify(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "rejected")
