"""Benchmark items inside documents: size-partitioned MinHash containment search, then exact shingle containment.

Items are partitioned by the power of two of their number of shingles. An item of q shingles of which a document holds
at least ``t * q`` shares with it one of any ``q - ceil(t * q) + 1`` shingles; those of the least hashes, a bottom-k
MinHash of the item with k from its own size, are the sketch. Comparing a document's shingles with them is a prefix
filter, so no leak is missed and recall needs no estimate. Each width's partitions bound the hashes of their sketches,
and a document's shingles above the largest bound are not sent. Banded MinHash of whole documents would
compare sets of 30 and 5,000 shingles, whose similarity is under 0.01: it would need hundreds of bands to find most
leaks, while this search finds all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import apart, word_array

SHINGLE = 5
CONTAINMENT = 0.8
#: Bytes of a side that is sent to every executor at most; beyond that, both sides are shuffled. A row of ids and hashes has 40.
BROADCAST_BYTES, ROW = 20_000_000, 40
#: Groups in which the items that one text may hold are verified.
GROUPS = 8


def _small(df: DataFrame, size: int, most: int) -> DataFrame:
    return F.broadcast(df) if size <= most else df


def _word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _shingle_hashes(hashed: Column, width: int) -> Column:
    """A 64-bit hash of ``width`` and each run of that many words, from the words' hashes, which must be a column; of fewer words, none."""
    runs = F.transform(F.sequence(F.lit(0), F.size(hashed) - width), lambda i: F.xxhash64(F.lit(width), *[F.get(hashed, i + k) for k in range(width)]))
    return F.when(F.size(hashed) >= width, runs)


def _probes(hashed: Column, width: int, top: int) -> Column:
    """The different shingle hashes up to ``top``."""
    return F.coalesce(F.filter(F.array_distinct(_shingle_hashes(hashed, width)), lambda h: h <= top), F.array().cast("array<bigint>"))


def _shingles(words: Column, width: int | Column) -> Column:
    """The different runs of ``width`` words, each joined by one space."""
    runs = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.array_join(F.slice(words, i + 1, width), " "))
    return F.array_distinct(F.when(F.size(words) >= width, runs).otherwise(F.array().cast("array<string>")))


def item_sketches(items: DataFrame, width: int, containment: float) -> DataFrame:
    """``(item_id, width, q, part, h)`` of each sketch shingle; an item of fewer than ``width`` words is one shingle of them all."""
    words = items.where("item_id is not null").select("item_id", word_array(F.col("text")).alias("words")).where(F.size("words") > 0)
    words = words.select("item_id", _word_hashes(F.col("words")).alias("words"))
    sized = [words.where(F.size("words") >= width).withColumn("width", F.lit(width))] + [words.where(F.size("words") == w).withColumn("width", F.lit(w)) for w in range(1, width)]
    out = None
    for w, rows in zip([width, *range(1, width)], sized, strict=True):
        hashes = F.array_sort(F.array_distinct(_shingle_hashes(F.col("words"), w)))
        one = rows.select("item_id", "width", F.size(hashes).alias("q"), hashes.alias("hashes"))
        out = one if out is None else out.unionByName(one)
    k = F.col("q") - F.ceil(F.col("q") * containment - 1e-9) + 1
    return out.select("item_id", "width", "q", F.floor(F.log2("q")).cast("int").alias("part"), F.explode(F.slice("hashes", F.lit(1), k.cast("int"))).alias("h"))


def leaks(docs: DataFrame, items: DataFrame, width: int = SHINGLE, containment: float = CONTAINMENT, most: int = BROADCAST_BYTES) -> DataFrame:
    """``(doc_id, item_id, n_shingles, n_shared, containment)``: each item and each document that holds at least that part of its shingles.

    Words are runs of letters and digits in lower case; shingles are ``width`` different runs of words, compared as
    text; an item of fewer words is one shingle of all of them. ``docs (doc_id, text, ...)`` and ``items (item_id, text,
    ...)``; null texts, texts without words and items without an id match nothing. Rows that share a doc_id, or have none,
    are one document with the most that any of its rows holds; likewise items. Empty tables give an empty one. Other
    columns are ignored. A text of any length is one value in one task; an item may leak any number of times.

    A text is searched and verified once, however many rows have it: two hashes of it name it. All widths are searched in
    one scan, and a text's words are taken apart once for up to GROUPS groups of the items that it may hold.
    """
    scratch = Scratch(docs.sparkSession, "leaks")
    sketch = scratch.save(item_sketches(items, width, containment), "sketch")
    bounds = {(r["width"], r["part"]): (r["top"], r["n"]) for r in sketch.groupBy("width", "part").agg(F.max("h").alias("top"), F.count(F.lit(1)).alias("n")).collect()}  # at most 64 sizes a width
    if not bounds:
        return docs.sparkSession.createDataFrame([], f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, item_id {items.schema['item_id'].dataType.simpleString()}, n_shingles long, n_shared long, containment double")
    tops = {w: max(t for (x, _), (t, _) in bounds.items() if x == w) for w in sorted({w for w, _ in bounds})}
    texts = docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("b1"), F.xxhash64(F.lit(1), "text").alias("b2"), "text")
    words = texts.select("b1", "b2", _word_hashes(word_array(F.col("text"))).alias("words"))
    probes = words.select("b1", "b2", F.explode(F.concat(*[_probes(F.col("words"), w, top) for w, top in tops.items()])).alias("h"))
    found = probes.join(_small(sketch.select("h", "item_id"), sum(n for _, n in bounds.values()) * ROW, most), "h")
    pairs = scratch.save(found.select("b1", "b2", "item_id").distinct(), "pairs")

    hit = pairs.select("b1", "b2").distinct()
    held = scratch.save(texts.join(_small(hit, hit.count() * ROW, most), ["b1", "b2"], "left_semi"), "held")
    item_words = items.select("item_id", word_array(F.col("text")).alias("words"))
    size = F.least(F.size("words"), F.lit(width))
    own = item_words.where(F.size("words") > 0).select("item_id", _shingles(F.col("words"), size).alias("own"), size.alias("width"))
    text_bytes = items.agg(F.coalesce(F.sum(F.octet_length("text") + ROW), F.lit(0))).first()[0]  # a word is in ``width`` shingles
    item = F.struct("item_id", "own", "width")
    asked = pairs.join(_small(own, width * text_bytes, most), "item_id").groupBy("b1", "b2", F.pmod(F.xxhash64("item_id"), F.lit(GROUPS)).alias("g")).agg(F.collect_list(item).alias("items"))
    once = held.groupBy("b1", "b2").agg(F.first("text").alias("text")).select("b1", "b2", word_array(F.col("text")).alias("words"))
    asked_for = lambda w: F.when(F.exists("items", lambda i: i["width"] == w), _shingles(F.col("words"), w))
    both = asked.join(once, ["b1", "b2"]).select("b1", "b2", "items", *[asked_for(w).alias(f"s{w}") for w in tops])
    of = lambda i: F.coalesce(*[F.when(i["width"] == w, F.col(f"s{w}")) for w in tops])
    shared = both.select("b1", "b2", F.explode(F.transform("items", lambda i: F.struct(i["item_id"].alias("item_id"), F.size(i["own"]).alias("n_shingles"), F.size(F.array_intersect(i["own"], of(i))).alias("n_shared")))).alias("x")).select("b1", "b2", "x.*")
    shared = scratch.save(shared.where(F.col("n_shared") >= F.col("n_shingles") * containment - 1e-9), "shared")
    named = held.select("doc_id", "b1", "b2").join(_small(shared, shared.count() * ROW, most), ["b1", "b2"])
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct((F.col("n_shared") / F.col("n_shingles")).alias("containment"), "n_shingles", "n_shared")).alias("best"))
    return best.select("doc_id", "item_id", F.col("best.n_shingles").cast("long").alias("n_shingles"), F.col("best.n_shared").cast("long").alias("n_shared"), "best.containment")


def without_leaks(docs: DataFrame, items: DataFrame, width: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """``docs`` without the rows whose text ``leaks`` finds; others that share its doc_id, or have none either, stay."""
    scratch = Scratch(docs.sparkSession, "leaked")
    texts = docs.select(F.xxhash64("text").alias("doc_id"), "text")  # a text is judged by itself, so its hash names it
    hit = apart(docs)("hit")
    found = scratch.save(leaks(texts, items, width, containment).select("doc_id").distinct(), "texts").withColumnRenamed("doc_id", hit)
    return docs.join(_small(found, ROW * found.count(), BROADCAST_BYTES), F.xxhash64("text") == F.col(hit), "left_anti")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item with each document that holds at least 0.8 of its five-word shingles."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_WORDS = r"list_filter(string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_RUNS = "list_distinct(list_transform(range(1, greatest(len(words) - n + 2, 1)), lambda i: array_to_string(list_slice(words, i, i + n - 1), ' ')))"
OP3_SQL = f"""
WITH item_words AS (SELECT item_id, {_WORDS} AS words FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
     item AS (SELECT item_id, n, {_RUNS} AS own FROM (SELECT *, least(len(words), {SHINGLE}) AS n FROM item_words WHERE len(words) > 0)),
     one AS (SELECT item_id, n, len(own) AS q, unnest(own) AS s FROM item),
     doc_words AS (SELECT doc_id, {_WORDS} AS words FROM documents WHERE text IS NOT NULL),
     doc AS (SELECT doc_id, n, unnest({_RUNS}) AS s FROM doc_words, (SELECT DISTINCT n FROM item))
SELECT doc_id, item_id, max(q) AS n_shingles, count(DISTINCT s) AS n_shared, count(DISTINCT s) / max(q)::DOUBLE AS containment
FROM doc JOIN one USING (s, n) GROUP BY doc_id, item_id HAVING count(DISTINCT s) >= {CONTAINMENT} * max(q) - 1e-9
"""
