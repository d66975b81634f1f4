"""A content-addressed store of token ids, as Parquet files.

``documents``: a row per document in ascending doc_id order over the shards, with its recipe: the SHA-256 of each chunk
in order, the chunk's length, and its place in the ids that the row itself holds, or -1; a chunk that several documents
use is held once, by the first of them. Chunks are cut where a rolling hash of the last ids has zeros, so equal passages give
equal chunks wherever they stand. A document's root covers the Merkle root of its recipe and its place in the store.
``manifest``: a row per shard with the place of its first id, the width of stored ids, and the Merkle root over its
documents' roots; corpus_root is the Merkle root over all that these rows say. Readers verify every level.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from tidegauge.llm.bpe import VOCABULARY, WordEncoder, encoder
from tidegauge.llm.scratch import Scratch
from tidegauge.llm.texts import text_bytes, text_parts

#: Ids of a chunk: at least, on average about (above the least), and at most; and ids that decide on a cut.
LEAST, MEAN, MOST, SPAN = 128, 512, 4096, 16
#: Ids and documents of a shard, about.
SHARD_IDS, SHARD_DOCS = 16_000_000, 100_000
#: Salts of a chunk while its uses are counted and marked; and uses of a chunk for which a reader makes one copy of it.
SALTS, USES = 64, 256
_ENCODED = "rid long, doc_id long, n_tokens long, sizes array<int>, hashes array<binary>, ids binary"
_STORED = "shard int, row long, rid long, doc_id long, local_start long, n_tokens long, root binary, sizes array<int>, hashes array<binary>, places array<int>, copies array<int>, ids binary"
_MANIFEST = "shard int, first_id long, n_docs long, n_tokens long, root binary, width int, corpus_root binary"


def _cuts(ids: np.ndarray, ends: list[int]) -> list[list[int]]:
    """Of each document's ids up to ``ends``, the lengths of its chunks: to a rolling hash with zeros, within the least and the most."""
    with np.errstate(over="ignore"):
        h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xD6E8FEB86659FD93)
        size = 1
        while size < SPAN:  # doubling: the sum over the last ``size`` ids, each shifted by its distance
            h[size:] = h[size:] + (h[:-size] << np.uint64(size))
            size *= 2
    zeros = np.flatnonzero((h >> np.uint64(40)) % np.uint64(MEAN) == 0) + 1  # none of the first LEAST counts, so all windows lie in the document
    places, out, last, k = zeros.tolist(), [], 0, 0
    for end, until in zip(ends, np.searchsorted(zeros, ends).tolist(), strict=True):
        sizes = []
        for cut in [*places[k:until], end]:
            if cut - last < LEAST and cut != end:
                continue
            while cut - last > MOST:
                sizes.append(MOST)
                last += MOST
            if cut > last:
                sizes.append(cut - last)
                last = cut
        out.append(sizes)
        last, k = end, until
    return out


def chunk_sizes(ids: np.ndarray) -> list[int]:
    """The lengths of the chunks of one document's ids."""
    return _cuts(ids, [len(ids)])[0]


def merkle_root(leaves: list[bytes]) -> bytes:
    """SHA-256 tree over digests; leaves and inner nodes are told apart; an odd last node moves up."""
    level = [hashlib.sha256(b"\x00" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\x01" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def document_root(hashes: list[bytes], sizes: list[int], row: int, doc_id: int | None, local_start: int, n_tokens: int) -> bytes:
    return hashlib.sha256(b"\x02" + merkle_root(hashes) + f"{sizes} {row} {doc_id} {local_start} {n_tokens}".encode()).digest()


def corpus_root(shards: list) -> bytes:
    """Over the manifest's rows in order."""
    return merkle_root([hashlib.sha256(b"\x03" + bytes(s["root"]) + f"{s['shard']} {s['first_id']} {s['n_docs']} {s['n_tokens']} {s['width']}".encode()).digest() for s in shards])


def _lists(parts: list[list], kind: pa.DataType) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array([x for p in parts for x in p], kind))


def _binary(data: bytes, ends: np.ndarray) -> pa.Array:
    return pa.BinaryArray.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(np.concatenate([[0], ends]).astype(np.int32).tobytes()), pa.py_buffer(data)])


def _digests(data: memoryview, sizes: list[int], width: int) -> list[bytes]:
    """The SHA-256 of each of consecutive stretches of ``sizes`` ids."""
    ends = [width * e for e in accumulate(sizes)]
    return [hashlib.sha256(data[a:b]).digest() for a, b in zip([0, *ends], ends, strict=False)]


def _encode(path: str, end_id: int, width: int):
    """mapInArrow function over (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(WordEncoder, path)
        rid = TaskContext.get().partitionId() << 36
        for part in text_parts(batches):
            ids, ends = own.encode_flat(*text_bytes(part.column("text")))
            ids, ends = np.insert(ids, ends, end_id), ends + np.arange(1, len(ends) + 1)
            sizes = _cuts(ids, ends.tolist())
            raw = ids.astype(f"<u{width}").tobytes()
            hashes = _digests(memoryview(raw), [n for s in sizes for n in s], width)
            at = np.cumsum([0, *map(len, sizes)]).astype(np.int32)
            columns = [pa.array(np.arange(rid, rid + part.num_rows)), part.column("doc_id"), pa.array(np.diff(ends, prepend=0)), _lists(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(at), pa.array(hashes, pa.binary())), _binary(raw, width * ends)]
            rid += part.num_rows
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n_tokens", "sizes", "hashes", "ids"])

    return run


def _shard(width: int):
    """mapInArrow function over a sorted range: before a document comes its mark, if other documents share chunks of it."""
    names = ["shard", "row", "rid", "doc_id", "local_start", "n_tokens", "root", "sizes", "hashes", "places", "copies", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, row, start, mark = TaskContext.get().partitionId(), 0, 0, {}
        for batch in batches:
            kinds, rids = batch.column("kind").to_pylist(), batch.column("rid").to_pylist()
            marks = {i: dict(zip(batch.column("pos")[i].as_py(), zip(batch.column("first")[i].as_py(), batch.column("copies")[i].as_py(), strict=True), strict=True)) for i, k in enumerate(kinds) if k == 0}
            places, known = [], []
            for i, k in enumerate(kinds):
                if k == 0:
                    mark = {rids[i]: marks[i]}
                else:
                    places.append(i)
                    known.append(mark.get(rids[i], {}))
            if not places:
                continue
            docs = batch.select(["rid", "doc_id", "n_tokens", "sizes", "hashes", "ids"]).take(pa.array(places))
            ids, number, n_tokens, sizes, hashes = docs.column("doc_id").to_pylist(), docs.num_rows, docs.column("n_tokens").to_pylist(), docs.column("sizes").to_pylist(), docs.column("hashes").to_pylist()
            starts = [start, *(start + n for n in accumulate(n_tokens))]
            roots = [document_root(h, s, row + i, ids[i], starts[i], n_tokens[i]) for i, (h, s) in enumerate(zip(hashes, sizes, strict=True))]
            held = [[m.get(k, (True, 0))[0] for k in range(len(s))] for m, s in zip(known, sizes, strict=True)]
            copies = [[m.get(k, (True, 0))[1] for k in range(len(s))] for m, s in zip(known, sizes, strict=True)]
            raw = docs.column("ids")
            at = [[p if own else -1 for own, p in zip(h, [0, *accumulate(n * own for n, own in zip(s, h, strict=True))], strict=False)] for h, s in zip(held, sizes, strict=True)]
            if not all(map(all, held)):
                raw = pa.array([x.as_py() if all(own) else _held(x.as_buffer(), s, own, width) for x, s, own in zip(raw, sizes, held, strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * number, pa.int32()), pa.array(range(row, row + number), pa.int64()), docs.column("rid"), docs.column("doc_id"), pa.array(starts[:-1], pa.int64()), docs.column("n_tokens"), pa.array(roots, pa.binary()), docs.column("sizes"), docs.column("hashes"), _lists(at, pa.int32()), _lists(copies, pa.int32()), raw], names
            )
            row, start = row + number, starts[-1]

    return run


def _held(ids: pa.Buffer, sizes: list[int], held: list[bool], width: int) -> bytes:
    """The ids of those chunks that the row holds."""
    data, ends = memoryview(ids), [width * e for e in accumulate(sizes)]
    return b"".join(data[b - width * n : b] for b, n, own in zip(ends, sizes, held, strict=True) if own)


@F.pandas_udf(BinaryType())
def _root_of(roots: pd.Series) -> pd.Series:
    return pd.Series([merkle_root(list(r)) for r in roots])


def _salt(rows: int, *columns: str) -> F.Column:
    return F.pmod(F.xxhash64(*columns, F.lit("salt")), F.lit(rows)).cast("int")


def _marks(encoded: DataFrame) -> DataFrame:
    """``(rid, doc_id, pos, first, copies)`` of each document that uses chunks of others: which, whether it is their first
    use, and how many copies readers make of them. A chunk with any number of uses is dealt out by salts."""
    uses = encoded.select("rid", "doc_id", F.posexplode("hashes").alias("pos", "hash")).withColumn("salt", _salt(SALTS, "rid", "pos"))
    salted = uses.groupBy("hash", "salt").agg(F.min(F.struct("doc_id", "rid", "pos")).alias("first"), F.count(F.lit(1)).alias("n"))
    chunks = salted.groupBy("hash").agg(F.min("first").alias("first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts")).where("n > 1")
    shared = chunks.select("hash", F.explode("salts").alias("salt"), "first", (1 + F.floor((F.col("n") - 2) / USES)).cast("int").alias("copies"))
    is_first = (F.col("first.rid") == F.col("rid")) & (F.col("first.pos") == F.col("pos"))
    marked = uses.join(shared.hint("merge"), ["hash", "salt"]).select("rid", "doc_id", F.struct("pos", is_first.alias("first"), "copies").alias("m"))
    each = marked.groupBy("rid", "doc_id").agg(F.collect_list("m").alias("m"))
    return each.select("rid", "doc_id", F.col("m.pos").alias("pos"), F.col("m.first").alias("first"), F.col("m.copies").alias("copies"))


def write_store(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, scratch: Scratch | None = None) -> bytes:
    """Encodes each row of ``docs (doc_id, text, ...)``, ends it with ``end_id``, and writes the store into the folder
    ``path``; returns the corpus root.

    A null text counts as empty: the end id alone. Null doc_ids come first; repeated ones follow each other, in the
    order of the input. An empty table gives an empty store. Other columns are ignored. A text of any length is encoded
    whole, in one task; a chunk may be shared by any number of documents.
    """
    spark = docs.sparkSession
    scratch = scratch or Scratch(spark, "token_store")
    width = 2 if encoder(WordEncoder, vocabulary).library.get_vocab_size() <= 1 << 16 and end_id < 1 << 16 else 4
    encoded = scratch.save(docs.select("doc_id", "text").mapInArrow(_encode(vocabulary, end_id, width), _ENCODED), "encoded")
    marks = scratch.save(_marks(encoded), "marks")
    size = encoded.agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("ids")).first()
    shards = 1 + max(size["ids"] // SHARD_IDS, size["docs"] // SHARD_DOCS)
    both = encoded.withColumn("kind", F.lit(1)).unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    ranged = both.repartitionByRange(shards, "doc_id", "rid").sortWithinPartitions("doc_id", "rid", "kind")
    stored = ranged.mapInArrow(_shard(width), _STORED)
    stored.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/documents")
    scratch.drop("encoded", "marks")
    lines, place = [], 0
    for r in _shard_roots(spark, path):
        lines.append({"shard": r["shard"], "first_id": place, "n_docs": r["n_docs"], "n_tokens": r["n_tokens"], "root": bytes(r["root"]), "width": width})
        place += r["n_tokens"]
    root = corpus_root(lines)
    manifest = spark.createDataFrame([(*line.values(), root) for line in lines], _MANIFEST)
    manifest.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return root


def _shard_roots(spark: SparkSession, path: str) -> list:
    """A row a shard, from the documents as they are; a shard has about SHARD_DOCS roots."""
    rows = spark.read.schema(_STORED).parquet(f"{path}/documents")
    by_shard = rows.groupBy("shard").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("n_tokens").alias("n_tokens"), F.transform(F.array_sort(F.collect_list(F.struct("row", "root"))), lambda x: x["root"]).alias("roots"))
    return by_shard.select("shard", "n_docs", "n_tokens", _root_of("roots").alias("root")).orderBy("shard").collect()


def verified_manifest(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """The manifest, after its rows are checked against the documents' roots and its corpus root; and that, if given, against ``root``."""
    manifest = spark.read.schema(_MANIFEST).parquet(f"{path}/manifest")
    lines, place = manifest.orderBy("shard").collect(), 0  # one row a shard
    found = _shard_roots(spark, path)
    for line, r in zip(lines, found, strict=False):
        if (line["shard"], line["first_id"], line["n_docs"], line["n_tokens"], line["root"]) != (r["shard"], place, r["n_docs"], r["n_tokens"], r["root"]):
            raise ValueError(f"shard {line['shard']} doesn't match the manifest")
        place += r["n_tokens"]
    if len(lines) != len(found) or lines and {bytes(x["corpus_root"]) for x in lines} != {corpus_root(lines)} or root is not None and corpus_root(lines) != root:
        raise ValueError("the manifest doesn't match its corpus root")
    return manifest


def _rebuild(width: int):
    """mapInArrow function: each document's ids, after checking all digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches):
            c = {name: part.column(name) for name in part.schema.names}
            doc, start, n_tokens, row, local, root, sizes, hashes, places, fetched = (c[x].to_pylist() for x in ("doc_id", "start", "n_tokens", "row", "local_start", "root", "sizes", "hashes", "places", "fetched"))
            texts: list[memoryview | bytes] = []
            for i, own in enumerate(x.as_buffer() for x in c["ids"]):
                data: memoryview | bytes = memoryview(own)
                if fetched[i]:
                    found = {f["pos"]: f["found"] for f in fetched[i]}
                    data = b"".join(data[width * at : width * (at + n)] if at >= 0 else found.get(k, b"") for k, (at, n) in enumerate(zip(places[i], sizes[i], strict=True)))
                right = len(data) == width * n_tokens[i] == width * sum(sizes[i]) and _digests(memoryview(data), sizes[i], width) == hashes[i]
                if not right or document_root(hashes[i], sizes[i], row[i], doc[i], local[i], n_tokens[i]) != root[i]:
                    raise ValueError(f"document {doc[i]} at {start[i]} doesn't match its recipe")
                texts.append(data)
            ids = np.frombuffer(b"".join(texts), f"<u{width}").astype("<u4").tobytes()
            yield pa.RecordBatch.from_arrays([c["doc_id"], c["start"], c["n_tokens"], _binary(ids, 4 * np.cumsum(n_tokens))], ["doc_id", "start", "n_tokens", "ids"])

    return run


def read_store(spark: SparkSession, path: str, root: bytes | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, ids)`` of each document, rebuilt from its recipe.

    start: the ids of all documents before it; ids: little-endian unsigned 32-bit integers. The manifest is verified at
    once, against ``root`` if it is given; each document against its chunks' digests and its own root as it is rebuilt.
    A mismatch raises ValueError. Documents that hold all of their chunks are rebuilt where they stand; the others fetch
    chunks by hash, of which much used ones are copied, a copy for USES uses.
    """
    manifest = verified_manifest(spark, path, root)
    width = manifest.agg(F.coalesce(F.max("width"), F.lit(2))).first()[0]
    rows = spark.read.schema(_STORED).parquet(f"{path}/documents")
    placed = rows.join(F.broadcast(manifest.select("shard", "first_id")), "shard").withColumn("start", F.col("first_id") + F.col("local_start"))  # one row a shard
    columns = ["doc_id", "start", "n_tokens", "row", "local_start", "root", "sizes", "hashes", "places", "ids"]
    lacking = F.exists("places", lambda p: p < 0)
    chunk = F.transform("hashes", lambda h, i: F.struct(i.alias("pos"), h.alias("hash"), F.get("sizes", i).alias("n"), F.get("places", i).alias("at"), F.get("copies", i).alias("copies")))
    wanted = rows.where(lacking).select("rid", F.inline(F.filter(chunk, lambda c: c["at"] < 0)))
    wanted = wanted.select("rid", "pos", "hash", F.pmod(F.xxhash64("rid", "pos", F.lit("copy")), "copies").alias("copy"))
    source = rows.where(F.exists("copies", lambda n: n > 0)).select("ids", F.inline(F.filter(chunk, lambda c: (c["at"] >= 0) & (c["copies"] > 0))))
    source = source.select("hash", F.substring(F.col("ids"), F.col("at") * width + 1, F.col("n") * width).alias("found"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies").cast("long") - 1)).alias("copy"))
    fetched = wanted.join(source.hint("merge"), ["hash", "copy"]).groupBy("rid").agg(F.collect_list(F.struct("pos", "found")).alias("fetched"))
    kind = fetched.schema["fetched"].dataType
    whole = placed.where(~lacking).select(*columns, F.lit(None).cast(kind).alias("fetched"))
    joined = placed.where(lacking).select("rid", *columns).join(fetched.hint("merge"), "rid", "left").select(*columns, "fetched")
    return whole.unionByName(joined).mapInArrow(_rebuild(width), "doc_id long, start long, n_tokens long, ids binary")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Place, number and checksum of each document's ids, from the store's files."""
    vocabulary = public_tokenizers.path(VOCABULARY)
    scratch = Scratch(spark, "token_store")
    root = write_store(spark.read.parquet(f"{sf_dir}/documents.parquet"), scratch.path("store"), vocabulary, scratch=scratch)
    return read_store(spark, scratch.path("store"), root).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
