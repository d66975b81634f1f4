"""Byte-level BPE over whole texts, in fragments that are encoded alone and remembered.

A byte-level vocabulary never joins some byte pairs: no token holds them next to each other. Between such a pair every
encoding has a token boundary, so both sides can be encoded alone. A batch of texts is cut, all texts at once, at byte
pairs between which the pre-tokenizer cuts whatever stands around them: before white space, and between ASCII letters,
digits and marks. ``BoundaryEncoder`` cuts each new fragment further at its forced boundaries, encodes each different
piece once, and concatenates; ``WordEncoder`` gives new fragments to the library, many in one text where white space
parts them. The ids of fragments are remembered by a hash, and the bytes are compared at every use.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import sys
from array import array
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from tidegauge.llm.texts import ByteWords, text_bytes, text_parts

VOCABULARY = "byte_bpe_50k.json"
#: Fragments that one Python worker remembers; then it forgets those that it met once. Longer ones than so many bytes are not remembered.
CACHE_ENTRIES, LONGEST = 600_000, 256
#: Pieces of fragments that BoundaryEncoder remembers besides.
PIECES = 100_000
#: A run of Latin letters with the marks after it, which the pre-tokenizer cuts between the two.
_PLAIN = re.compile("( ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([.,;:!?]+)?")
#: In UTF-8, white space, or taken for it somewhere, beyond the six that cut fragments: U+1C-1F, 85, A0, 1680, 180E, 2000-200B, 2028, 2029, 202F, 205F, 3000.
_OTHER_SPACE = re.compile(rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1(?:\x9a\x80|\xa0\x8e)|\xe2(?:\x80[\x80-\x8b\xa8\xa9\xaf]|\x81\x9f)|\xe3\x80\x80")


@cache
def byte_chars() -> str:
    """The printable character of each byte in byte-level vocabularies: itself, or the next one free from 256 on."""
    shown = {*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return "".join(chr(b) if b in shown else chr(next(hidden)) for b in range(256))


#: Kinds of bytes: 1 white space, 2 letters, 3 digits, 4 marks of ASCII; 0 others, and the apostrophe, which may begin a contraction.
_KINDS = bytes(1 if b in b" \t\n\r\x0b\x0c" else 0 if not 32 < b < 127 or b == 39 else 2 if chr(b).isalpha() else 3 if chr(b).isdigit() else 4 for b in range(256))


def certain_cuts(data: bytes) -> np.ndarray:
    """For each two bytes that follow each other, whether the pre-tokenizer cuts between them wherever they stand.

    It does before the first of several white spaces, and between ASCII letters, digits and marks.
    """
    kind = np.frombuffer(data.translate(_KINDS), np.uint8)
    a, b = kind[:-1], kind[1:]
    return (a != b) & (b > 0) & ((b == 1) | (a > 1))


def ids_bytes(ids: list[int]) -> bytes:
    """Little-endian unsigned 32-bit integers."""
    return array("I", ids).tobytes() if sys.byteorder == "little" else np.array(ids, "<u4").tobytes()


def runs(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places ``first[i], first[i] + 1, ...``, ``n[i]`` of them, one run after the other."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())


class _Memory:
    """Numbers of the fragments seen so far by their hash, in a table with linear probing; their bytes and ids by number."""

    BITS = 21

    def __init__(self) -> None:
        self.keys, self.number = np.zeros(1 << self.BITS, np.uint64), np.full(1 << self.BITS, -1, np.int32)
        self.n, self.ids, self.bytes = 0, np.zeros(1 << 20, "<u4"), np.zeros(1 << 20, np.uint8)
        self.first, self.at = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)  # places in ids and bytes, with one past the last
        self.again = np.zeros(1 << 16, bool)  # whether a fragment was met again in a later batch

    def find(self, h: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 if it is new."""
        slot = (h >> np.uint64(64 - self.BITS)).astype(np.int64)
        out = self.number[slot]
        more = np.flatnonzero((out >= 0) & (self.keys[slot] != h))
        while len(more):
            slot[more] = (slot[more] + 1) & ((1 << self.BITS) - 1)
            out[more] = self.number[slot[more]]
            more = more[(out[more] >= 0) & (self.keys[slot[more]] != h[more])]
        return out

    def name(self, h: np.ndarray, number: np.ndarray) -> None:
        """Enters different hashes, none of which is in the table."""
        slot, left = (h >> np.uint64(64 - self.BITS)).astype(np.int64), np.arange(len(h))
        while len(left):
            put = left[self.number[slot[left]] < 0]
            self.keys[slot[put]], self.number[slot[put]] = h[put], number[put]
            left = left[self.keys[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & ((1 << self.BITS) - 1)

    def add(self, raw: np.ndarray, sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Takes in fragments of ``sizes`` bytes and ``counts`` ids, one after the other; returns their numbers."""
        n, new = self.n, len(sizes)
        self.first, self.at, self.again = _room(self.first, n + new + 1), _room(self.at, n + new + 1), _room(self.again, n + new)
        self.first[n + 1 : n + new + 1] = self.first[n] + np.cumsum(counts)
        self.at[n + 1 : n + new + 1] = self.at[n] + np.cumsum(sizes)
        self.ids, self.bytes = _room(self.ids, self.first[n + new]), _room(self.bytes, self.at[n + new] + 8)
        self.ids[self.first[n] : self.first[n + new]] = ids
        self.bytes[self.at[n] : self.at[n + new]] = raw
        self.n = n + new
        return np.arange(n, n + new, dtype=np.int32)

    def full(self) -> bool:
        return bool(self.n > CACHE_ENTRIES or self.at[self.n] > 32 * CACHE_ENTRIES)

    def lean(self) -> _Memory:
        """A new one with the fragments that were met again, or with none if these would fill over half of it."""
        out = _Memory()
        slot = np.flatnonzero(self.number >= 0)
        slot = slot[self.again[self.number[slot]]]
        slot = slot[np.argsort(self.number[slot])]
        keep = np.zeros(self.n, bool)
        keep[self.number[slot]] = True
        counts, sizes = np.diff(self.first[: self.n + 1]), np.diff(self.at[: self.n + 1])
        if 2 * len(slot) <= CACHE_ENTRIES and sizes[keep].sum() <= 16 * CACHE_ENTRIES:
            ids, raw = self.ids[: self.first[self.n]][np.repeat(keep, counts)], self.bytes[: self.at[self.n]][np.repeat(keep, sizes)]
            out.name(self.keys[slot], out.add(raw, sizes[keep], ids, counts[keep]))
        return out


def _room(a: np.ndarray, n: int) -> np.ndarray:
    return a if n <= len(a) else np.concatenate([a, np.zeros(max(int(n), 3 * len(a) // 2) - len(a), a.dtype)])


def _strings(raw: bytes, ends: np.ndarray) -> list[str]:
    places = ends.tolist()
    return [raw[a:b].decode("utf-8", "replace") for a, b in zip([0, *places], places, strict=False)]


def _spaced(raw: bytes, places: np.ndarray) -> np.ndarray:
    """Whether white space follows another byte at each place."""
    white = np.frombuffer(raw.translate(_KINDS), np.uint8) == 1
    return white[places] & ~white[places - 1]


class WordEncoder:
    """Encodes texts as the library does with add_special_tokens=False; remembers the ids of fragments, not of texts."""

    def __init__(self, path: str):
        self.path, spec = path, json.loads(open(path, encoding="utf-8").read())
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.odd = re.compile(b"|".join([_OTHER_SPACE.pattern, *(re.escape(t.encode()) for t in self.added)]))
        lead = {*b"\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3", *(t.encode()[0] for t in self.added)}
        self.lead = bytes(b in lead for b in range(256))  # bytes that what ``odd`` finds can begin with
        self.spaced = not any(map(re.compile(r"\s").search, self.added))  # no added token can reach over white space
        self.width = np.zeros(1 + max([*spec["model"]["vocab"].values(), *self.added.values()]), np.int64)  # each token's bytes
        for t, i in spec["model"]["vocab"].items():
            self.width[i] = len(t)
        self.memory = _Memory()
        self.setup(spec)

    def setup(self, spec: dict) -> None:
        self.library = Tokenizer.from_file(self.path)
        self.library.no_truncation()
        self.library.no_padding()

    def encode_each(self, fragments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all fragments, and how many each has."""
        found = [e.ids for e in self.library.encode_batch_fast(fragments, add_special_tokens=False)]
        return np.fromiter(chain.from_iterable(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found))

    def encode_new(self, raw: bytes, ends: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same of fragments that end at ``ends``; unless they are to be taken as a whole, many make one text.

        One text goes on where white space follows another byte: the pre-tokenizer cuts there. What each fragment has is
        told by the bytes of the tokens; should these not end where it ends, each is encoded by itself.
        """
        if not whole and self.spaced:
            joint = ends[:-1]
            parts = np.concatenate([[0], joint[~_spaced(raw, joint)], ends[-1:]]).tolist()
            try:
                ids, _ = self.encode_each([raw[a:b].decode() for a, b in zip(parts, parts[1:], strict=False)])
            except UnicodeDecodeError:
                ids = np.zeros(0, "<u4")
            until = np.cumsum(self.width[ids])
            at = np.searchsorted(until, ends)
            if len(until) and until[-1] == ends[-1] and np.array_equal(until[at], ends):
                return ids, np.diff(at, prepend=-1)
        return self.encode_each(_strings(raw, ends))

    def encode_flat(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts that end at ``ends`` in ``data``, one text after the other, and where each text's ids end.

        Texts with an added token, or with rare white space, are encoded as a whole by the library's own rules.
        """
        if not len(data):
            return np.zeros(0, "<u4"), np.zeros(len(ends), np.int64)
        if self.memory.full():
            self.memory = self.memory.lean()
        raw = data.tobytes()
        cut = np.empty(len(data) + 1, bool)
        cut[1:-1] = certain_cuts(raw)
        lead = np.flatnonzero(np.frombuffer(raw.translate(self.lead), bool))
        odd = [i for i in np.unique(np.searchsorted(ends, lead, side="right")).tolist() if self.odd.search(data[ends[i - 1] if i else 0 : ends[i]])]
        for i in odd:
            cut[ends[i - 1] if i else 0 : ends[i]] = False
        cut[0] = cut[-1] = True
        cut[ends] = True
        edges = np.flatnonzero(cut)
        start, n = edges[:-1], np.diff(edges)
        words = ByteWords(data)
        number = self.memory.find(h := words.hashes(start, n))
        whole = n > LONGEST
        whole[np.searchsorted(start, [ends[i - 1] if i else 0 for i in odd])] = True
        number[whole] = -1
        known = np.flatnonzero(number >= 0)
        kept = number[known]
        same = words.equal(start[known], n[known], ByteWords(self.memory.bytes, padded=True), self.memory.at[kept], self.memory.at[kept + 1] - self.memory.at[kept])
        whole[known[~same]] = True  # two fragments of one hash
        number[known[~same]] = -1
        self.memory.again[kept[same]] = True
        new = np.flatnonzero((number < 0) & ~whole)
        if len(new):
            _, one, back = np.unique(h[new], return_index=True, return_inverse=True)
            first = new[one]
            same = words.equal(start[new], n[new], words, start[first][back], n[first][back])
            whole[new[~same]] = True
            took = self._take(data, start[first], n[first])
            self.memory.name(h[first], took)
            number[new[same]] = took[back[same]]
        rest = np.flatnonzero(number < 0)
        if len(rest):
            number[rest] = self._take(data, start[rest], n[rest], whole=True)
        first = self.memory.first[number]
        n_ids = self.memory.first[number + 1] - first
        until = np.concatenate([[0], np.cumsum(n_ids)])
        return self.memory.ids[runs(first, n_ids)], until[np.searchsorted(edges, ends)]

    def _take(self, data: np.ndarray, start: np.ndarray, n: np.ndarray, whole: bool = False) -> np.ndarray:
        raw = data[runs(start, n)]
        return self.memory.add(raw, n, *self.encode_new(raw.tobytes(), np.cumsum(n), whole))

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        raw = [t.encode() for t in texts]
        ids, ends = self.encode_flat(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(x) for x in raw], dtype=np.int64))
        return [ids[a:b].tobytes() for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False)]


class BoundaryEncoder(WordEncoder):
    """Cuts fragments at byte pairs that no token holds, and encodes each piece alone."""

    def setup(self, spec: dict) -> None:
        to_byte = {c: b for b, c in enumerate(byte_chars())}
        tokens = {i: bytes(to_byte[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        inside = np.zeros((256, 256), bool)
        for token in tokens.values():
            a = np.frombuffer(token, np.uint8)
            inside[a[:-1], a[1:]] = True
        self.inside = inside
        tokens |= {i: content.encode() for content, i in self.added.items()}
        self.cut_added = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")") if self.added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces: dict[str, bytes] = {}
        self.show = {b: c for b, c in enumerate(byte_chars())}
        # The merges alone, without a pre-tokenizer: pieces are not cut again.
        alone = spec | {"pre_tokenizer": None, "added_tokens": [], "normalizer": None, "decoder": None, "post_processor": None}
        self.merges = Tokenizer.from_str(json.dumps(alone))
        size = max(tokens) + 1
        self.lengths = np.array([len(tokens.get(i, b"")) for i in range(size)])
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens.get(i, b"") for i in range(size)), np.uint8)

    def cut(self, pretokens: list[str]) -> list[list[str]]:
        """The pieces of each pre-token, in the vocabulary's characters: all are cut at once."""
        raw = [p.encode() for p in pretokens]
        whole = b"".join(raw)
        a, ends = np.frombuffer(whole, np.uint8), np.cumsum([len(x) for x in raw])
        cuts = np.append(~self.inside[a[:-1], a[1:]], True)
        cuts[ends - 1] = True
        edges = np.flatnonzero(cuts) + 1
        shown, places = whole.decode("latin-1").translate(self.show), edges.tolist()
        pieces = [shown[s:e] for s, e in zip([0, *places], places, strict=False)]
        until = np.searchsorted(edges, ends, side="right").tolist()
        return [pieces[s:e] for s, e in zip([0, *until], until, strict=False)]

    def split(self, fragment: str) -> tuple[str, ...] | list[str]:
        """The pre-tokens of a fragment, and the added tokens in it."""
        if plain := _PLAIN.fullmatch(fragment):
            return plain.groups() if plain[2] else (fragment,)
        if self.cut_added and self.cut_added.search(fragment):
            return [p for s in self.cut_added.split(fragment) if s for p in ([s] if s in self.added else self.pattern.findall(s))]
        return self.pattern.findall(fragment)

    def encode_new(self, raw: bytes, ends: np.ndarray, whole: bool) -> tuple[np.ndarray, np.ndarray]:
        fragments = _strings(raw, ends)
        split = [self.split(w) for w in fragments]
        pretokens = {p: None for p in chain.from_iterable(split) if p not in self.added}
        cuts = dict(zip(pretokens, self.cut(list(pretokens)) if pretokens else [], strict=True))
        wanted = set(chain.from_iterable(cuts.values()))
        if len(self.pieces) + len(wanted) > PIECES:
            self.pieces = {}
        fresh = list(wanted - self.pieces.keys())
        self.pieces.update(zip(fresh, map(ids_bytes, (e.ids for e in self.merges.encode_batch_fast(fresh, add_special_tokens=False))), strict=True))
        ids = {p: b"".join(map(self.pieces.__getitem__, found)) for p, found in cuts.items()} | {t: ids_bytes([i]) for t, i in self.added.items()}
        found = [b"".join(map(ids.__getitem__, parts)) for parts in split]
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(x) // 4 for x in found], np.int64)

    def decode_flat(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """The text of each run of ids as UTF-8; bytes that are none become U+FFFD."""
        n = self.lengths[ids]
        raw, until = self.bytes[runs(self.starts[ids], n)].tobytes(), np.concatenate([[0], np.cumsum(n)])[ends].tolist()
        return [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip([0, *until], until, strict=False)]


_encoders: dict[tuple[type, str], WordEncoder] = {}


def encoder(kind: type, path: str) -> WordEncoder:
    """One per Python worker, with what it remembers."""
    if (kind, path) not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; more threads would only wait for each other
        _encoders[kind, path] = kind(path)
    return _encoders[kind, path]


def _coded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[bytes]]]:
    """Each part with the ids and the decoded text of its rows."""
    own = encoder(BoundaryEncoder, path)
    for part in text_parts(batches, 128):
        ids, ends = own.encode_flat(*text_bytes(part.column("text")))
        until = (4 * ends).tolist()
        raw = ids.tobytes()
        yield part, [raw[a:b] for a, b in zip([0, *until], until, strict=False)], own.decode_flat(ids, ends)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, ids, decoded)`` of each row of ``docs (doc_id, text, ...)``, encoded by forced boundaries and decoded again.

    ids: little-endian unsigned 32-bit integers; decoded: UTF-8. A null text counts as empty: no ids. Null and repeated
    doc_ids stay as they are, a row for a row; an empty table gives an empty one; other columns are ignored. A text of
    any length is encoded whole, in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, ids, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())], ["doc_id", "ids", "decoded"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, ids binary, decoded binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` by the same encoder, without moving the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for part, ids, decoded in _coded(batches, path):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(map(sha, ids), pa.string()), pa.array(map(sha, decoded), pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the decoded text of each document."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path(VOCABULARY))
