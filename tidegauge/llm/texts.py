"""Small helpers on texts that several operators share. Words are the runs of bytes other than ASCII white space."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Odd multiplier of the rolling hashes.
_BASE = 0x9E3779B97F4A7C15
_LOWER = np.frombuffer(bytes(range(256)).lower(), np.uint8)
_SPACE = np.isin(np.arange(256), list(b" \t\n\r\x0b\x0c"))
#: Of so many first bytes of eight the bits.
_FIRST = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def apart(docs: DataFrame) -> Callable[[str], str]:
    """Gives an operator's own columns names that none of ``docs`` begins with."""
    start = "_own"
    while any(c.lower().startswith(start) for c in docs.columns):
        start += "_"
    return lambda name: f"{start}_{name}"


def text_parts(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in parts of a few rows, which bound what a task holds."""
    for batch in batches:
        for s in range(0, batch.num_rows, rows):
            yield batch.slice(s, rows)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts one after the other, and where each ends; a null text is empty."""
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, places, data = column.buffers()
    places = np.frombuffer(places, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
    return np.frombuffer(data or b"", np.uint8)[places[0] : places[-1]], places[1:] - places[0]


class ByteWords:
    """Hashes and comparisons of many short stretches of bytes at once, eight bytes a step."""

    def __init__(self, data: np.ndarray, padded: bool = False):
        data = data if padded else np.concatenate([data, np.zeros(8, np.uint8)])
        self.eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))

    def at(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The first eight bytes, or ``n`` if there are fewer, as a number."""
        return self.eight[start] & _FIRST[np.minimum(n, 8)]

    def hashes(self, start: np.ndarray, n: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each stretch of ``n >= 1`` bytes."""
        with np.errstate(over="ignore"):
            h = _mixed(self.at(start, n) + n.astype(np.uint64) * np.uint64(_BASE))
            more, k = np.flatnonzero(n > 8), 8
            while len(more):
                h[more] = _mixed(h[more] * np.uint64(0xD6E8FEB86659FD93) + self.at(start[more] + k, n[more] - k))
                k += 8
                more = more[n[more] > k]
        return h

    def equal(self, start: np.ndarray, n: np.ndarray, other: ByteWords, place: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Whether stretches are the same as those of ``m`` bytes at ``place`` in the other's data."""
        out, k = n == m, 0
        more = np.flatnonzero(out)
        while len(more):
            left = n[more] - k
            same = self.at(start[more] + k, left) == other.at(place[more] + k, left)
            out[more[~same]] = False
            k += 8
            more = more[same & (left > 8)]
        return out


def words_of(data: np.ndarray, ends: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts that end at ``ends`` in ``data``, and where each text's words end; ``lower``: A-Z as a-z."""
    if lower:
        data = _LOWER[data]
    space = np.concatenate([[True], _SPACE[data], [True]])
    begins = space[:-1] & ~space[1:]  # at i, whether a word begins at byte i
    stops = ~space[:-1] & space[1:]
    joint = ends[:-1][(ends[:-1] > 0) & (ends[:-1] < len(data))]  # a word ends with its text
    inner = joint[~space[joint] & ~space[joint + 1]]
    begins[inner] = stops[inner] = True
    start = np.flatnonzero(begins)
    return ByteWords(data).hashes(start, np.flatnonzero(stops) - start), np.searchsorted(start, ends)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def shingle_bounds(words: list[bytes], width: int) -> tuple[list[int], list[int]]:
    """Starts and ends, in the words joined by one space, of each run of ``width`` words, or of all if there are fewer."""
    ends = np.cumsum(np.fromiter((len(w) + 1 for w in words), np.int64, len(words)))
    count = max(1, len(words) - width + 1)
    return np.concatenate([[0], ends[: count - 1]]).tolist(), (ends[min(width, len(words)) - 1 :] - 1).tolist()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def run_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """A rolling hash of each run of ``width`` values: polynomial modulo 2 ** 64 by doubling, then mixed."""
    if len(hashes) < width:
        return np.zeros(0, np.uint64)
    size, power, block = 1, _BASE, hashes
    done, out = 0, None
    with np.errstate(over="ignore"):
        while True:
            if width & size:
                tail = block[done : done + len(hashes) - width + 1]
                out = tail if out is None else out * np.uint64(power) + tail
                done += size
            if done == width:
                break
            block = block[:-size] * np.uint64(power) + block[size:]
            size, power = size * 2, power * power & (1 << 64) - 1
        out = (out ^ out >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
        return out ^ out >> np.uint64(32)


def hash_sample(rows: DataFrame, key: str, most: int) -> DataFrame:
    """About ``most`` rows at most, chosen by the hash of their key: the bounded sample that a model is fitted on."""
    n = rows.count()
    return rows if n <= most else rows.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(n)) < most)


def word_array(text: Column) -> Column:
    """The words of ``text`` in lower case without punctuation: runs of letters and digits."""
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
