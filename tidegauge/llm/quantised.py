"""Embeddings as whole numbers: each entry c becomes x = floor(256 * c)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.llm.texts import text_bytes, text_parts

SCALE = 256
_MOST = np.iinfo(np.int64)


def quantised(vectors: DataFrame, size: int | None = None) -> DataFrame:
    """``(vec_id, x)`` of the rows of ``vectors (vec_id, embedding, ...)`` whose vector has only finite entries, and ``size`` of them if given.

    x holds the entries as little-endian 64-bit integers. What is too large for one becomes the largest or least.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_parts(batches, 2048):
            lists = part.column("embedding")
            ends = lists.offsets.to_numpy().astype(np.int64)
            flat = lists.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]]  # nulls as NaN
            ends = ends - ends[0]
            n = np.diff(ends)
            bad = np.concatenate([[0], np.cumsum(~np.isfinite(flat))])
            keep = (bad[ends[1:]] == bad[ends[:-1]]) & lists.is_valid().to_numpy(zero_copy_only=False)
            if size is not None:
                keep &= n == size
            c = np.floor(flat[np.repeat(keep, n)] * SCALE)
            over, under = c >= 2.0**63, c < -(2.0**63)
            c[over | under] = 0
            x = c.astype("<i8")
            x[over], x[under] = _MOST.max, _MOST.min
            places = np.concatenate([[0], np.cumsum(n[keep] * 8)]).astype(np.int32)
            entries = pa.Array.from_buffers(pa.binary(), int(keep.sum()), [None, pa.py_buffer(places), pa.py_buffer(x)])
            yield pa.RecordBatch.from_arrays([part.column("vec_id").filter(pa.array(keep)), entries], ["vec_id", "x"])

    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(run, f"vec_id {rows.schema['vec_id'].dataType.simpleString()}, x binary")


def entries(column: pa.Array, size: int) -> np.ndarray:
    """A batch of x as a matrix of rows by ``size``."""
    return text_bytes(column)[0].view("<i8").reshape(-1, size)
