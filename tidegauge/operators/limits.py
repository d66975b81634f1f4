"""Ingest limits: a token bucket for each tenant, which may send a burst and then so many bytes a second.

A row that finds too few tokens is refused and takes none, so verdicts depend on all verdicts before. But a bucket that
would be full even if every row took its tokens is full for certain, whatever was refused; there a tenant's rows are cut
into pieces that know nothing of each other. That lower level is a chain of shifts cut off at 0 and at the burst, and such
chains join to one: each stretch of time is summed up by its own task, the summaries are chained, a row a stretch, and
each stretch then starts from its level. Verdicts are found piece by piece, in sorted streams that keep one number.

Levels are in bytes times microseconds, so all is exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import duration, labelled, matched

SECOND = duration("1s")


def _streamed(rows: DataFrame, keys: list[str], order: list[str], schema: str, start, step, end=None) -> DataFrame:
    """Sorted groups of ``keys`` through tasks that keep one group's state: ``state = start(row)`` at its first row, ``step(state,
    row)`` gives the new state and an output row or None, ``end(state)`` an output row."""
    dealt = rows.repartition(*keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, state, names = None, None, None
        for batch in batches:
            out, names = [], batch.schema.names
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                r = dict(zip(names, row, strict=True))
                if (key := tuple(r[k] for k in keys)) != group:
                    if end and group is not None:
                        out.append(end(state))
                    group, state = key, start(r)
                state, told = step(state, r)
                if told is not None:
                    out.append(told)
            yield _table(out, kinds)
        if end and group is not None:
            yield _table([end(state)], kinds)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = to_arrow_schema(_parse_datatype_string(schema))
    return dealt.mapInArrow(run, schema)


def _table(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([] for _ in kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds, strict=True)], schema=kinds)


def _then(a: tuple[int, int, int], b: tuple[int, int, int]) -> tuple[int, int, int]:
    """First ``x -> min(max(x + shift, low), high)`` of a, then of b, as one such step."""
    low, high = (min(max(x + b[0], b[1]), b[2]) for x in (a[1], a[2]))
    return a[0] + b[0], low, high


def within_limit(rows: DataFrame, tenant: str, at: str, order: list[str], size: str, rate: int, burst: int, stretch: int) -> DataFrame:
    """``(tenant, at, *order, size, accepted)`` of each row: whether its tenant's bucket held ``size`` bytes at ``at`` microseconds.

    A bucket is full, ``burst`` bytes, before its first row, and gets ``rate`` bytes a second up to that. Rows of one time come in
    the order of ``order``, long columns that tell them apart. A row of a null or negative size takes nothing; one without a time
    is refused. A missing tenant is the empty one. ``stretch`` is the length, in microseconds, of what one task sums up.
    """
    full = burst * SECOND
    named = labelled(rows, [tenant]).select(tenant, at, *order, F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long").alias(size))
    own = named.where(F.col(at).isNotNull()).withColumn("_stretch", F.floor(F.col(at) / stretch))
    kind = rows.schema[tenant].dataType.simpleString()
    keys, sorting = [tenant, "_stretch"], [at, *order]

    def one(r: dict, last: int | None) -> tuple[int, int, int]:
        """What a row does to the lower level: refill since ``last``, then its tokens are taken."""
        need = r[size] * SECOND
        gain = full if last is None else rate * (r[at] - last)
        return _then((gain, 0, full), (-need, 0, full))

    # 1. Each stretch as one step, the refill before its first row left out.
    def begun(r: dict) -> tuple:
        return r, r[at], None, None

    def summed(state: tuple, r: dict) -> tuple:
        first, begin, last, chain = state
        step = one(r, last) if last is not None else (-r[size] * SECOND, 0, full)
        return (first, begin, r[at], step if chain is None else _then(chain, step)), None

    def told(state: tuple) -> tuple:
        first, begin, last, chain = state
        return (first[tenant], first["_stretch"], begin, last, *chain)

    sums = _streamed(own, keys, sorting, f"`{tenant}` {kind}, _stretch long, first long, last long, shift long, low long, high long", begun, summed, told)

    # 2. The lower level at the end of the stretch before, for each tenant in turn.
    def chained(state: tuple, r: dict) -> tuple:
        level, last = state
        level_in = full if last is None else min(level + rate * (r["first"] - last), full)
        return (min(max(level_in + r["shift"], r["low"]), r["high"]), r["last"]), (r[tenant], r["_stretch"], level, last)

    entry = _streamed(sums, [tenant], ["_stretch"], f"`{tenant}` {kind}, _stretch long, _level long, _last long", lambda r: (full, None), chained)

    # 3. The rows at which the bucket is full for certain.
    def lower(r: dict) -> tuple:
        return r["_level"], r["_last"]

    def cut(state: tuple, r: dict) -> tuple:
        level, last = state
        before = full if last is None else min(level + rate * (r[at] - last), full)
        return (max(before - r[size] * SECOND, 0), r[at]), (*(r[c] for c in [tenant, "_stretch", at, *order, size]), before == full)

    columns = ", ".join(f"`{c}` long" for c in [at, *order, size])
    flagged = _streamed(matched(own, entry, keys), keys, sorting, f"`{tenant}` {kind}, _stretch long, {columns}, _cut boolean", lower, cut)

    # 4. Pieces are numbered within stretches and from stretch to stretch.
    inner = Window.partitionBy(*keys).orderBy(*sorting).rowsBetween(Window.unboundedPreceding, 0)
    cuts = flagged.groupBy(*keys).agg(F.count_if("_cut").alias("_cuts"))
    before = F.coalesce(F.sum("_cuts").over(Window.partitionBy(tenant).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = matched(flagged.withColumn("_inner", F.count_if("_cut").over(inner)), cuts.select(*keys, before.alias("_before")), keys)
    pieces = placed.select(tenant, at, *order, size, (F.col("_before") + F.col("_inner")).alias("_piece"))

    # 5. Each piece begins with a full bucket.
    def judged(state: tuple, r: dict) -> tuple:
        level, last = state
        level = min(level + rate * (r[at] - last), full)
        fits = r[size] * SECOND <= level
        return (level - r[size] * SECOND * fits, r[at]), (*(r[c] for c in [tenant, at, *order, size]), fits)

    verdicts = _streamed(pieces, [tenant, "_piece"], sorting, f"`{tenant}` {kind}, {columns}, accepted boolean", lambda r: (full, r[at]), judged)
    return verdicts.unionByName(named.where(F.col(at).isNull()).withColumn("accepted", F.lit(False)))
