"""Alert rules on a grid: hold durations, routing, dead-man detection and cooldown."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import labels as L
from tidegauge.functions.labels import labelled


@dataclass
class Rule:
    """An alert on a vector ``(t, *labels, value)``: it is true above ``over``, and fires once true for ``hold`` microseconds."""

    alert: str
    over: float
    hold: int = 0
    severity: str = "warning"


def states(vector: DataFrame, rule: Rule, step: int, start: int, end: int, by: list[str]) -> DataFrame:
    """``(t, *by, alertname, severity, state)``, pending or firing, at each point where the rule is true.

    A point without a value is false, and so ends the hold: a true point goes on from the one a step before, and from none
    further off, so that the points in between need not be made. A series comes once at a point.
    """
    true = labelled(vector, by).where((F.col("value") > rule.over) & F.col("t").between(start, end)).select("t", *by)
    w = Window.partitionBy(*by).orderBy("t")
    begins = F.coalesce(F.col("t") - F.lag("t").over(w) > step, F.lit(True))
    since = F.last(F.when(F.col("begins"), F.col("t")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    held = true.withColumn("begins", begins).withColumn("since", since)
    state = F.when(F.col("t") - F.col("since") >= rule.hold, "firing").otherwise("pending")
    return held.select("t", *by, F.lit(rule.alert).alias("alertname"), F.lit(rule.severity).alias("severity"), state.alias("state"))


def routed(alerts: DataFrame, routes: list[tuple[str, str | None]], otherwise: str) -> DataFrame:
    """``receiver`` by the first route whose pattern matches the whole alertname; a route to None mutes."""
    to = F.lit(otherwise)
    for pattern, receiver in reversed(routes):
        to = F.when(L.matches("alertname", pattern), F.lit(receiver)).otherwise(to)
    return alerts.withColumn("receiver", to).where("receiver is not null")


def missing(beats: DataFrame, at: str, by: list[str], step: int, start: int, end: int) -> DataFrame:
    """``(*by, t)``: grid points of each series in whose step before, ``(t - step, t]``, there was no heartbeat.

    The gap after each point seen lasts until the next one; only its own points are made. ``start`` and ``end`` are on the grid.
    """
    seen = labelled(beats, by).select(*by, (F.col(at) + F.pmod(-F.col(at), F.lit(step))).alias("t")).distinct()
    w = Window.partitionBy(*by).orderBy("t")
    first = F.when(F.lag("t").over(w).isNull(), F.lit(start))  # the gap before the first of all
    gaps = seen.select(*by, "t", first.alias("first"), F.lead("t").over(w).alias("next"))
    to = lambda a, b: F.when(a <= b, F.sequence(a, b, F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    before = F.when(F.col("first").isNotNull(), to(F.col("first"), F.least(F.col("t") - step, F.lit(end)))).otherwise(F.array().cast("array<bigint>"))
    after = to(F.greatest(F.col("t") + step, F.lit(start)), F.least(F.coalesce(F.col("next") - step, F.lit(end)), F.lit(end)))
    return gaps.select(*by, F.explode(F.concat(before, after)).alias("t"))


def cooled_down(gaps: DataFrame, by: list[str], step: int, cooldown: int) -> DataFrame:
    """``(*by, t)``: the points of ``gaps`` that are told: the first of each outage, and then each first one at least
    ``cooldown`` after the last told; recovery (a point missing in between) clears the memory.

    On a grid the k-th point of an outage is told exactly if k is a multiple of the cooldown in steps, rounded up, so
    no state is carried from row to row.
    """
    every = max(1, -(-cooldown // step))
    outage = gaps.withColumn("outage", F.col("t") - F.lit(step).cast("long") * F.row_number().over(Window.partitionBy(*by).orderBy("t")))
    k = F.row_number().over(Window.partitionBy(*by, "outage").orderBy("t")) - 1
    return outage.withColumn("k", k).where(F.col("k") % every == 0).select(*by, "t")


def emitted(rows: DataFrame, key: str, at: str, cooldown: int) -> DataFrame:
    """``(key, at)``: of each key's times in microseconds, those told with a cooldown after the last *told* one.

    A time that follows none within the cooldown is always told, so keys are cut there; within a piece, which only a
    fold can tell, sorted rows stream through a task that keeps one time. Rows without a time are left out.
    """
    rows = rows.where(F.col(at).isNotNull())
    w = Window.partitionBy(key).orderBy(at)
    cut = F.coalesce(F.col(at) - F.lag(at).over(w) >= cooldown, F.lit(True))
    pieces = rows.select(key, at).withColumn("_piece", F.sum(cut.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece, told = None, 0
        for batch in batches:
            keep = []
            for i, (k, p, t) in enumerate(zip(*(batch.column(c).to_pylist() for c in (key, "_piece", at)), strict=True)):
                if (k, p) != piece or t - told >= cooldown:
                    piece, told = (k, p), t
                    keep.append(i)
            yield batch.take(pa.array(keep, pa.int64())).select([key, at])

    dealt = pieces.repartition(key, "_piece").sortWithinPartitions(key, "_piece", at)
    return dealt.mapInArrow(run, rows.select(key, at).schema)


def replicas(value: Column, threshold: float, least: int, most: int) -> Column:
    """What an autoscaler asks for."""
    return F.greatest(F.lit(least), F.least(F.lit(most), F.ceil(value / threshold))).cast("int")
