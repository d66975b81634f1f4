"""Overlapping windows from panes: rows are first added up in panes of the greatest common divisor of step and window, and
each window is then put together from the panes' running values. No row is copied into the windows that hold it; after
the pane sums, only panes are shuffled, and every frame below grows from the start of its series, in one pass.

A window is ``(t - window, t]``, a pane ``(pane - width, pane]``; both are named by their end, in microseconds. Labels may have any
name but those of the columns that a function returns, or ones that begin with an underscore.
"""

from __future__ import annotations

from math import gcd

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import labelled, later, micros, not_later

#: What a counter did in a stretch of time: its first and last sample, how much it rose in between, and how many there were.
SUMMARY = "struct<at:bigint,value:double,last_at:bigint,last:double,rise:double,n:bigint>"


def pane_end(ts: str | Column, width: int, origin: int = 0) -> Column:
    """The end of a row's pane; ``origin`` is the end of one."""
    u = micros(ts)
    return u + F.pmod(origin - u, F.lit(width))


def ranged(rows: DataFrame, ts: str, window: int, start: int, end: int) -> DataFrame:
    """The rows that some window of a grid from ``start`` to ``end`` can hold; the scan prunes by it."""
    return rows.where(later(ts, start - window) & not_later(ts, end))


def _points(panes: DataFrame, by: list[str], step: int, window: int, start: int, end: int) -> DataFrame:
    """Each pane at its own end, and again at every later grid point up to the next pane whose window still holds it.

    Adds ``t`` and ``_point``, whether t is a grid point; a grid point comes once in its series, with the last pane in its window.
    """
    w = Window.partitionBy(*by).orderBy("pane")
    first = F.greatest(F.col("pane") + step - F.pmod(F.col("pane") - start, F.lit(step)), F.lit(start))
    until = F.least(F.coalesce(F.lead("pane").over(w) - 1, F.lit(end)), F.col("pane") + (window - 1), F.lit(end))
    some = panes.withColumns({"_a": first, "_b": until})
    later_ = F.when(F.col("_a") <= F.col("_b"), F.sequence("_a", "_b", F.lit(step))).otherwise(F.array().cast("array<bigint>"))
    out = some.withColumn("t", F.explode(F.concat(F.array("pane"), later_))).drop("_a", "_b")
    return out.withColumn("_point", F.col("t").between(start, end) & (F.pmod(F.col("t") - start, F.lit(step)) == 0))


def _gone(by: list[str], window: int) -> "Window":
    """The rows of a series up to where a window begins."""
    return Window.partitionBy(*by).orderBy("t").rangeBetween(Window.unboundedPreceding, -window)


def over_windows(rows: DataFrame, ts: str, value: str | None, step: int, window: int, start: int, end: int, by: list[str]) -> DataFrame:
    """``(t, *by, n, sum, min, max)`` of every non-empty window at the grid points ``start``, ``start + step``, ... up to ``end``.

    ``n`` counts rows, the others take the values that aren't null (null if there are none). Counts and sums are
    differences of running sums, so a sum carries the rounding of its series' running sum. Extremes come from two running
    extremes within stretches of one window's length, one from the stretch's start and one from its end: a window
    holds the end of one stretch and the start of the next. Without ``value`` there is only ``n``.
    """
    width = gcd(step, window)
    own = labelled(ranged(rows, ts, window, start, end), by)
    v = F.col(value).cast("double") if value else F.lit(None).cast("double")
    panes = own.groupBy(*by, pane_end(ts, width, start).alias("pane")).agg(F.count(F.lit(1)).alias("_n"), F.count(v).alias("_k"), F.sum(v).alias("_s"), F.min(v).alias("_lo"), F.max(v).alias("_hi"))
    w = Window.partitionBy(*by).orderBy("pane")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    run = {"_rn": F.sum("_n").over(so_far), "_rk": F.sum("_k").over(so_far), "_rs": F.coalesce(F.sum("_s").over(so_far), F.lit(0.0))}
    if value:
        stretch = F.ceil((F.col("pane") - start) / window)
        up = Window.partitionBy(*by, "_stretch").orderBy("pane").rowsBetween(Window.unboundedPreceding, 0)
        down = Window.partitionBy(*by, "_stretch").orderBy(F.desc("pane")).rowsBetween(Window.unboundedPreceding, 0)
        panes = panes.withColumn("_stretch", stretch).withColumns({"_lo_up": F.min("_lo").over(up), "_hi_up": F.max("_hi").over(up)}).withColumns({"_lo_down": F.min("_lo").over(down), "_hi_down": F.max("_hi").over(down)})
        edge = F.struct("_stretch", "_lo_down", "_hi_down")
        run |= {"_edge": F.first(edge).over(so_far), "_next": F.lead(edge).over(w)}
    else:
        run |= {"_edge": F.lit(0), "_next": F.lit(0)}
    points = _points(panes.withColumns(run), by, step, window, start, end)
    points = points.withColumn("_gone", F.last(F.struct("_rn", "_rk", "_rs", "_next")).over(_gone(by, window))).where("_point")
    n = F.col("_rn") - F.coalesce("_gone._rn", F.lit(0))
    if not value:
        return points.select("t", *by, n.alias("n"))
    k = F.col("_rk") - F.coalesce("_gone._rk", F.lit(0))
    oldest = F.when(F.col("_gone").isNull(), F.col("_edge")).otherwise(F.col("_gone._next"))  # the first pane in the window
    points = points.withColumn("_oldest", oldest)

    def extreme(name: str, of) -> Column:
        left, right = F.col(f"_oldest._{name}_down"), F.col(f"_{name}_up")
        same = F.col("_oldest._stretch") == F.col("_stretch")
        ended = start + F.col("_stretch") * window <= F.col("t")  # nothing of the stretch comes after t
        return F.when(~same, of(left, right)).when(ended, left).otherwise(right)

    total = F.when(k > 0, F.col("_rs") - F.coalesce("_gone._rs", F.lit(0.0)))
    return points.select("t", *by, n.alias("n"), total.alias("sum"), extreme("lo", F.least).alias("min"), extreme("hi", F.greatest).alias("max"))


def rise(before: Column, after: Column) -> Column:
    """What a counter rose by from one sample to the next; a fall is a reset to zero."""
    return F.when(after < before, after).otherwise(after - before)


def counter_panes(samples: DataFrame, ts: str, value: str, width: int, by: list[str], origin: int = 0) -> DataFrame:
    """``(*by, pane, summary)``: the summary of each pane's samples. Those without a value are left out; of one time, the order of values decides."""
    v = F.col(value).cast("double")
    own = labelled(samples, by).where(v.isNotNull() & F.col(ts).isNotNull()).select(*by, micros(ts).alias("_u"), v.alias("_v"), pane_end(ts, width, origin).alias("pane"))
    w = Window.partitionBy(*by, "pane").orderBy("_u", "_v")
    steps = own.withColumn("_d", rise(F.lag("_v").over(w), F.col("_v")))
    at = F.struct("_u", "_v")
    c = F.struct(F.min(at)["_u"].alias("at"), F.min(at)["_v"].alias("value"), F.max(at)["_u"].alias("last_at"), F.max(at)["_v"].alias("last"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("rise"), F.count(F.lit(1)).alias("n"))
    return steps.groupBy(*by, "pane").agg(c.alias("summary"))


def joined(a: Column, b: Column) -> Column:
    """The summary of a stretch and the one right after it; a missing one changes nothing. Any way of pairing gives the same."""
    both = F.struct(a["at"].alias("at"), a["value"].alias("value"), b["last_at"].alias("last_at"), b["last"].alias("last"), (a["rise"] + b["rise"] + rise(a["last"], b["value"])).alias("rise"), (a["n"] + b["n"]).alias("n"))
    return F.when(a.isNull(), b).when(b.isNull(), a).otherwise(both)


def coarser(panes: DataFrame, width: int, by: list[str], origin: int = 0) -> DataFrame:
    """Counter panes joined to wider ones, whose width is a multiple of theirs."""
    p = F.col("pane") + F.pmod(origin - F.col("pane"), F.lit(width))
    parts = F.array_sort(F.collect_list(F.struct("pane", "summary")))
    whole = F.aggregate(F.col("_parts"), F.lit(None).cast(SUMMARY), lambda a, x: joined(a, x["summary"]))
    return panes.groupBy(*by, p.alias("_w")).agg(parts.alias("_parts")).select(*by, F.col("_w").alias("pane"), whole.alias("summary"))


def counters_on_grid(panes: DataFrame, step: int, window: int, start: int, end: int, by: list[str]) -> DataFrame:
    """``(t, *by, increase, rate, extrapolated, extrapolated_rate, n)`` of counter panes at every grid point with two samples or
    more in its window. The panes' width divides step and window, and one of them ends at ``start``.

    ``increase`` is what the counter rose by from the window's first sample to its last, ``extrapolated`` that carried
    on to the window's ends: as far as half a mean step unless a sample is near, and no further back than to zero.
    Rates are by second of the window. Running sums over all panes and seams before a window are taken off.
    """
    w = Window.partitionBy(*by).orderBy("pane")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    seam = F.coalesce(rise(F.lag("summary.last").over(w), F.col("summary.value")), F.lit(0.0))
    # What had risen up to the pane's last sample, and up to its first.
    run = panes.withColumn("_seam", seam).withColumns({"_to_last": F.sum(F.col("_seam") + F.col("summary.rise")).over(so_far), "_rn": F.sum("summary.n").over(so_far)})
    edge = F.struct((F.col("_to_last") - F.col("summary.rise")).alias("to_first"), "summary.at", "summary.value")
    run = run.withColumns({"_edge": F.first(edge).over(so_far), "_next": F.lead(edge).over(w)})
    points = _points(run, by, step, window, start, end)
    points = points.withColumn("_gone", F.last(F.struct("_rn", "_next")).over(_gone(by, window))).where("_point")
    points = points.withColumn("_a", F.when(F.col("_gone").isNull(), F.col("_edge")).otherwise(F.col("_gone._next")))
    points = points.select("t", *by, (F.col("_to_last") - F.col("_a.to_first")).alias("increase"), (F.col("_rn") - F.coalesce("_gone._rn", F.lit(0))).alias("n"), F.col("_a.at").alias("_at"), F.col("_a.value").alias("_v"), F.col("summary.last_at").alias("_last_at")).where("n > 1")
    span = F.col("_last_at") - F.col("_at")
    mean = span / (F.col("n") - 1)
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    to_start = near(F.col("_at") - (F.col("t") - window))
    to_start = F.when((F.col("increase") > 0) & (F.col("_v") >= 0), F.least(to_start, span * F.col("_v") / F.col("increase"))).otherwise(to_start)
    whole = F.col("increase") * F.try_divide(span + to_start + near(F.col("t") - F.col("_last_at")), span)
    seconds = window / 1_000_000
    return points.select("t", *by, "increase", (F.col("increase") / seconds).alias("rate"), whole.alias("extrapolated"), (whole / seconds).alias("extrapolated_rate"), "n")


def rate_on_grid(samples: DataFrame, ts: str, value: str, step: int, window: int, start: int, end: int, by: list[str]) -> DataFrame:
    """``counters_on_grid`` of raw samples."""
    return counters_on_grid(counter_panes(ranged(samples, ts, window, start, end), ts, value, gcd(step, window), by, start), step, window, start, end, by)
