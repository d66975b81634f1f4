"""Range and instant vectors as DataFrames: a range is ``(t - window, t]``; an empty vector has no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import labelled, later, matched, micros, not_later


def in_range(ts: str | Column, at: int, window: int) -> Column:
    """Of rows in ``(at - window, at]``, in microseconds; compared as timestamps, so that the scan prunes by it."""
    return later(ts, at - window) & not_later(ts, at)


def on_grid(rows: DataFrame, ts: str, step: int, window: int, start: int | None = None, end: int | None = None) -> DataFrame:
    """A row for each point ``t`` of the grid whose range holds the row: ``window / step`` of them, and no join. For counts, sums and
    extremes over wide windows see ``panes``, which copies no row."""
    if start is not None:
        rows = rows.where(later(ts, start - window))
    if end is not None:
        rows = rows.where(not_later(ts, end))
    u = micros(ts)
    first, last = u + F.pmod(-u, F.lit(step)), u + (window - 1) - F.pmod(u + (window - 1), F.lit(step))
    if window == step and start is None and end is None:  # one point each
        return rows.withColumn("t", first)
    if start is not None:
        first = F.greatest(first, F.lit(start))
    if end is not None:
        last = F.least(last, F.lit(end))
    return rows.select("*", F.when(first <= last, F.sequence(first, last, F.lit(step))).alias("_t")).select(*rows.columns, F.explode("_t").alias("t"))


def count_over_time(rows: DataFrame, ts: str, step: int, window: int, by: list[str]) -> DataFrame:
    """``(t, *by, n)``; series without rows have none."""
    return on_grid(labelled(rows, by), ts, step, window).groupBy("t", *by).agg(F.count(F.lit(1)).alias("n"))


def total(vector: DataFrame, value: str, by: list[str], name: str = "value") -> DataFrame:
    """Sum by labels; of an empty vector, empty even without labels."""
    return labelled(vector, by).groupBy(*by, *([] if by else [F.lit(1).alias("_all")])).agg(F.sum(value).alias(name)).select(*by, name)


def top(vector: DataFrame, value: str, k: int, ties: list[str], per: list[str] | None = None) -> DataFrame:
    """The k largest, ties by label; for each ``per`` (a grid point) if given."""
    order = [F.desc(value), *map(F.asc, ties)]
    if not per:
        return vector.orderBy(*order).limit(k)
    return vector.withColumn("_n", F.row_number().over(Window.partitionBy(*per).orderBy(*order))).where(F.col("_n") <= k).drop("_n")


def increase(samples: DataFrame, by: list[str], ts: str, value: str, at: int, window: int) -> DataFrame:
    """``(*by, increase, n)``: what a counter rose by in the range; a fall is a reset to zero. One sample gives none."""
    ranged = labelled(samples, by).where(in_range(ts, at, window))
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts))
    step = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    return ranged.withColumn("_step", step).groupBy(*by).agg(F.sum("_step").alias("increase"), F.count(F.lit(1)).alias("n")).where("n > 1")


def extrapolated(samples: DataFrame, by: list[str], ts: str, value: str, at: int, window: int) -> DataFrame:
    """``(*by, increase)`` carried on to the range's ends as far as half a mean step, or to zero if that is nearer."""
    ranged = labelled(samples, by).where(in_range(ts, at, window)).withColumn("_u", micros(ts))
    before = F.lag(value).over(Window.partitionBy(*by).orderBy(ts))
    step = F.when(F.col(value) < before, F.col(value)).otherwise(F.col(value) - before)
    found = ranged.withColumn("_step", step).groupBy(*by).agg(F.sum("_step").alias("d"), F.min("_u").alias("a"), F.max("_u").alias("b"), F.min_by(value, "_u").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1")
    span = F.col("b") - F.col("a")
    mean = span / (F.col("n") - 1)
    near = lambda gap: F.when(gap < mean * 1.1, gap).otherwise(mean / 2)
    to_start = near(F.col("a") - (at - window))
    to_start = F.when((F.col("d") > 0) & (F.col("v") >= 0), F.least(to_start, span * F.col("v") / F.col("d"))).otherwise(to_start)
    return found.select(*by, (F.col("d") * (span + to_start + near(at - F.col("b"))) / span).alias("increase"))


def _once(vector: DataFrame, on: list[str], name: str) -> DataFrame:
    found = labelled(vector, on).groupBy(*on).agg(F.count(F.lit(1)).alias("_n"), F.first("value").alias(name))
    return found.select(*on, F.when(F.col("_n") > 1, F.raise_error(F.lit("a series comes more than once on one side")).cast(found.schema[name].dataType)).otherwise(F.col(name)).alias(name))


def scalar_ratio(a: DataFrame, b: DataFrame) -> DataFrame:
    """``a / b`` of two vectors of one sample without labels; empty if either is, null for a zero divisor."""
    return ratio(a.withColumn("_all", F.lit(1)), b.withColumn("_all", F.lit(1)), ["_all"]).select("value")


def auto_step(rows: DataFrame, ts: str, points: int, least: int) -> int:
    """The step of a grid of about ``points`` points over all rows: a whole number of ``least``."""
    first, last = rows.agg(F.min(micros(ts)), F.max(micros(ts))).first()
    return least * max(1, -(-(last - first) // (points * least))) if first is not None else least


def ratio(a: DataFrame, b: DataFrame, on: list[str], name: str = "value") -> DataFrame:
    """``a / b`` of series with the same labels, which each side must have once, or it raises; a zero divisor gives null."""
    both = matched(_once(a, on, "_a"), _once(b, on, "_b"), on)
    return both.select(*on, F.try_divide("_a", "_b").alias(name))


def added(vectors: list[DataFrame], on: list[str]) -> DataFrame:
    """The sum of vectors, each of which must have a series once, or it raises; series that any of them lacks drop out."""
    out = _once(vectors[0], on, "_0")
    for i, v in enumerate(vectors[1:], 1):
        out = matched(out, _once(v, on, f"_{i}"), on)
    return out.select(*on, sum((F.col(f"_{i}") for i in range(1, len(vectors))), F.col("_0")).alias("value"))


def otherwise(a: DataFrame, b: DataFrame, on: list[str]) -> DataFrame:
    """``a or b``: all of a, and the series of b that a lacks; without labels b counts only if a is empty."""
    if on:
        return labelled(a, on).unionByName(matched(b, a.select(*on), on, "left_anti"))
    return a.unionByName(b.join(a.select(F.lit(1).alias("_x")).limit(1), F.lit(True), "left_anti"))


def last_known(value: Column, at: Column) -> Column:
    """An aggregate: the last value by ``at`` that isn't null."""
    return F.max_by(value, F.when(value.isNotNull(), at))


def absent(vector: DataFrame) -> DataFrame:
    """One row of value 1 if the vector is empty."""
    return vector.agg(F.count(F.lit(1)).alias("n")).where("n = 0").select(F.lit(1).alias("value"))


def histogram_quantile(q: float, buckets: DataFrame, by: list[str], bound: str = "le", value: str = "value") -> DataFrame:
    """``(*by, value)``: the quantile of cumulative buckets, linear within its bucket. Counts that fall are raised to those below.

    The lowest bucket starts at 0 if its bound is above that, else it gives its bound; the one above all finite bounds
    gives the highest finite bound. Series without a ``+Inf`` bucket or without counts have none. A quantile below 0 or
    above 1 is minus or plus infinity.
    """
    le = F.when(F.col(bound).isin("+Inf", "Inf"), F.lit(float("inf"))).otherwise(F.col(bound).try_cast("double"))
    one = labelled(buckets, by).select(*by, le.alias("_le"), F.col(value).cast("double").alias("_c")).where("_le is not null").groupBy(*by, "_le").agg(F.sum("_c").alias("_c"))
    w = Window.partitionBy(*by, *([] if by else [F.lit(1)])).orderBy("_le")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    one = one.withColumn("_c", F.max("_c").over(w))
    one = one.select("*", F.lag("_c", 1, 0.0).over(w).alias("_c0"), F.lag("_le").over(w).alias("_le0"), F.max("_c").over(whole).alias("_all"), F.max("_le").over(whole).alias("_top"))
    hit = one.where((F.col("_top") == float("inf")) & (F.col("_all") > 0) & (F.col("_c") >= F.col("_all") * min(max(q, 0.0), 1.0)))
    low = F.coalesce("_le0", F.lit(0.0))
    inside = low + (F.col("_le") - low) * F.coalesce(F.try_divide(F.col("_all") * q - F.col("_c0"), F.col("_c") - F.col("_c0")), F.lit(0.0))
    found = F.when(F.col("_le") == float("inf"), F.col("_le0")).when(F.col("_le0").isNull() & (F.col("_le") <= 0), F.col("_le")).otherwise(inside)
    if not 0 <= q <= 1:
        found = F.lit(float("-inf") if q < 0 else float("inf"))
    hit = hit.withColumn("value", found)
    return hit.groupBy(*by, *([] if by else [F.lit(1).alias("_all")])).agg(F.min_by("value", "_le").alias("value")).select(*by, "value")
