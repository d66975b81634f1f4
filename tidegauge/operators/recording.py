"""Recording rules: series derived from rows or from other recorded series, kept in a table and brought up to date in slots.

The table holds ``(rule, slot, labels, t, value)``: ``labels`` are pairs by name, ``t`` the end of the step ``(t - step, t]`` in
microseconds, ``slot`` the number of the stretch of time that t is in. Rules are run by level, a level after those it
reads, and all rules of a level that read one source share one scan and one aggregation.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.labels import label, later, micros, not_later

LABELS = "array<struct<name:string,value:string>>"
SCHEMA = f"rule string, slot long, labels {LABELS}, t long, value double"


@dataclass
class Recorded:
    """``how`` (count, sum, min or max) of ``value`` by labels and step, over the rows of ``reads`` for which the SQL ``where`` holds.

    ``reads`` is a source or another rule; of a rule, ``value`` is its value and labels that it lacks are empty.
    """

    name: str
    reads: str
    by: list[str] = field(default_factory=list)
    how: str = "count"
    value: str = "value"
    where: str | None = None

    @property
    def needs(self) -> list[str]:
        return [self.reads]


@dataclass
class Quotient:
    """One rule's series over another's with the same labels and time; none where either lacks or the divisor is 0."""

    name: str
    over: str
    under: str

    @property
    def needs(self) -> list[str]:
        return [self.over, self.under]


def levels(rules: list[Recorded | Quotient]) -> list[list]:
    """The rules in an order in which each comes after those it reads; a circle raises."""
    left, known, out = {r.name: r for r in rules}, set(), []
    while left:
        ready = [r for r in left.values() if not any(n in left for n in r.needs)]
        if not ready:
            raise ValueError(f"rules that read each other: {', '.join(left)}")
        out.append(ready)
        known |= {r.name for r in ready}
        left = {n: r for n, r in left.items() if n not in known}
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """All that has been recorded; scans prune by rule and slot."""
    return spark.read.schema(SCHEMA).parquet(f"{folder}/series")


def progress(spark: SparkSession, folder: str) -> dict[str, int]:
    """The time up to which each rule is recorded: a row a rule."""
    try:
        rows = spark.read.schema("rule string, upto long").parquet(f"{folder}/progress").collect()
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return {}
    return {r.rule: r.upto for r in rows}


def _aggregated(rows: DataFrame, t: Column, rules: list[Recorded], since: dict[str, int], recorded: bool) -> DataFrame:
    """One row a rule, labels and step, of rows that are exploded to the rules they count for within their task."""
    of = _pair if recorded else label
    shapes = []
    for r in rules:
        labels = F.array(*[F.struct(F.lit(c).alias("name"), of(c).alias("value")) for c in sorted(r.by)]).cast(LABELS)
        v = F.lit(None) if r.how == "count" else F.col(r.value)
        hit = (t > since[r.name]) & (F.lit(True) if r.where is None else F.expr(r.where))
        if recorded:
            hit = hit & (F.col("rule") == r.reads)
        shapes.append(F.when(hit, F.struct(F.lit(r.name).alias("rule"), labels.alias("labels"), v.cast("double").alias("v"))))
    each = rows.select(t.alias("t"), F.explode(F.filter(F.array(*shapes), lambda x: x.isNotNull())).alias("x")).select("t", "x.*")
    agg = each.groupBy("rule", "labels", "t").agg(F.count(F.lit(1)).cast("double").alias("count"), *[getattr(F, how)("v").alias(how) for how in ("sum", "min", "max")])
    pick = reduce(lambda c, r: F.when(F.col("rule") == r.name, F.col(r.how)).otherwise(c), rules, F.lit(None).cast("double"))
    return agg.select("rule", "labels", "t", pick.alias("value")).where("value is not null")


def _pair(name: str) -> Column:
    return F.coalesce(F.get(F.filter("labels", lambda x: x["name"] == name), F.lit(0))["value"], F.lit(""))


def _quotients(series: DataFrame, rules: list[Quotient], since: dict[str, int]) -> DataFrame:
    """Both sides of all quotients meet in one aggregation instead of a join each."""
    sides = [F.when((F.col("rule") == name) & (F.col("t") > since[r.name]), F.struct(F.lit(r.name).alias("rule"), F.lit(side).alias("side"))) for r in rules for side, name in (("over", r.over), ("under", r.under))]
    each = series.select("labels", "t", "value", F.explode(F.filter(F.array(*sides), lambda x: x.isNotNull())).alias("x")).select("x.*", "labels", "t", "value")
    both = each.groupBy("rule", "labels", "t").agg(*[F.max(F.when(F.col("side") == s, F.col("value"))).alias(s) for s in ("over", "under")])
    return both.select("rule", "labels", "t", F.try_divide("over", "under").alias("value")).where("value is not null")


def record(spark: SparkSession, sources: dict[str, tuple[DataFrame, str]], rules: list[Recorded | Quotient], folder: str, step: int, slot: int, start: int, upto: int) -> None:
    """Brings all rules up to the step that ends at ``upto`` or before.

    ``sources`` gives rows and their time column by name. A run starts with the slot that the last one ended in, whose
    steps are made again from all their rows, and overwrites the slots that it makes; so a run that is repeated or broken off
    and repeated leaves what one run leaves. Rows that come later than the run that made their slot's last step are not
    seen; delete the rule's progress to make it anew. ``slot`` is a multiple of ``step``, ``start`` of both.
    """
    upto = start + (upto - start) // step * step
    done = progress(spark, folder)
    since = {r.name: start + (done.get(r.name, start) - start) // slot * slot for r in rules}
    for level in levels(rules):
        first = min(since[r.name] for r in level)
        parts = []
        for name in dict.fromkeys(r.reads for r in level if isinstance(r, Recorded) and r.reads in sources):
            rows, ts = sources[name]
            u = micros(ts)
            parts.append(_aggregated(rows.where(later(ts, first) & not_later(ts, upto)), u + F.pmod(start - u, F.lit(step)), [r for r in level if r.needs == [name]], since, False))
        known = [n for r in level for n in r.needs if n not in sources]
        if known:
            series = read(spark, folder).where(F.col("rule").isin(known) & (F.col("slot") >= (first - start) // slot) & (F.col("t") > first) & (F.col("t") <= upto))
            again = [r for r in level if isinstance(r, Recorded) and r.reads not in sources]
            parts += [_aggregated(series, F.col("t"), again, since, True)] if again else []
            shares = [r for r in level if isinstance(r, Quotient)]
            parts += [_quotients(series, shares, since)] if shares else []
        rows = reduce(DataFrame.unionByName, parts)
        # the first slot holds the steps that end after start, up to start + slot
        placed = rows.withColumn("slot", F.floor((F.col("t") - 1 - start) / slot))
        placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("rule", "slot").parquet(f"{folder}/series")
        done |= {r.name: upto for r in level}
        spark.createDataFrame(sorted(done.items()), "rule string, upto long").coalesce(1).write.mode("overwrite").parquet(f"{folder}/progress")
