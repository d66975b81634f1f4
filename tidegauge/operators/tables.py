"""Joins, comparisons and roll-ups of inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import label, matched, whole_match


def snapshot_delta(before: DataFrame, after: DataFrame, on: list[str], value: str) -> DataFrame:
    """``(*on, delta)`` of what has risen; keys that only one snapshot has are left out."""
    both = matched(after.select(*on, F.col(value).alias("_b")), before.select(*on, F.col(value).alias("_a")), on)
    return both.select(*on, (F.col("_b") - F.col("_a")).alias("delta")).where("delta > 0")


def first_match(line: Column, keywords: list[str], otherwise: str = "other") -> Column:
    """The first keyword, in the list's order, that the line holds in any case. The line is lowered once."""
    words = F.array(*map(F.lit, keywords))
    return F.coalesce(F.get(F.transform(F.array(F.lower(line)), lambda low: F.get(F.filter(words, lambda k: F.contains(low, F.lower(k))), F.lit(0))), F.lit(0)), F.lit(otherwise))


def selected(objects: DataFrame, key: str, labels: str, selectors: DataFrame) -> DataFrame:
    """``(selector, key)``: selectors ``(selector, k, v)`` all of whose pairs an object's label map holds. The rows of one key are
    one object; a pair that comes more than once counts once."""
    selectors = selectors.distinct()
    pairs = objects.select(key, F.explode(labels).alias("k", "v")).distinct()
    size = selectors.groupBy("selector").agg(F.count(F.lit(1)).alias("size"))
    hits = pairs.join(selectors, ["k", "v"]).groupBy("selector", key).agg(F.count(F.lit(1)).alias("n"))
    return hits.join(size, "selector").where("n = size").select("selector", key)


def last_n(rows: DataFrame, by: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each group in the given order (descending time: the last)."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= n).drop("_n")


def carried(rows: DataFrame, by: list[str], order: str, value: Column, name: str) -> DataFrame:
    """``name``: the last non-null value so far, by group and order."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def context(rows: DataFrame, by: list[str], order: str, hit: Column, before: int, after: int) -> DataFrame:
    """Rows that match, with those around them."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-after, before)
    return rows.withColumn("_near", F.max(hit.cast("int")).over(w)).where("_near = 1").drop("_near")


def matrix(rows: DataFrame, row: str, column: str, values: list[str], cell: Column) -> DataFrame:
    return rows.groupBy(row).pivot(column, values).agg(cell)


def relabelled(rows: DataFrame, rules: list[dict]) -> DataFrame:
    """Relabel rules in order, each ``{action: keep | drop | replace, source, regex, target, replacement}``; patterns match whole values."""
    for r in rules:
        source = F.concat_ws(";", *[label(c) for c in r["source"]]) if r.get("source") else F.lit("")
        pattern = whole_match(r.get("regex", "(.*)"))
        hit = source.rlike(pattern)
        if r["action"] == "keep":
            rows = rows.where(hit)
        elif r["action"] == "drop":
            rows = rows.where(~hit)
        else:
            new = F.regexp_replace(source, pattern, r.get("replacement", "$1"))
            old = F.col(r["target"]) if r["target"] in rows.columns else F.lit(None).cast("string")
            rows = rows.withColumn(r["target"], F.when(hit, new).otherwise(old))
    return rows
