"""Questions about nested objects, answered inside each object's arrays and maps without exploding them where possible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import labelled, matched


def array_sum(array: str, field: str) -> Column:
    """The sum of a field over an array of structs; nulls count as 0, and so does a null array."""
    return F.aggregate(F.coalesce(F.col(array), F.array()), F.lit(0).cast("long"), lambda a, c: a + F.coalesce(c[field], F.lit(0)))


def array_count(array: str, condition) -> Column:
    return F.size(F.filter(array, condition)).cast("long")


def names(array: str, condition, field: str = "name") -> Column:
    """The sorted field of the elements that meet the condition, as text."""
    return F.array_join(F.array_sort(F.transform(F.filter(array, condition), lambda c: c[field])), ",")


def alert_flags(alerts: DataFrame) -> DataFrame:
    """Alerts ``(..., silenced_by, inhibited_by)`` with ``active, silenced, inhibited``; a missing list is empty."""
    some = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return alerts.select("*", some("silenced_by").alias("silenced"), some("inhibited_by").alias("inhibited")).withColumn("active", ~F.col("silenced") & ~F.col("inhibited"))


def denied(rows: DataFrame, selectors: list[tuple[str, str, list[str]]]) -> Column:
    """Whether a row meets every selector ``(column, Equal | Prefix | NotIn, values)`` of a policy."""
    out = F.lit(True)
    for column, operator, values in selectors:
        value = F.coalesce(F.col(column).cast("string"), F.lit(""))
        if operator == "Prefix":
            hit = F.lit(False)
            for v in values:
                hit = hit | value.startswith(v)
        else:
            hit = value.isin(values) if operator == "Equal" else ~value.isin(values)
        out = out & hit
    return out


def upsert(old: DataFrame, new: DataFrame, on: list[str]) -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it lacks."""
    return labelled(new, on).unionByName(matched(old, new.select(*on), on, "left_anti"))


def bits(mask: Column, meanings: list[str], otherwise: str = "ok") -> Column:
    """The names of a mask's set bits, from the lowest."""
    set_bits = F.filter(F.array(*[F.when(F.getbit(mask, F.lit(i)) == 1, F.lit(name)) for i, name in enumerate(meanings)]), lambda x: x.isNotNull())
    return F.when(F.size(set_bits) > 0, F.array_join(set_bits, "|")).otherwise(otherwise)


def level(value: Column, steps: list[tuple[float, str]], otherwise: str) -> Column:
    """The text of the first threshold that the value reaches; ``steps`` from high to low."""
    out = F.lit(otherwise)
    for least, text in reversed(steps):
        out = F.when(value >= least, F.lit(text)).otherwise(out)
    return out


def joined_lines(rows: DataFrame, stream: list[str], order: list[str], flag: str, line: str, stretch: int | None = None) -> DataFrame:
    """``(*stream, first, line)``: lines whose parts carry the flag P up to one with F, put together; an open end is told too.

    ``first`` is the place of a line's first part. The parts of one line come together in one row; lines don't. With
    ``stretch``, for a first order column of whole numbers, a stream is counted in stretches of that many of them, and the
    stretches by their counts, so that no task sorts a whole stream. Streams with null names are streams too.
    """
    keys = [*stream, "_stretch"]
    rows = rows.withColumn("_stretch", F.floor(F.col(order[0]) / stretch) if stretch else F.lit(0))
    whole = (F.col(flag) == "F").cast("long")
    own = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumn("_line", F.coalesce(F.sum(whole).over(own), F.lit(0)))
    if stretch:
        counts = rows.groupBy(*keys).agg(F.sum(whole).alias("_n"))
        up_to = Window.partitionBy(*stream).orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
        placed = matched(placed, counts.select(*keys, F.coalesce(F.sum("_n").over(up_to), F.lit(0)).alias("_before")), keys).withColumn("_line", F.col("_line") + F.col("_before"))
    parts = placed.groupBy(*stream, "_line").agg(F.array_sort(F.collect_list(F.struct(*order, F.col(line).alias("part")))).alias("parts"))
    return parts.select(*stream, F.col("parts")[0][order[0]].alias("first"), F.array_join(F.col("parts.part"), "").alias("line"))


def last(array: Column, k: int) -> Column:
    """The last ``k`` elements; all of a shorter array, none of a null one."""
    a = F.coalesce(array, F.array().cast("array<string>"))
    return F.slice(a, F.greatest(F.size(a) - (k - 1), F.lit(1)), k)


def with_entry(spec: Column, status: Column, missing: Column) -> Column:
    """Each key of the map ``spec`` with ``status`` under the same key, or ``missing``: a left join within one object."""
    found = F.coalesce(status, F.create_map().cast("map<string,bigint>"))
    return F.transform(F.map_entries(spec), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("spec"), F.coalesce(F.try_element_at(found, e["key"]), missing).alias("status")))


def size_bytes(text: Column) -> Column:
    """Bytes of a size such as ``1.5G``, by powers of 1024; null for other texts."""
    number, unit = (F.regexp_extract(text, r"^([0-9]+(?:\.[0-9]+)?)([KMGT]?)$", i) for i in (1, 2))
    power = F.when(unit == "K", 1).when(unit == "M", 2).when(unit == "G", 3).when(unit == "T", 4).otherwise(0)
    return F.when(number != "", number.cast("double") * F.pow(F.lit(1024.0), power))
