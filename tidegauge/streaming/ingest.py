"""Structured Streaming: log ingestion, and rule evaluation on event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidegauge.functions.labels import labelled, matched
from tidegauge.sources.tables import pod_lines


def tail(spark: SparkSession, glob: str, files_per_batch: int = 1000, node: str | None = None) -> DataFrame:
    """New lines of pod logs, by the same functions as the batch reader."""
    raw = spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(glob)
    return pod_lines(raw.select("value", F.col("_metadata.file_path").alias("path")), node)


def append_by_day(lines: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends all lines that there are now, in folders by day, and ends."""
    dated = lines.withColumn("day", F.to_date("time"))
    return dated.writeStream.format("parquet").partitionBy("day").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def bursts(lines: DataFrame, ts: str, by: list[str], window: str, over: int, late: str = "1 hour") -> DataFrame:
    """``(start, end, *by, n)`` of event-time windows with more than ``over`` lines; lines later than ``late`` are ignored."""
    counted = lines.withWatermark(ts, late).groupBy(F.window(ts, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.where(F.col("n") > over).select("window.start", "window.end", *by, "n")


def once(lines: DataFrame, ts: str, key: list[str], late: str = "1 hour") -> DataFrame:
    """The first of the lines with one ``key`` that comes; lines that are later than ``late`` behind the latest are left out.

    Keys are remembered only as long as a copy could be on time. A missing part of a key equals the empty string. ``ts`` is a
    timestamp with zone.
    """
    return labelled(lines, key).withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def unkept(sent: DataFrame, kept: DataFrame, key: list[str]) -> DataFrame:
    """``(*key, late, resent)``: how many of the lines sent, a stream's input read as a table, came too late and how many
    were copies of one that was kept. Keys all of whose lines were kept have no row; kept + late + resent is what was sent."""
    n = labelled(sent, key).groupBy(*key).agg(F.count(F.lit(1)).alias("n"))
    stored = labelled(kept, key).groupBy(*key).agg(F.count(F.lit(1)).alias("stored"))
    both = matched(n, stored, key, "left").withColumn("stored", F.coalesce("stored", F.lit(0)))
    late = F.when(F.col("stored") == 0, F.col("n")).otherwise(0)
    return both.select(*key, late.alias("late"), (F.col("n") - F.col("stored") - late).alias("resent")).where("late > 0 or resent > 0")


def append(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what there is now, and ends; the next call with the same checkpoint goes on from there."""
    return rows.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()
