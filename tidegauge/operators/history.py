"""The history of alerts: when each began and ceased to fire, brought up to date by evaluations that follow each other.

The table is partitioned by ``evaluated``, the time of an evaluation. A partition holds the intervals ``[starts_at, ends_at)``
that ended since the evaluation before, and those still open then. An evaluation reads the open ones of the last
partition only, never the history, and writes its own partition, so that it can be repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions.labels import labelled


def firing_intervals(states: DataFrame, by: list[str], step: int) -> DataFrame:
    """``(*by, starts_at, ends_at)`` of the firing points ``(*by, t, state)``: points a step apart are one interval, which ends a
    step after its last."""
    points = labelled(states, by).where("state = 'firing'").select(*by, F.col("t").alias("starts_at"), (F.col("t") + step).alias("ends_at"))
    return touching(points, by)


def touching(intervals: DataFrame, by: list[str]) -> DataFrame:
    """Intervals of one series that overlap or touch, as one."""
    w = Window.partitionBy(*by).orderBy("starts_at", "ends_at")
    before = F.max("ends_at").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = F.coalesce(F.col("starts_at") > before, F.lit(True))
    numbered = intervals.withColumn("_first", first).withColumn("_n", F.count_if("_first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*by, "_n").agg(F.min("starts_at").alias("starts_at"), F.max("ends_at").alias("ends_at")).drop("_n")


class History:
    """The intervals of one rule set in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str, by: list[str], kinds: str):
        """``kinds``: the types of ``by``, like ``event_type string``."""
        self.spark, self.folder, self.by = spark, folder, by
        self.schema = f"{kinds}, starts_at long, ends_at long, open boolean, evaluated long"

    def _read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.folder)

    def merge(self, states: DataFrame, step: int, before: int | None, at: int) -> None:
        """Adds an evaluation: the states of the points after ``before``, the evaluation that this one follows (None for the
        first), up to ``at``. An interval that was open goes on if the first new point fires, else it has ended."""
        new = firing_intervals(states.where((F.col("t") <= at) & (F.lit(True) if before is None else F.col("t") > before)), self.by, step)
        if before is not None:
            new = touching(new.unionByName(self._read().where((F.col("evaluated") == before) & F.col("open")).select(*self.by, "starts_at", "ends_at")), self.by)
        rows = new.select(*self.by, "starts_at", "ends_at", (F.col("ends_at") > at).alias("open"), F.lit(at).cast("long").alias("evaluated"))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("evaluated").parquet(self.folder)

    def intervals(self, at: int, keep: int | None = None) -> DataFrame:
        """``(*by, starts_at, ends_at, open)`` as of the evaluation ``at``; with ``keep``, without those that ended so long before or longer."""
        rows = self._read().where((F.col("evaluated") <= at) & (~F.col("open") | (F.col("evaluated") == at)))
        if keep is not None:
            rows = rows.where((F.col("evaluated") > at - keep) & (F.col("ends_at") > at - keep))
        return rows.drop("evaluated")

    def forget(self, at: int, keep: int) -> None:
        """Deletes the partitions that hold nothing that ``intervals(at, keep)`` or a later evaluation could need."""
        jvm = self.spark.sparkContext._jvm
        top = jvm.org.apache.hadoop.fs.Path(self.folder)
        files = top.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in files.listStatus(top):
            name, _, value = status.getPath().getName().partition("=")
            if name == "evaluated" and int(value) <= at - keep and int(value) < at:
                files.delete(status.getPath(), True)
