"""Sources and sinks: tables by name, delimited snapshots, pod logs and nested objects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.functions.lines import cri, pod_path

SNAPSHOT = "ns string, name string, restarts int, minutes_ago double"
#: The list of container states of a pod object.
CONTAINERS = "array<struct<name:string,restartCount:int,ready:boolean,lastState:struct<terminated:struct<reason:string,finishedAt:string>>>>"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def snapshot(spark: SparkSession, path: str) -> DataFrame:
    """``ns|name|restarts|minutes_ago`` lines; malformed ones are dropped, whichever columns are read: those of another number of
    fields, and those whose numbers are none. Lines are split as text, as the CSV reader would only look at the columns asked for."""
    parts = spark.read.text(path).select(F.split("value", r"\|", -1).alias("p")).where(F.size("p") == 4)
    rows = parts.select(F.col("p")[0].alias("ns"), F.col("p")[1].alias("name"), F.col("p")[2].try_cast("int").alias("restarts"), F.col("p")[3].try_cast("double").alias("minutes_ago"))
    return rows.where("restarts is not null and minutes_ago is not null")


def write_snapshot(df: DataFrame, path: str) -> None:
    """The lines that ``snapshot`` reads; a bar or line end in a name, which they can't hold, raises."""
    bad = F.col("ns").rlike(r"[|\n\r]") | F.col("name").rlike(r"[|\n\r]")
    line = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("ns", "name", "restarts", "minutes_ago")])
    df.select(F.when(F.coalesce(bad, F.lit(False)), F.raise_error(F.lit("a name holds a bar or a line end"))).otherwise(line).alias("value")).write.mode("overwrite").text(path)


def pod_lines(raw: DataFrame, node: str | None = None) -> DataFrame:
    """``(time, namespace, pod, container, stream, node, flag, line)`` from ``raw (value, path)``, batch or stream; other lines and paths go."""
    parsed = raw.select(cri(F.col("value")).alias("c"), pod_path(F.col("path")).alias("p")).where("c is not null and p is not null")
    return parsed.select(F.try_to_timestamp(F.col("c.time")).alias("time"), "p.namespace", "p.pod", "p.container", "c.stream", F.lit(node).alias("node"), "c.flag", F.col("c.message").alias("line"))


def read_pod_logs(spark: SparkSession, glob: str, node: str | None = None) -> DataFrame:
    return pod_lines(spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path")), node)


def containers(objects: DataFrame) -> DataFrame:
    """``(namespace, pod, container, restarts, reason, finished_at)``: a row a container of nested pod objects."""
    each = objects.select("metadata.namespace", F.col("metadata.name").alias("pod"), F.explode("status.containerStatuses").alias("c"))
    return each.select("namespace", "pod", F.col("c.name").alias("container"), F.col("c.restartCount").alias("restarts"), F.col("c.lastState.terminated.reason").alias("reason"), F.try_to_timestamp(F.col("c.lastState.terminated.finishedAt")).alias("finished_at"))
