"""Intermediate tables in the shared folder of ``spark.checkpoint.dir``.

Every task may run on another machine and be run again, so a result that is used more than once is written as
Parquet below the checkpoint folder and read back: that cuts the lineage, survives the loss of executors, and lets
later reads prune columns.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where unset, a temporary one, which only a local master may use."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return os.path.join(tempfile.gettempdir(), "tidegauge-shared")


#: The tables of the innermost ``freed`` of this thread or task, if any.
_opened: ContextVar[list[Scratch] | None] = ContextVar("opened", default=None)


@contextmanager
def freed() -> Iterator[None]:
    """At the end, failed or not, the tables of all Scratches made within are dropped: for callers that have written what they
    wanted. Other threads' tables are theirs."""
    own: list[Scratch] = []
    before = _opened.set(own)
    try:
        yield
    finally:
        _opened.reset(before)
        for scratch in reversed(own):
            scratch.drop("")


class Scratch:
    """Tables of one operator's run; ``drop`` frees those that no later plan reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        if (own := _opened.get()) is not None:
            own.append(self)

    def path(self, table: str) -> str:
        return f"{self.root}/{table}" if table else self.root

    def save(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("overwrite").option("compression", "zstd").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
