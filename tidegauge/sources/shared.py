"""Tables and stream checkpoints that a query needs for itself, in the shared folder of ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see; where the setting is unset, one that only a local master may use."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not top:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = os.path.join(tempfile.gettempdir(), "tidegauge-shared")
    return f"{top.rstrip('/')}/{name}-{uuid.uuid4().hex}"
