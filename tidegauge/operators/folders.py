"""Disk use: the sizes of files rolled up into all folders above them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.sources.shared import shared_folder


def files(spark: SparkSession, root: str, before: str | None = None, after: str | None = None, least: int = 0) -> DataFrame:
    """``(path, bytes, modified)`` of all files below a folder. Times are applied while listing, and no content is read.
    Spark's readers leave out empty files, so they aren't counted."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    for name, at in (("modifiedBefore", before), ("modifiedAfter", after)):
        reader = reader.option(name, at) if at else reader
    return reader.load(root).where(F.col("length") >= least).select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def folder_sizes(found: DataFrame, path: str = "path", size: str = "bytes") -> DataFrame:
    """``(folder, files, bytes)`` of every folder above a file, at any depth; ``folder`` has no slash at its end, the root is ``""``.

    Files are added up by folder once; then each level of folders is added to the one above it, so that what is
    shuffled is folders, not a row for each file and folder. A null size counts as 0; files without a path are left out.
    """
    spark = found.sparkSession
    at = shared_folder(spark, "folders")
    parent = lambda c: F.regexp_replace(c, "/?[^/]*$", "")
    depth = lambda c: F.when(c == "", 0).otherwise(F.size(F.split(c, "/")))
    plain = F.rtrim(F.regexp_replace(F.col(path), "/+", "/"), F.lit("/"))
    own = found.where(F.col(path).isNotNull()).groupBy(parent(plain).alias("folder")).agg(F.count(F.lit(1)).alias("files"), F.sum(F.coalesce(F.col(size), F.lit(0))).cast("long").alias("bytes"))
    own.withColumn("depth", depth(F.col("folder"))).write.parquet(f"{at}/own")
    own = spark.read.parquet(f"{at}/own")
    deepest = own.agg(F.max("depth")).first()[0]
    out, below = None, None
    for k in range(deepest if deepest is not None else -1, -1, -1):
        level = own.where(F.col("depth") == k).select("folder", "files", "bytes")
        if below is not None:
            level = level.unionByName(below.select(parent(F.col("folder")).alias("folder"), "files", "bytes")).groupBy("folder").agg(F.sum("files").alias("files"), F.sum("bytes").alias("bytes"))
            level.write.parquet(f"{at}/{k}")
            level = spark.read.parquet(f"{at}/{k}")
        below, out = level, level if out is None else out.unionByName(level)
    return own.select("folder", "files", "bytes").where("false") if out is None else out
