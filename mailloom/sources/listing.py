"""Directory listings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_listing(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Files below ``path`` as (folder, file_name, size, modified); contents are not read."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
    )
    parts = F.split("path", "/")
    return files.select(
        F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "/").alias("folder"),
        F.element_at(parts, -1).alias("file_name"),
        F.col("length").alias("size"),
        F.col("modificationTime").alias("modified"),
    )
