"""Message tables as streams.

Row filters, projections and text functions keep no state, so they run unchanged on the stream
this module opens. Numbering, joins and aggregates are batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from mailloom.sources.messages import headers


def stream_messages(spark: SparkSession, path: str, bodies: bool = False, files_per_batch: int = 1000) -> DataFrame:
    """Follow a message table written by :func:`mailloom.sources.messages.write_messages`."""
    schema = spark.read.parquet(path).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return headers(stream, bodies)
