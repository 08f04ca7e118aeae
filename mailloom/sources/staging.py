"""Intermediate tables: written ones, computed once, read by several branches, safe from lost executors; and rows dealt anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_local_roots: dict[str, str] = {}


def staging_root(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only for a local master."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_roots:
        _local_roots[app] = tempfile.mkdtemp(prefix="mailloom-")
    return _local_roots[app]


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet under the checkpoint folder and read it back.

    Readers prune columns, and the optimizer cannot repeat costly expressions of ``df`` in the
    filters and join keys built on them.
    """
    spark = df.sparkSession
    path = f"{staging_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_PLAIN = (T.StringType, T.BinaryType, T.BooleanType, T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


def spread(df: DataFrame) -> DataFrame:
    """Deal the rows out by a hash of all their plain columns, ahead of work that costs far more than a row's bytes.

    A scan has tasks by bytes and row groups, so a compressed table of many short texts would be worked on by a few of them.
    """
    plain = [f"`{f.name.replace('`', '``')}`" for f in df.schema.fields if isinstance(f.dataType, _PLAIN)]
    return df.repartition(*plain) if plain else df
