"""Vectors as packed arrays: which rows take part, and how they reach numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import col


def usable(df: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``(id, e)``: one vector of doubles for each id.

    Left out are null ids and vectors that are null, empty, zero, or hold a null or non-finite component. Of several rows
    with one id (repeated rows) the smallest vector stands.
    """
    own = df.select(col(vec_id).cast("long").alias("id"), col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("id").isNotNull() & F.col("e").isNotNull() & finite & F.exists("e", lambda x: x != 0)).groupBy("id").agg(F.min("e").alias("e"))


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """The rows of a column of equally long lists of doubles."""
    flat = np.concatenate([np.asarray(x.flatten(), np.float64) for x in column.chunks]) if column.num_chunks else np.zeros(0)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
