"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that a task takes into its numpy arrays at once; a longer text is one piece of its own.
SLICE_BYTES = 1 << 20
#: Rows and bytes of an Arrow batch of whole texts; a task holds some of them on both sides of the pipe to Python.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where none is set."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mailloom-checkpoint-"))


def bounded_batches(spark: SparkSession) -> None:
    """Make the Arrow batches of this session small, unless it asks for smaller ones. Results do not depend on it."""
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        own = spark.conf.get(f"spark.sql.execution.arrow.{name}").rstrip("b")
        if not own.isdigit() or not 0 < int(own) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


def materialised(df: DataFrame) -> DataFrame:
    """``df`` written to the checkpoint folder, with its lineage cut."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def col(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the offsets of its rows in them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    if not len(column) or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    found = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(data, np.uint8), found


def slices(offsets: np.ndarray, most: int = SLICE_BYTES):
    """Runs ``(first, last + 1)`` of rows with about ``most`` bytes each."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1
        last = min(max(last, first + 1), rows)
        yield first, last
        first = last


def mix64(h: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class LocalForest:
    """Union of pairs inside one task; keeps one link per merged node, however many pairs come."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        label = self.label
        while True:
            x, y = label[a], label[b]
            open_ = x != y
            if not open_.any():
                self.label = label
                return
            a, b, x, y = a[open_], b[open_], x[open_], y[open_]
            np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
            while True:
                shorter = label[label]
                if (shorter == label).all():
                    break
                label = shorter

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def components(edges: DataFrame) -> DataFrame:
    """``(node, component)`` for the nodes of ``edges (a, b)``: the smallest node that each can reach.

    Alternates the large-star and small-star steps until the edges are stars. Every step is a map-side combined minimum and
    a join, so a hub is a skewed join and never one group; each round is written to the checkpoint folder. Loops and null
    ends are ignored; no edges give no rows.
    """
    edges = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = materialised(edges)
    seen = _summary(edges)
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialised(small.union(least).distinct())
        now = _summary(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def _summary(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
