"""Vector compression: product codes from integer k-means, exact in every distance, tie and mean.

Components become integers, vectors are cut into parts, and each part has a codebook. Distances come from one matrix product
per part, |c|^2 - 2 x.c: integers are split into limbs so narrow that a float64 product of limbs sums below 2^53 and is
exact, and the products are put together again in int64. The first smallest entry is the code. A round is one pass over the
vectors that returns a sum and a count for each entry, so what travels is bounded by the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.common import col

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Rows whose distances to a codebook are in memory at once.
_STEP = 4096


def limbs(values: np.ndarray, width: int) -> list[np.ndarray]:
    """``values`` as float64 limbs of ``width`` bits, least significant first; the last limb carries the sign."""
    out, bound, mask = [], 1 << width, (1 << width) - 1
    while values.size and not (-bound <= values.min() and values.max() < bound):
        out.append((values & mask).astype(np.float64))
        values = values >> width
    return [*out, values.astype(np.float64)]


def dots(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """All inner products of the rows of two int64 matrices, exact as long as they fit into int64."""
    width = (53 - max(1, x.shape[1] - 1).bit_length()) // 2
    total = np.zeros((len(x), len(c)), np.int64)
    right = limbs(c, width)
    for i, a in enumerate(limbs(x, width)):
        for j, b in enumerate(right):
            total += (a @ b.T).astype(np.int64) * np.int64(1 << width * (i + j))
    return total


def nearest(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first nearest of ``entries`` for each row of ``x``, and the squared distance."""
    score = (entries * entries).sum(axis=1)[None, :] - 2 * dots(x, entries)
    best = score.argmin(axis=1)
    return best, (x * x).sum(axis=1) + score[np.arange(len(x)), best]


def _integers(flat: np.ndarray, size: int, parts: int, scale: int) -> np.ndarray:
    """Rows as ``(row, part, place)`` integers, floor(scale * x); a size that parts do not divide is filled up with zeros."""
    x = np.floor(flat.reshape(-1, size) * scale) if size else np.zeros((0, 0))
    most = 1 << (61 - size.bit_length()) // 2
    if x.size and np.abs(x).max() >= most:
        raise ValueError(f"components of {size}-dimensional vectors must lie within {most // scale}: larger ones have no exact error")
    x = x.astype(np.int64)
    wide = -(-size // parts) * parts
    return np.pad(x, ((0, 0), (0, wide - size))).reshape(len(x), parts, wide // parts)


@dataclass(frozen=True)
class Codebooks:
    """For each vector length an array ``(part, entry, place)`` of integers."""

    books: dict[int, np.ndarray]
    parts: int = PARTS
    scale: int = SCALE

    def digest(self, size: int) -> str:
        """SHA-256 of the decimal components by part, entry and place, joined by commas."""
        return hashlib.sha256(",".join(map(str, self.books[size].ravel().tolist())).encode()).hexdigest()


def kept(vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, size, e`` of the vectors that take part: not null, without null or non-finite components."""
    own = vectors.select(col(vec_id).cast("long").alias("vec_id"), col(label).alias("label"), col(embedding).cast("array<double>").alias("e"))
    finite = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return own.where(F.col("e").isNotNull() & finite).withColumn("size", F.size("e"))


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each length in a batch with columns ``size`` and ``e``: the length, the rows that have it, their components."""
    sizes = np.asarray(batch.column("size"))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        yield size, rows, np.asarray(batch.column("e").take(pa.array(rows)).flatten(), np.float64)


def _seeds(rows: DataFrame, parts: int, entries: int, scale: int) -> dict[int, np.ndarray]:
    """Codebooks of the smallest ids of each length; a task hands on no more ids than a codebook has entries."""

    def smallest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, np.ndarray] = {}
        for batch in batches:
            sizes, ids = np.asarray(batch.column("size")), np.asarray(batch.column("vec_id"), np.int64)
            for size in np.unique(sizes).tolist():
                least[size] = np.unique(np.append(least.get(size, ids[:0]), ids[sizes == size]))[:entries]
        for size, ids in least.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), size, np.int32)), pa.array(ids)], ["size", "vec_id"])

    order = Window.partitionBy("size").orderBy("vec_id")
    ids = rows.where("vec_id is not null").select("size", "vec_id").mapInArrow(smallest, "size int, vec_id long").distinct()
    chosen = ids.withColumn("at", F.row_number().over(order)).where(F.col("at") <= entries).drop("at")
    found = rows.join(F.broadcast(chosen), ["size", "vec_id"]).groupBy("size", "vec_id").agg(F.min("e").alias("e")).collect()
    books: dict[int, np.ndarray] = {}
    for size in {r["size"] for r in found}:
        flat = np.array([x for r in sorted((r for r in found if r["size"] == size), key=lambda r: r["vec_id"]) for x in r["e"]], np.float64)
        books[size] = _integers(flat, size, parts, scale).transpose(1, 0, 2).copy() if size else np.zeros((parts, 1, 0), np.int64)
    return books


def learn(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> Codebooks:
    """Codebooks by ``rounds`` of integer k-means, started at the ``entries`` smallest ids.

    Null vectors and those with a null or non-finite component take no part; zero vectors do. Each length has codebooks of
    its own; a length that ``parts`` does not divide counts as filled up with zeros. Rows with a null id never start an
    entry; of several rows with one id the smallest vector does, and all of them count in the means. Fewer ids than entries
    give smaller codebooks, an empty table none. Other columns play no part. Components too large for an exact distance in
    64 bits (beyond 1.6e6 at 64 dimensions and a scale of 1024) are an error.
    """
    rows = kept(vectors, vec_id=vec_id, embedding=embedding, label=label)
    books = _seeds(rows, parts, entries, scale)
    context = vectors.sparkSession.sparkContext
    for _ in range(rounds if books else 0):
        shared = context.broadcast(books)

        def tally(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums = {size: np.zeros_like(own) for size, own in shared.value.items()}
            counts = {size: np.zeros(own.shape[:2], np.int64) for size, own in shared.value.items()}
            for batch in batches:
                for size, _, flat in _by_size(batch):
                    if size not in sums:
                        continue
                    x = _integers(flat, size, parts, scale)
                    for first in range(0, len(x), _STEP):
                        for p in range(parts):
                            own = x[first : first + _STEP, p]
                            at, _ = nearest(own, shared.value[size][p])
                            np.add.at(sums[size][p], at, own)
                            counts[size][p] += np.bincount(at, minlength=len(counts[size][p]))
            for size, n in counts.items():
                p, e = np.nonzero(n)
                flat = sums[size][p, e]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]), pa.array(flat.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), size, np.int32)), pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(n[p, e]), lists], ["size", "part", "entry", "n", "total"])

        found = rows.select("size", "e").mapInArrow(tally, "size int, part int, entry int, n long, total array<long>")
        places = found.select("size", "part", "entry", "n", F.posexplode("total").alias("place", "x")).groupBy("size", "part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
        means = places.groupBy("size", "part", "entry").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("place", "x"))).alias("x"))
        books = {size: own.copy() for size, own in books.items()}
        for r in means.collect():
            books[r["size"]][r["part"], r["entry"]] = np.array([x for _, x in r["x"]], np.int64) // r["n"]
        shared.unpersist()
    return Codebooks(books, parts, scale)


def encode(vectors: DataFrame, codebooks: Codebooks, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id, label, size, code, error`` for every vector that takes part: the entries of its parts, one byte each (up to 256
    entries), and its squared distance from them. An empty vector has the code of zeros and no error; a length without
    codebooks (its ids are all null) has null for both. Repeated rows are coded each."""
    rows = kept(vectors, vec_id=vec_id, embedding=embedding, label=label)
    kind = rows.schema["label"].dataType.simpleString()
    shared = vectors.sparkSession.sparkContext.broadcast(codebooks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            codes, errors, known = np.zeros((batch.num_rows, own.parts), np.uint8), np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, bool)
            for size, at, flat in _by_size(batch):
                known[at] = size in own.books
                if not size or size not in own.books:
                    continue
                x = _integers(flat, size, own.parts, own.scale)
                for first in range(0, len(x), _STEP):
                    here = at[first : first + _STEP]
                    for p in range(own.parts):
                        code, distance = nearest(x[first : first + _STEP, p], own.books[size][p])
                        codes[here, p] = code
                        errors[here] += distance
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(own.parts), batch.num_rows, [None, pa.py_buffer(codes.tobytes())]).cast(pa.binary())
            code = pa.array([x if k else None for x, k in zip(packed.to_pylist(), known.tolist(), strict=True)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), batch.column("size"), code, pa.array(errors, mask=~known)], ["vec_id", "label", "size", "code", "error"])

    return rows.mapInArrow(run, f"vec_id long, label {kind}, size int, code binary, error long")


def salt(pieces: int = 64) -> Column:
    """One of ``pieces`` numbers for each row of ``encode``, so that rows of a common label meet its sum in several tasks."""
    return F.pmod(F.xxhash64("vec_id", "code"), F.lit(pieces)).cast("int")


def label_errors(codes: DataFrame, pieces: int = 64) -> DataFrame:
    """``of_label, of_salt, label_error``: the errors summed over equal labels (nulls are equal), once for each ``salt``."""
    sums = codes.groupBy(F.col("label").alias("of_label")).agg(F.sum("error").alias("label_error"))
    return sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(pieces - 1))))


def decode(codes: DataFrame, codebooks: Codebooks) -> DataFrame:
    """``codes`` (with ``size`` and ``code``) and ``embedding``: the entries' components, divided by the scale. Null codes give null."""
    shared = codes.sparkSession.sparkContext.broadcast(codebooks)

    def one(size: int | None, code: bytes | None) -> list[float] | None:
        if size is None or code is None:
            return None
        own = shared.value
        return (np.concatenate([own.books[size][p][k] for p, k in enumerate(code)]) / own.scale)[:size].tolist()

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sizes, found in batches:
            yield pa.array([one(s, c) for s, c in zip(sizes.to_pylist(), found.to_pylist(), strict=True)], pa.list_(pa.float64()))

    return codes.withColumn("embedding", F.arrow_udf(run, "array<double>")("size", "code"))
