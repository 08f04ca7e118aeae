"""Nearest neighbours of a stated query set by a block matrix join on int8 tiles.

Candidates and queries are cut into blocks of bounded size, and each pair of blocks is one tile. In a tile vectors are
quantised to int8 with a scale of their own; the product of the quantised matrices is exact, and the norms of what
quantisation took away bound the error of every inner product. Pairs whose upper bound reaches the k-th best lower bound of
their query survive, are computed again in double precision, and meet in heaps: first of the tile, then of all tiles.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.vectors import matrix, usable

#: Rows of a tile: candidates and queries.
CANDIDATES, QUERIES = 8192, 2048
#: Queries multiplied at once, dimensions whose int8 products float32 sums exactly, and pairs computed again at once.
_STEP, _EXACT_DIMS, _PAIRS = 128, 1024, 1 << 15


class _Quantised:
    """Rows as scale x int8, the norm of that, and the norm of the rest."""

    def __init__(self, rows: np.ndarray):
        scale = np.abs(rows).max(axis=1) / 127.0
        self.scale = np.where(scale > 0, scale, 1.0)
        self.codes = np.rint(rows / self.scale[:, None]).astype(np.int8)
        near = self.codes * self.scale[:, None]
        self.norm = np.linalg.norm(near, axis=1)
        self.rest = np.linalg.norm(rows - near, axis=1)


def tile_nearest(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int):
    """``(query id, id, inner product)`` of the ``k`` nearest of each query in one tile, the query's own id left out."""
    base = _Quantised(rows)
    parts = [slice(d, d + _EXACT_DIMS) for d in range(0, rows.shape[1], _EXACT_DIMS)]
    codes = [base.codes[:, p].astype(np.float32).T for p in parts]
    for first in range(0, len(queries), _STEP):
        own = queries[first : first + _STEP]
        own_ids = query_ids[first : first + _STEP]
        q = _Quantised(own)
        product = sum((q.codes[:, p].astype(np.float32) @ c).astype(np.float64) for p, c in zip(parts, codes, strict=True))
        near = product * q.scale[:, None] * base.scale[None, :]
        error = q.norm[:, None] * base.rest + q.rest[:, None] * (base.norm + base.rest)
        error += 1e-12 * (q.norm + q.rest)[:, None] * (base.norm + base.rest)
        low = near - error
        low[own_ids[:, None] == ids[None, :]] = -np.inf
        bar = np.partition(low, len(ids) - k, axis=1)[:, len(ids) - k] if len(ids) > k else np.full(len(own), -np.inf)
        survives = (near + error >= bar[:, None]) & (own_ids[:, None] != ids[None, :])
        at_query, at = np.nonzero(survives)
        exact = np.concatenate([np.zeros(0), *[np.cumsum(own[at_query[i : i + _PAIRS]] * rows[at[i : i + _PAIRS]], axis=1)[:, -1] for i in range(0, len(at), _PAIRS)]])
        bounds = np.searchsorted(at_query, np.arange(len(own) + 1))
        for n, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
            best = heapq.nsmallest(k, zip((-exact[a:b]).tolist(), ids[at[a:b]].tolist(), strict=True))
            yield from ((int(own_ids[n]), i, -s) for s, i in best)


def nearest(vectors: DataFrame, *, k: int = 20, every: int = 20, vec_id: str = "vec_id", embedding: str = "embedding", candidates: int = CANDIDATES, queries: int = QUERIES) -> DataFrame:
    """``(query_id, rank, vec_id, score)``: for each id divisible by ``every``, the ``k`` other rows of largest inner product.

    Exact: bounds only decide what is computed again. Ties go to the smaller id. ``vectors.usable`` says which rows take
    part; vectors meet only others of their length. With fewer than ``k`` others all are returned; an empty table, or a query
    without others, gives no rows. Other columns play no part.
    """
    own = usable(vectors, vec_id, embedding).withColumn("d", F.size("e"))
    sizes = own.agg(F.count(F.lit(1)), F.count(F.when(F.col("id") % every == 0, 1))).first()
    many, wanted = -(-sizes[0] // candidates) or 1, -(-sizes[1] // queries) or 1
    left = own.withColumn("c", F.pmod(F.xxhash64("id"), F.lit(many))).withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(wanted - 1))))
    right = own.where(F.col("id") % every == 0).withColumn("q", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(wanted)).cast("int")).withColumn("c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(many - 1).cast("long"))))

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        found = []
        if base.num_rows and asked.num_rows:
            found = list(tile_nearest(base["id"].to_numpy(), matrix(base["e"]), asked["id"].to_numpy(), matrix(asked["e"]), k))
        return pa.table({"query_id": pa.array([x[0] for x in found], pa.int64()), "vec_id": pa.array([x[1] for x in found], pa.int64()), "score": pa.array([x[2] for x in found], pa.float64())})

    keys = ("d", "c", "q")
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "query_id long, vec_id long, score double")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
