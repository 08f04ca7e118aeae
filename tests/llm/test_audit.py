"""The audit of near vectors beside one very large group."""

import numpy as np

from mailloom.llm import hnsw


def _skewed():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=32)
    group = centre + 0.01 * rng.normal(size=(1500, 32))
    base = rng.normal(size=(40, 32))
    rows = np.concatenate([group, base, base + 0.02 * rng.normal(size=base.shape)])
    return rows, np.arange(len(rows)) * 3


def test_missed_small_groups_are_seen_beside_a_large_one():
    rows, ids = _skewed()
    own = hnsw._unit(rows)
    true = (own @ own.T >= 0.95).sum(axis=1) - 1
    assert not len(hnsw._audit(own, ids, own, ids, true, 0.95))
    missed = true.copy()
    missed[1500:1580:2] = 0
    assert len(hnsw._audit(own, ids, own, ids, missed, 0.95))


def test_pieces_and_counts():
    rows, ids = _skewed()
    own = hnsw._unit(rows)
    near = own @ own.T >= 0.95
    np.fill_diagonal(near, False)
    graph = hnsw.Graph(ids, rows, np.ones(len(ids), np.int64))
    counts, x, y = hnsw.linked(graph, rows, ids, 0.95)
    assert counts.tolist() == near.sum(axis=1).tolist() and len(x) == 1499 + 40
    pieces = [len(q) for q, _ in hnsw._pairs(graph, own.astype(np.float32), np.arange(len(rows)), 24, np.float32(0.95))]
    assert sum(pieces) >= 1500 * 1500 and max(pieces) <= hnsw._FRONT
