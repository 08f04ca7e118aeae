"""Near-duplicate vectors with hierarchical navigable small-world graphs.

Vectors are dealt into shards; each shard builds a layered graph once. Every vector then searches every shard: queries travel
in blocks, graphs to the blocks, and each pair is a task of bounded size. A search keeps a beam of the best nodes and opens
their neighbours, for many queries at a time; from the nodes that link it goes on through all linked ones. Beams are widened
while an audit, some queries held against all vectors of the shard, misses links. Found pairs are verified by cosine in
double precision; a task returns each query's number of links and a forest of them, not all pairs.
"""

from __future__ import annotations

import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import LocalForest, components, materialised, mix64
from mailloom.llm.vectors import matrix, usable

#: Vectors of a shard, least number of shards, and queries of a block.
SHARD_ROWS, LEAST_SHARDS, BLOCK_ROWS = 50_000, 8, 16384
#: Neighbours of a node on the lowest and on other layers, beam while building, beam while searching.
DEGREE, UPPER_DEGREE, BUILD_BEAM, SEARCH_BEAM = 24, 12, 32, 24
#: Queries of a block and kind that are audited, the mean share of their links that they must find, and how many links are few.
AUDIT, RECALL, FEW = 48, 0.99, 8
_QUERIES, _OPEN, _FRONT = 256, 4, 8192


def _unit(rows: np.ndarray) -> np.ndarray:
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def _similarity(queries: np.ndarray, vectors: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.matmul(vectors[at], queries[:, :, None])[:, :, 0]


def _beam(graph: np.ndarray, vectors: np.ndarray, queries: np.ndarray, entry: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``width`` best nodes found for each query, best first, and their similarities; -1 where there is none."""
    many, n = len(queries), len(graph)
    ids = np.full((many, width), -1, np.int64)
    sims = np.full((many, width), -np.inf, np.float32)
    done = np.ones((many, width), bool)
    seen = np.zeros((many, n + 1), bool)
    rows = np.arange(many)
    ids[:, 0], sims[:, 0], done[:, 0] = entry, _similarity(queries, vectors, entry[:, None])[:, 0], False
    seen[rows, entry] = True
    seen[:, n] = True  # stands for no neighbour
    active = rows
    while len(active):
        open_sims = np.where(done[active], -np.inf, sims[active])
        step = min(_OPEN, width)
        pick = np.argpartition(-open_sims, step - 1, axis=1)[:, :step]
        valid = np.take_along_axis(open_sims, pick, 1) > -np.inf
        live = valid.any(axis=1)
        active, pick, valid = active[live], pick[live], valid[live]
        if not len(active):
            break
        here = active[:, None]
        done[here, pick] = True
        near = graph[np.where(valid, ids[here, pick], 0)]
        near[~valid] = -1
        near = near.reshape(len(active), -1)
        near = np.where(near < 0, n, near)
        new = ~seen[here, near]
        seen[here, near] = True
        # A node that two opened ones share would come twice.
        order = np.sort(np.where(new, near, n), axis=1)
        order[:, 1:][order[:, 1:] == order[:, :-1]] = n
        most = int((order < n).sum(axis=1).max())
        if not most:
            continue
        near = np.sort(order, axis=1)[:, :most]
        found = _similarity(queries[active], vectors, np.minimum(near, n - 1)).astype(np.float32)
        found[near == n] = -np.inf
        all_ids = np.concatenate([ids[active], near], axis=1)
        all_sims = np.concatenate([sims[active], found], axis=1)
        all_done = np.concatenate([done[active], near == n], axis=1)
        keep = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
        ids[active], sims[active] = np.take_along_axis(all_ids, keep, 1), np.take_along_axis(all_sims, keep, 1)
        done[active] = np.take_along_axis(all_done, keep, 1)
    order = np.argsort(-sims, axis=1, kind="stable")
    ids, sims = np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)
    ids[sims == -np.inf] = -1
    return ids, sims


def _diverse(vectors: np.ndarray, ids: np.ndarray, sims: np.ndarray, degree: int) -> np.ndarray:
    """Neighbours among candidates (best first): those nearer to the node than to a neighbour taken before, in up to two
    thirds of the places, then the nearest of the rest."""
    many, width = ids.shape
    own = vectors[np.maximum(ids, 0)]
    between = np.matmul(own, own.transpose(0, 2, 1))
    taken = np.zeros((many, width), bool)
    most = np.full((many, width), -np.inf, np.float32)  # similarity to the nearest taken neighbour
    room = np.full(many, max(1, degree * 2 // 3))
    for j in range(width):
        good = (ids[:, j] >= 0) & (sims[:, j] > most[:, j]) & (room > 0)
        taken[:, j] = good
        room -= good
        most = np.where(good[:, None], np.maximum(most, between[:, j, :]), most)
    rank = np.where(ids < 0, 3 * width, np.where(taken, 0, width)) + np.arange(width)
    best = np.argsort(rank, axis=1)[:, :degree]
    out = np.take_along_axis(ids, best, 1)
    return np.pad(out, ((0, 0), (0, degree - out.shape[1])), constant_values=-1)


class Graph:
    """A layered graph over unit vectors. Nodes stand in order of their level, so a layer is a prefix."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray, copies: np.ndarray):
        chance = (mix64(ids.astype(np.uint64)) >> np.uint64(11)).astype(np.float64) / (1 << 53)
        level = np.floor(-np.log(np.maximum(chance, 1e-15)) / np.log(UPPER_DEGREE)).astype(int)
        order = np.lexsort((ids, -level))
        self.ids, self.rows, self.copies = ids[order], rows[order], copies[order]
        self.unit = _unit(self.rows).astype(np.float32)
        level = level[order]
        self.layers: list[np.ndarray] = []  # from the top
        for at in range(int(level.max()), -1, -1):
            self.layers.append(self._layer(int((level >= at).sum()), DEGREE if at == 0 else UPPER_DEGREE))

    def _layer(self, n: int, degree: int) -> np.ndarray:
        graph = np.full((n, degree), -1, np.int32)
        unit = self.unit[:n]
        done = 1
        while done < n:
            size = min(max(1, done), _QUERIES, n - done)
            new = np.arange(done, done + size)
            entry = self.entries(unit[new])
            entry = np.where(entry < done, entry, 0)
            ids, sims = _beam(graph[:done], unit, unit[new], entry, BUILD_BEAM)
            # Nodes of the same batch that come before.
            inside = unit[new] @ unit[new].T
            inside[np.triu_indices(size)] = -np.inf
            ids = np.concatenate([ids, np.broadcast_to(new, (size, size))], axis=1)
            sims = np.concatenate([sims, inside], axis=1)
            best = np.argsort(-sims, axis=1, kind="stable")[:, :BUILD_BEAM]
            ids, sims = np.take_along_axis(ids, best, 1), np.take_along_axis(sims, best, 1)
            ids[sims == -np.inf] = -1
            graph[new] = _diverse(unit, ids, sims, degree)
            self._back(graph, unit, new, degree)
            done += size
        return graph

    @staticmethod
    def _back(graph: np.ndarray, unit: np.ndarray, new: np.ndarray, degree: int) -> None:
        """Links from the neighbours of new nodes back to them."""
        to, at = graph[new].ravel(), np.repeat(new, graph.shape[1])
        at, to = at[to >= 0], to[to >= 0]
        sims = np.einsum("ij,ij->i", unit[at], unit[to])
        order = np.lexsort((-sims, to))
        at, to = at[order], to[order]
        nodes, first = np.unique(to, return_index=True)
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        near = place < degree
        coming = np.full((len(nodes), degree), -1, np.int64)
        coming[np.searchsorted(nodes, to[near]), place[near]] = at[near]
        ids = np.concatenate([graph[nodes], coming], axis=1)
        # Nodes of one batch may already point at each other.
        by = np.sort(ids, axis=1)
        by[:, 1:][by[:, 1:] == by[:, :-1]] = -1
        sims = np.where(by < 0, -np.inf, _similarity(unit[nodes], unit, np.maximum(by, 0)))
        best = np.argsort(-sims, axis=1, kind="stable")
        ids, sims = np.take_along_axis(by, best, 1), np.take_along_axis(sims, best, 1)
        width = max(1, int((ids >= 0).sum(axis=1).max()))
        graph[nodes] = _diverse(unit, ids[:, :width], sims[:, :width], degree)

    def entries(self, queries: np.ndarray) -> np.ndarray:
        """Where a search of the next lower layer begins: the nearest node found on the layers that exist."""
        entry = np.zeros(len(queries), np.int64)
        for graph in self.layers:
            entry = _beam(graph, self.unit, queries, entry, 2)[0][:, 0]
        return entry

    def both_ways(self) -> tuple[np.ndarray, np.ndarray]:
        """The lowest layer without directions: where each node's neighbours begin, and the neighbours."""
        n = len(self.ids)
        a, place = np.nonzero(self.layers[-1] >= 0)
        b = self.layers[-1][a, place]
        pairs = np.unique(np.concatenate([a * n + b, b * n + a]))
        return np.searchsorted(pairs // n, np.arange(n + 1)), pairs % n

    def search(self, queries: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        entry = np.zeros(len(queries), np.int64)
        for graph in self.layers[:-1]:
            entry = _beam(graph, self.unit, queries, entry, 2)[0][:, 0]
        return _beam(self.layers[-1], self.unit, queries, entry, width)


def linked(graph: Graph, rows: np.ndarray, ids: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links of cosine ``least`` or more between queries (``rows`` with their ``ids``) and other nodes, verified in double
    precision: for each query the rows that it links to, and a forest of the links as two arrays of ids. Pairs are counted
    and joined as they come, never held together."""
    exact, own = _unit(graph.rows), _unit(rows)
    short = own.astype(np.float32)
    slack = np.float32(least - 1e-5)
    every, place = np.unique(np.concatenate([ids, graph.ids]), return_inverse=True)
    forest = LocalForest(len(every))
    links, counts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
    hit = np.zeros(len(ids), bool)
    width, wanted = SEARCH_BEAM, np.arange(len(rows))
    while True:
        width = min(width, len(graph.ids))
        new_links, new_counts = np.zeros(len(ids), np.int64), np.zeros(len(ids), np.int64)
        for at_query, at_node in _pairs(graph, short, wanted, width, slack):
            good = np.einsum("ij,ij->i", own[at_query], exact[at_node]) >= least
            hit[at_query[good]] = True
            good &= ids[at_query] != graph.ids[at_node]
            at_query, at_node = at_query[good], at_node[good]
            np.add.at(new_links, at_query, 1)
            np.add.at(new_counts, at_query, graph.copies[at_node])
            forest.add(place[at_query], place[len(ids) + at_node])
        # A search gives each link once, so the larger of two counts is the nearer one.
        links, counts = np.maximum(links, new_links), np.maximum(counts, new_counts)
        missing = _audit(exact, graph.ids, own, ids, links, least)
        if not len(missing) or width == len(graph.ids):
            break
        # Misses of queries that link cost a wider beam for those only; a query without any, for all.
        some = np.flatnonzero(hit)
        wanted = some if hit[missing].all() else np.arange(len(rows))
        width *= 2
    x, y = forest.links()
    return counts, every[x], every[y]


def _audit(exact: np.ndarray, node_ids: np.ndarray, own: np.ndarray, ids: np.ndarray, links: np.ndarray, least: float) -> np.ndarray:
    """Queries that miss links, of some that are held against all vectors, if too many links are missed.

    Recall is the mean of the queries' shares of found links, so a large group does not stand for the others; queries with
    few links are chosen and judged apart.
    """
    kinds = [np.arange(len(own)), np.flatnonzero(links), np.flatnonzero(links <= FEW), np.flatnonzero((links > 0) & (links <= FEW))]
    audit = np.unique(np.concatenate([x[np.linspace(0, len(x) - 1, min(AUDIT, len(x))).astype(int)] for x in kinds]))
    true = np.zeros(len(audit), np.int64)
    for i in range(0, len(audit), 16):
        q = audit[i : i + 16]
        true[i : i + 16] = ((exact @ own[q].T >= least) & (node_ids[:, None] != ids[q])).sum(axis=0)
    share = np.minimum(1.0, links[audit] / np.maximum(true, 1))
    bad = any(of.any() and share[of].mean() < RECALL for of in ((true > 0) & (true <= FEW), true > FEW))
    return audit[(share < 1) & (true > 0)] if bad else np.zeros(0, np.int64)


def _pairs(graph: Graph, queries: np.ndarray, which: np.ndarray, width: int, least: float):
    """Linked pairs of some queries, each pair once, in pieces: those of the beam, and all that are reached from them through
    linked nodes."""
    n = len(graph.ids)
    first, near = graph.both_ways()
    step = max(8, min(_QUERIES, (1 << 24) // (n + 1)))
    for start in range(0, len(which), step):
        part = which[start : start + step]
        ids, sims = graph.search(queries[part], width)
        q, place = np.nonzero(sims >= least)
        todo = [(q, ids[q, place])]
        seen = np.zeros((len(part), n), bool)
        known, row = np.nonzero(ids >= 0)
        seen[known, ids[known, row]] = True
        while todo:
            q, node = todo.pop()
            for i in range(0, len(q), _FRONT):
                a, b = q[i : i + _FRONT], node[i : i + _FRONT]
                yield part[a], b
                sizes = first[b + 1] - first[b]
                inner = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                a, b = np.repeat(a, sizes), near[np.repeat(first[b], sizes) + inner]
                new = ~seen[a, b]
                pairs = np.unique(a[new] * n + b[new])
                a, b = pairs // n, pairs % n
                seen[a, b] = True
                good = np.einsum("ij,ij->i", queries[part[a]], graph.unit[b]) >= least
                if good.any():
                    todo.append((a[good], b[good]))


def near_vectors(vectors: DataFrame, *, least: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", shard_rows: int = SHARD_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row: how many others link to it by a cosine of ``least`` or more,
    the smallest id that it reaches by links, and whether that is itself.

    Equal vectors are one node of the graphs and count as links of each other. Vectors that are null, empty, zero or hold a
    null or non-finite component, and vectors of another length, link with nothing: 0 links, a component of their own. Of
    rows that share an id (repeated rows) the smallest usable vector stands, and one row is returned; rows with a null id
    are returned with null component and are not kept. An empty table gives no rows.
    """
    own = usable(vectors, vec_id, embedding)
    nodes = materialised(own.groupBy("e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies")).withColumn("d", F.size("e")))
    many = nodes.count()
    shards, blocks = max(LEAST_SHARDS, -(-many // shard_rows)), max(1, -(-many // block_rows))
    dealt = nodes.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))

    def build(table: pa.Table) -> pa.Table:
        graph = Graph(table["id"].to_numpy(), matrix(table["e"]), table["copies"].to_numpy())
        graph.unit = None  # made again from the rows
        return pa.table({"d": table["d"].slice(0, 1), "s": table["s"].slice(0, 1), "graph": pa.array([pickle.dumps(graph)], pa.binary())})

    graphs = dealt.groupBy("d", "s").applyInArrow(build, "d int, s int, graph binary")
    left = graphs.withColumn("q", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = nodes.withColumn("q", F.pmod(F.xxhash64("id", F.lit("query")), F.lit(blocks)).cast("int")).withColumn("s", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def search(base: pa.Table, asked: pa.Table) -> pa.Table:
        a, b, n = [], [], []
        if base.num_rows and asked.num_rows:
            graph: Graph = pickle.loads(base["graph"][0].as_py())
            graph.unit = _unit(graph.rows).astype(np.float32)
            ids = asked["id"].to_numpy()
            counts, x, y = linked(graph, matrix(asked["e"]), ids, least)
            there = np.flatnonzero(counts)
            a, b = np.concatenate([ids[there], x]), np.concatenate([ids[there], y])
            n = np.concatenate([counts[there], np.zeros(len(x), np.int64)])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "n": pa.array(n, pa.int64())})

    keys = ("d", "s", "q")
    found = materialised(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(search, "a long, b long, n long"))
    counts = found.where("a = b").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("others"))
    reached = components(found.where("a <> b").select("a", "b"))
    rated = nodes.select("e", "copies", F.col("id").alias("node")).join(counts, "node", "left").join(reached, "node", "left")
    rated = rated.select("e", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("component", "node").alias("component_id"))
    members = own.join(rated, "e").select("id", "n_links", "component_id")
    rows = vectors.groupBy(F.col(vec_id).cast("long").alias("vec_id")).agg(F.count(F.lit(1)).alias("rows"))
    out = rows.join(members, rows["vec_id"] == members["id"], "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"), F.coalesce(F.coalesce("component_id", "vec_id") == F.col("vec_id"), F.lit(False)).alias("kept"))
