"""Near-duplicate documents by SimHash, found with a hierarchical index over fingerprints in Gray order.

Two fingerprints link if they differ in at most three bits. The 64 bits are cut into four blocks, of which linked
fingerprints share at least one; the 48 others are cut into four again. So every link lies within one of 16 tables, among
fingerprints that agree on the first 28 bits of the table's bit order. There they are sorted by Gray rank, which puts
equal leading patterns side by side: the nodes of the index are those patterns, and a pair of nodes is opened only while
the differences that it has gathered on its way down stay within three.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import LocalForest, col, components, fresh, materialised

SEED = 42
#: Shingles hashed at once, and rows or pairs of index nodes held at once.
_PIECE = 50_000
_ROWS = 100_000
_PAIRS = 500_000
#: Leading bits of the nodes, from the root of a table's groups to the leaves.
_LEVELS = (28, 40, 52, 64)


def fingerprint(text: bytes, words: int = 3) -> int:
    """Signed 64-bit SimHash of the whole text; see ``fingerprints``."""
    parts = text.lower().split()
    if not parts:
        return 0
    if len(parts) < words:
        shingles, total = [b" ".join(parts)], 1
    else:
        total = len(parts) - words + 1
        shingles = map(b" ".join, zip(*[parts[k:] for k in range(words)], strict=False))
    hashes = map(xxhash.xxh64_intdigest, shingles, repeat(SEED))
    counts = np.zeros(64, np.int64)
    for first in range(0, total, _PIECE):
        n = min(_PIECE, total - first)
        rows = -(-n // 255) * 255
        h = np.zeros(rows, np.uint64)
        h[:n] = np.fromiter(hashes, np.uint64, n)
        bits = np.unpackbits(h.view(np.uint8).reshape(rows, 8), axis=1, bitorder="little")
        counts += bits.reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > total, bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, words: int = 3) -> Column:
    """SimHash of a text column as a long: A-Z lowered, words are runs without ASCII white space, shingles of ``words`` words
    with repeats (a shorter text: all its words), each hashed by XXH64 with seed 42; a bit is set if over half the hashes
    have it. A null text, or one without words, has fingerprint 0.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([fingerprint(x.as_buffer().to_pybytes(), words) if x.is_valid else 0 for x in texts], pa.int64())

    return F.arrow_udf(run, "long")(text)


def _tables(fp: Column) -> Column:
    """The fingerprint in the bit order of each table, as ``table`` and its Gray ``rank``."""
    low = F.lit((1 << 48) - 1)
    out = []
    for first in range(4):
        turned = F.shiftleft(fp, 16 * first).bitwiseOR(F.shiftrightunsigned(fp, 64 - 16 * first)) if first else fp
        rest, top = turned.bitwiseAND(low), turned.bitwiseAND(F.lit(-(1 << 48)))
        for second in range(4):
            again = rest if not second else F.shiftleft(rest, 12 * second).bitwiseOR(F.shiftrightunsigned(rest, 48 - 12 * second)).bitwiseAND(low)
            out.append(F.struct(F.lit(4 * first + second).alias("table"), top.bitwiseOR(again).alias("bits")))
    return F.explode(F.array(*out))


def _gray_rank(bits: Column) -> Column:
    for step in (1, 2, 4, 8, 16, 32):
        bits = bits.bitwiseXOR(F.shiftrightunsigned(bits, step))
    return bits


def _search(bits: np.ndarray, group: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among fingerprints in Gray order, within equal ``group``: a forest of positions, not all pairs.

    ``bits`` are in the table's order. A node is a run of equal leading bits; node pairs are opened depth first, in pieces
    of bounded size.
    """
    n = len(bits)
    forest = LocalForest(n)
    starts = []
    for level in _LEVELS:
        lead = bits >> np.uint64(64 - level)
        new = np.ones(n, bool)
        new[1:] = (lead[1:] != lead[:-1]) | (group[1:] != group[:-1])
        starts.append(np.flatnonzero(new))
    # children of node i on level k: first[k][i] .. first[k][i + 1]
    first = [np.append(np.searchsorted(starts[k + 1], starts[k]), len(starts[k + 1])) for k in range(len(_LEVELS) - 1)]
    roots = np.flatnonzero(np.diff(np.append(starts[0], n)) > 1)  # a lone fingerprint has no pair
    stack = [(0, roots, roots)]
    while stack:
        level, u, v = stack.pop()
        if not len(u):
            continue
        if level == len(_LEVELS) - 1:
            forest.add(starts[level][u], starts[level][v])
            continue
        size_u, size_v = first[level][u + 1] - first[level][u], first[level][v + 1] - first[level][v]
        pairs = size_u * size_v
        if len(u) > 1 and pairs.sum() > _PAIRS:
            half = len(u) // 2
            stack += [(level, u[:half], v[:half]), (level, u[half:], v[half:])]
            continue
        if len(u) == 1 and pairs[0] > _PAIRS:
            blocks = _blocks(first[level], int(u[0]), int(v[0]))
        else:
            at = np.repeat(np.arange(len(u)), pairs)
            inner = np.arange(len(at)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
            blocks = [(first[level][u[at]] + inner // size_v[at], first[level][v[at]] + inner % size_v[at])]
        for a, b in blocks:
            lead = starts[level + 1]
            near = a <= b
            a, b = a[near], b[near]
            differ = np.bitwise_count((bits[lead[a]] ^ bits[lead[b]]) >> np.uint64(64 - _LEVELS[level + 1])) <= most
            keep = differ if level + 1 < len(_LEVELS) - 1 else differ & (a < b)
            if keep.any():
                stack.append((level + 1, a[keep], b[keep]))
    return forest.links()


def _blocks(first: np.ndarray, u: int, v: int):
    """The pairs of children of one large pair of nodes, some rows at a time."""
    b = np.arange(first[v], first[v + 1])
    step = max(1, _PAIRS // len(b))
    for at in range(first[u], first[u + 1], step):
        a = np.arange(at, min(at + step, first[u + 1]))
        yield np.repeat(a, len(b)), np.tile(b, len(a))


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """``(a, b)``: links between different fingerprints (column ``fp``, distinct), enough to join every linked group.

    Each table gives a forest of its groups' links, not all pairs. Memory is bounded by the distinct fingerprints that
    agree on 28 given bits.
    """
    if most > 3:
        raise ValueError("the tables hold every pair of up to 3 differing bits")
    rows = fps.select(_tables(F.col("fp")).alias("t")).select(F.col("t.table").alias("table"), _gray_rank(F.col("t.bits")).alias("rank"))
    rows = rows.withColumn("lead", F.shiftrightunsigned("rank", 36))
    rows = rows.repartition("table", "lead").sortWithinPartitions("table", "lead", "rank")

    def run(batches):
        held: list[np.ndarray] = []

        def search(part: np.ndarray):
            bits = part[1].view(np.uint64) ^ (part[1].view(np.uint64) >> np.uint64(1))
            a, b = _search(bits, part[0], most)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(_plain(bits[x], part[0][x]).view(np.int64), pa.int64()) for x in (a, b)], ["a", "b"])

        rows_held = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), batch.column(1).to_numpy(zero_copy_only=False)]))
            rows_held += batch.num_rows
            if rows_held >= _ROWS:
                part = np.concatenate(held, axis=1)
                lead = part[1].view(np.uint64) >> np.uint64(36)
                inner = np.flatnonzero((part[0] != part[0, -1]) | (lead != lead[-1]))
                cut = int(inner[-1]) + 1 if len(inner) else 0
                if cut:
                    yield from search(part[:, :cut])
                held, rows_held = [part[:, cut:].copy()], part.shape[1] - cut
        if held:
            yield from search(np.concatenate(held, axis=1))

    return rows.select("table", "rank").mapInArrow(run, "a long, b long")


def _plain(bits: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Fingerprints in their own bit order again."""
    table = table.astype(np.uint64)
    first, second = np.uint64(16) * (table // np.uint64(4)), np.uint64(12) * (table % np.uint64(4))
    low = np.uint64((1 << 48) - 1)
    rest = bits & low
    back = np.where(second > 0, ((rest >> second) | (rest << ((np.uint64(48) - second) % np.uint64(48)))) & low, rest)
    turned = (bits & ~low) | back
    return np.where(first > 0, (turned >> first) | (turned << ((np.uint64(64) - first) % np.uint64(64))), turned)


def near_duplicates(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 3, most: int = 3) -> DataFrame:
    """``(doc_id, fp, component_id, group)``, a row for each row of ``docs``: the smallest id that it reaches by links, and its
    group's smallest fingerprint, which names the group where all ids are null.

    Texts are taken whole. Null or wordless texts have fingerprint 0 and link like any other; repeated rows and equal texts
    share a fingerprint and so a component. A null id is never the smallest; a component of null ids only has a null
    ``component_id``. An empty table gives no rows; other columns play no part.
    """
    own = materialised(docs.select(col(doc_id).alias("doc_id"), fingerprints(col(text), words).alias("fp")))
    firsts = own.groupBy("fp").agg(F.min("doc_id").alias("first"))
    reached = components(links(firsts.select("fp"), most)).select(F.col("node").alias("fp"), "component")
    grouped = materialised(firsts.join(reached, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("label")))
    smallest = grouped.groupBy("label").agg(F.min("first").alias("component_id"))
    ids = grouped.join(smallest, "label").select("fp", "component_id", F.col("label").alias("group"))
    return own.join(ids, "fp").select("doc_id", "fp", "component_id", "group")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", words: int = 3, most: int = 3) -> DataFrame:
    """``docs`` with one row of each near-duplicate group: the one with the smallest id, a null id last.

    If that id stands in several rows, one with the smallest fingerprint stays; rows equal in both are repeats, and one of
    them stays. An empty table stays empty. All columns are kept as they are, whatever their names.
    """
    found = near_duplicates(docs, text=text, doc_id=doc_id, words=words, most=most)
    mark, key = fresh(docs, "fingerprint_"), fresh(docs, "kept_id_")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "fp")).alias("first")
    kept = found.groupBy("group").agg(first).select(F.col("first.doc_id").alias(key), F.col("first.fp").alias(mark))
    rows = docs.withColumn(mark, fingerprints(col(text), words))
    joined = rows.join(kept, (rows[mark] == kept[mark]) & col(doc_id).eqNullSafe(kept[key]), "left_semi")
    return joined.dropDuplicates([doc_id, mark]).drop(mark)
