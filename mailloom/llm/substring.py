"""Removal of passages that repeat across documents: seed on winnowed anchors, extend, keep maximal repeats.

An anchor is the five-word hash that a window of 13 words selects as its smallest, so equal windows have equal anchors.
Anchors that two documents share are the seeds. Each is extended to both sides, to every 13-word window that selects it, and
the windows meet by their hash; runs of windows that also start in an earlier document are the maximal repeats, cut out.

Texts are dealt into blocks of bounded size by a hash of the row, once; the same exchange serves all three passes over them.
Between the passes only packed hashes move, one per block however often it holds them, so a passage in a third of all
documents is as many values as there are blocks, and no key is hot.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.llm.common import col, fresh, mix64, slices, utf8

ANCHOR = 5
#: Text bytes of a block, on average, and of the piece of it whose words are in arrays at once (a longer text is its own piece).
BLOCK_BYTES = 4 << 20
PIECE_BYTES = 256 << 10
#: Windows looked up at once.
_AT_ONCE = 1 << 16
_LAST = (1 << 63) - 1
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_LETTER = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class _Powers:
    """Powers of the hash base and of its inverse, as far as they are needed."""

    up = np.ones(1, np.uint64)
    down = np.ones(1, np.uint64)

    @classmethod
    def reach(cls, n: int) -> None:
        if len(cls.up) < n:
            for name, base in (("up", _BASE), ("down", _INVERSE)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(cls, name, np.cumprod(steps, dtype=np.uint64))


def _slice_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    letter = ~_SPACE[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    begins, ends = letter.copy(), letter.copy()
    begins[1:] &= ~letter[:-1] | edge[1:n]
    ends[:-1] &= ~letter[1:] | edge[1:n]
    begins, ends = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    _Powers.reach(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTER[data] * _Powers.up[:n], out=sums[1:])
    hashes = mix64((sums[ends] - sums[begins]) * _Powers.down[begins])
    return hashes, np.diff(np.searchsorted(begins, offsets))


def _grams(hashes: np.ndarray, size: int) -> np.ndarray:
    many = max(0, len(hashes) - size + 1)
    out = np.zeros(many, np.uint64)
    for j in range(size):
        out = out * _STEP + hashes[j : j + many]
    return mix64(out)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    span = 1
    while span * 2 <= width:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    rest = width - span
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


class _Words:
    """The words and windows of one piece of a block: ``first`` and ``last`` of its rows, words by row, hashes of all words."""

    def __init__(self, first: int, lengths: np.ndarray, hashes: np.ndarray | None = None):
        self.first, self.last, self.lengths, self.hashes = first, first + len(lengths), lengths, hashes

    def windows_at(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """The row of each word, and the first words of the windows that lie in one row."""
        rows = np.repeat(np.arange(self.first, self.last, dtype=np.int32), self.lengths)
        many = max(0, len(rows) - window + 1)
        return rows, np.flatnonzero(rows[:many] == rows[len(rows) - many :])


def _pieces(table: pa.Table, text: str):
    """The words of a block's texts, a bounded piece of whole rows at a time."""
    data, offsets = utf8(table[text])
    for a, b in slices(offsets, PIECE_BYTES):
        hashes, lengths = _slice_words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        yield _Words(a, lengths, hashes)


def _anchors(piece: _Words, at: np.ndarray, window: int) -> np.ndarray:
    """The anchor of each window."""
    if not len(at):
        return np.zeros(0, np.uint64)
    anchor = min(ANCHOR, window)
    # Minima crowd at the low end of the hash space; mixed again they spread evenly over its ranges.
    return mix64(_sliding_min(_grams(piece.hashes, anchor), window - anchor + 1)[at])


def _least(keys: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the smallest id of each, and the place of each input among them."""
    if not len(keys):
        return keys, ids, np.zeros(0, np.int64)
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = sorted_[1:] != sorted_[:-1]
    place = np.empty(len(keys), np.int64)
    place[order] = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    return sorted_[starts], np.minimum.reduceat(ids[order], starts), place


def _within(x: np.ndarray, sorted_: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _numbers(column: pa.ChunkedArray, kind) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), kind) for x in column]


def _seeds(table: pa.Table, text: str, window: int) -> np.ndarray:
    """The distinct anchors of a block, in order."""
    found = [np.unique(_anchors(x, x.windows_at(window)[1], window)) for x in _pieces(table, text)]
    return np.unique(np.concatenate(found)) if found else np.zeros(0, np.uint64)


def _extended(table: pa.Table, text: str, order: str, window: int, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct windows of a block whose anchors are ``shared`` (sorted), in order, and the smallest id of each."""
    order_ids = table[order].to_numpy()
    keys, ids = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for x in _pieces(table, text):
        rows, at = x.windows_at(window)
        at = at[_within(_anchors(x, at, window), shared)]
        keys.append(_grams(x.hashes, window)[at])
        ids.append(order_ids[rows[at]])
    keys, ids = np.concatenate(keys), np.concatenate(ids)
    distinct = np.unique(keys)
    least = np.full(len(distinct), _LAST, np.int64)
    for a in range(0, len(keys), _AT_ONCE):
        np.minimum.at(least, np.searchsorted(distinct, keys[a : a + _AT_ONCE]), ids[a : a + _AT_ONCE])
    return distinct, least


def _gone(table: pa.Table, text: str, order: str, window: int, told: np.ndarray, told_ids: np.ndarray):
    """Per piece of a block its words (without hashes) and a mark for each of them: does it lie in a window that starts earlier?

    Earlier are the ids told of other blocks and those of this one; only windows that came twice or were told take part.
    """
    order_ids = table[order].to_numpy()
    pieces, windows = [], []
    for x in _pieces(table, text):
        windows.append(_grams(x.hashes, window)[x.windows_at(window)[1]])
        pieces.append(_Words(x.first, x.lengths))
    every = np.concatenate(windows) if windows else np.zeros(0, np.uint64)
    every.sort()
    asked = np.union1d(every[1:][every[1:] == every[:-1]], told)
    del every
    least = np.full(len(asked), _LAST, np.int64)
    np.minimum.at(least, np.searchsorted(asked, told), told_ids)
    found = []
    for x, own in zip(pieces, windows, strict=True):
        rows, at = x.windows_at(window)
        there = _within(own, asked)
        place = np.searchsorted(asked, own[there]).astype(np.int32)
        np.minimum.at(least, place, order_ids[rows[at[there]]])
        found.append((there, place))
    del windows
    for x, (there, place) in zip(pieces, found, strict=True):
        rows, at = x.windows_at(window)
        at = at[there]
        late = at[least[place] < order_ids[rows[at]]]
        steps = np.zeros(len(rows) + 1, np.int32)
        steps[late] += 1
        steps[late + window] -= 1
        yield x, np.cumsum(steps[:-1]) > 0


def _packed(rows: list[tuple], names: list[tuple[str, pa.DataType]]) -> pa.Table:
    return pa.table({name: pa.array([r[k] for r in rows], kind) for k, (name, kind) in enumerate(names)})


_ASKED = [("part", pa.int32()), ("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())]
_TOLD = [("block", pa.int32()), ("keys", pa.binary()), ("ids", pa.binary())]


def _to_parts(keys: np.ndarray, ids: np.ndarray, block: int, parts: int) -> pa.Table:
    """Sorted keys cut into ranges of the hash space, a row for each that has any; a key's range follows from its upper bits."""
    at = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    firsts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]])) if len(keys) else np.zeros(0, np.int64)
    ends = np.append(firsts[1:], len(keys))
    rows = [(int(at[x]), block, keys[x:y].tobytes(), ids[x:y].tobytes()) for x, y in zip(firsts.tolist(), ends.tolist(), strict=True)]
    return _packed(rows, _ASKED)


def _to_blocks(blocks: np.ndarray, keys: np.ndarray, ids: np.ndarray) -> pa.Table:
    order = np.argsort(blocks, kind="stable")
    blocks, keys, ids = blocks[order], keys[order], ids[order]
    bounds = [*np.flatnonzero(np.diff(blocks, prepend=-1)).tolist(), len(blocks)] if len(blocks) else [0]
    return _packed([(int(blocks[a]), keys[a:b].tobytes(), ids[a:b].tobytes()) for a, b in zip(bounds, bounds[1:], strict=False)], _TOLD)


def remove_repeats(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = 13, whitespace: str = "original") -> DataFrame:
    """``docs`` with every word removed that lies in a window of ``window`` words which also starts in a document of smaller id.

    Words are runs without ASCII white space, unchanged. Windows are those of the input, not of what is left. Adds
    ``n_words`` and ``n_removed`` (long) and ``removed``, the maximal runs of removed words as ``start`` and ``end`` (words
    from 0, end excluded); existing columns of these names are replaced. ``whitespace="original"`` leaves a text without
    removals as it is, and else joins the remaining pieces by a line feed; ``"single"`` joins all kept words by one space.

    A null text stays null (``"single"``: empty) and has no words. Texts shorter than the window lose nothing. Rows with
    equal id (repeated rows) do not count as earlier than each other; a null id counts as later than all others. An empty
    table gives no rows. Windows meet by 64-bit hashes within equal 64-bit anchors.
    """
    if whitespace not in ("original", "single"):
        raise ValueError(whitespace)
    added = [T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("removed", T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])))]
    docs = docs.drop(*[x.name for x in added])
    names = docs.columns
    block, order = fresh(docs, "block_"), fresh(docs, "order_")
    total = docs.agg(F.sum(F.octet_length(col(text)))).first()[0] or 0
    parts = total // BLOCK_BYTES + 1
    dealt = docs.withColumn(block, F.pmod(F.xxhash64(col(doc_id), col(text)), F.lit(parts)).cast("int")).withColumn(order, F.coalesce(col(doc_id).cast("long"), F.lit(_LAST)))
    blocks = dealt.groupBy(col(block))

    def seeds(table: pa.Table) -> pa.Table:
        found = _seeds(table, text, window)
        return _to_parts(found, np.zeros(0, np.int64), table[block][0].as_py(), parts)

    def shared(table: pa.Table) -> pa.Table:
        own = _numbers(table["keys"], np.uint64)
        keys, at = np.concatenate(own), np.repeat(table["block"].to_numpy(), [len(x) for x in own])
        by = np.argsort(keys, kind="stable")
        keys, at = keys[by], at[by]
        same = keys[1:] == keys[:-1]
        twice = np.zeros(len(keys), bool)
        twice[1:] |= same
        twice[:-1] |= same
        return _to_blocks(at[twice], keys[twice], np.zeros(int(twice.sum()), np.int64))

    def extend(table: pa.Table, told: pa.Table) -> pa.Table:
        if not table.num_rows or not told.num_rows:
            return _packed([], _ASKED)
        keys, ids = _extended(table, text, order, window, np.sort(np.concatenate(_numbers(told["keys"], np.uint64))))
        return _to_parts(keys, ids, table[block][0].as_py(), parts)

    def earliest(table: pa.Table) -> pa.Table:
        own = _numbers(table["keys"], np.uint64)
        at = np.repeat(table["block"].to_numpy(), [len(x) for x in own])
        keys, ids = np.concatenate(own), np.concatenate(_numbers(table["ids"], np.int64))
        _, least, place = _least(keys, ids)
        late = least[place] < ids
        return _to_blocks(at[late], keys[late], least[place[late]])

    def cut(table: pa.Table, told: pa.Table) -> pa.Table:
        keys, ids = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if told.num_rows:
            keys, ids = np.concatenate(_numbers(told["keys"], np.uint64)), np.concatenate(_numbers(told["ids"], np.int64))
        done = []
        for x, gone in _gone(table, text, order, window, keys, ids):
            own, n_removed, runs = _without(table[text].slice(x.first, len(x.lengths)), x.lengths, gone, whitespace)
            done.append(pa.table({"text": own, "n_words": pa.array(x.lengths, pa.int64()), "n_removed": n_removed, "removed": runs}))
        done = pa.concat_tables(done)
        out = table.select(names).set_column(names.index(text), text, done["text"])
        for name in ("n_words", "n_removed", "removed"):
            out = out.append_column(name, done[name])
        return out

    asked, told = "part int, block int, keys binary, ids binary", "block int, keys binary, ids binary"
    seeded = blocks.applyInArrow(seeds, asked).groupBy("part").applyInArrow(shared, told)
    extended = blocks.cogroup(seeded.groupBy("block")).applyInArrow(extend, asked)
    answers = extended.groupBy("part").applyInArrow(earliest, told)
    return blocks.cogroup(answers.groupBy("block")).applyInArrow(cut, T.StructType([*docs.schema.fields, *added]))


_RUNS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _without(texts: pa.ChunkedArray, lengths: np.ndarray, gone: np.ndarray, whitespace: str) -> tuple[pa.ChunkedArray, pa.Array, pa.Array]:
    """A piece's texts without the words that are gone, how many these are by row, and their runs."""
    first = np.append(0, np.cumsum(lengths))
    removed = np.diff(np.append(0, np.cumsum(gone))[first])
    if whitespace == "original" and not removed.any():
        return texts.cast(pa.string()), pa.array(removed, pa.int64()), pa.array([[]] * len(lengths), _RUNS)
    out, runs = [], []
    for row, value in enumerate(texts):
        value = value.as_py()
        if not removed[row]:
            out.append(value if whitespace == "original" else " ".join(x.decode() for x in (value or "").encode().split()))
            runs.append([])
            continue
        lost = gone[first[row] : first[row + 1]]
        edges = np.flatnonzero(np.diff(lost, prepend=False, append=False))
        runs.append([{"start": a, "end": b} for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True)])
        out.append(_kept(value.encode(), lost, runs[-1], whitespace))
    return pa.chunked_array([pa.array(out, pa.string())]), pa.array(removed, pa.int64()), pa.array(runs, _RUNS)


def _kept(value: bytes, lost: np.ndarray, runs: list[dict], whitespace: str) -> str:
    if whitespace == "single":
        return b" ".join(compress(value.split(), (~lost).tolist())).decode()
    data = np.frombuffer(value, np.uint8)
    letter = ~_SPACE[data]
    edges = np.flatnonzero(np.diff(letter, prepend=False, append=False))
    begins, ends = edges[::2], edges[1::2]
    pieces, at = [], 0
    for run in [*runs, {"start": len(lost), "end": len(lost)}]:
        if run["start"] > at:
            pieces.append(value[begins[at] : ends[run["start"] - 1]])
        at = run["end"]
    return b"\n".join(pieces).decode()
