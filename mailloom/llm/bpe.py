"""Byte-level BPE: encoding of whole texts into token ids, and decoding.

Pre-tokens are found on arrays, without a pattern engine. A code point belongs to one of five classes. Seen as a step of
the splitting automaton, a code point either resets the state to its own class or leaves it (inside a run), so the
composition of steps is "the last reset wins", which is associative; as the state before a code point is then the class of
its neighbour, all boundaries follow from classes shifted by one place, plus the rules for a last blank and for
contractions. The slices feed a cache of merged pre-tokens, and the lengths of the tokens are the offsets for decoding.
"""

from __future__ import annotations

import base64
import functools
import heapq
import sys
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailloom.llm.common import slices, utf8

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4
#: White_Space of Unicode, fixed values.
_WHITE = [0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Letters and numbers of Unicode 16 that Python's tables lack, fixed values.
_NEW_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85),
    (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7),
    (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16D40, 0x16D6C),
    (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_NEW_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
#: Contractions of the public pattern, fixed values.
_CONTRACTIONS = ("s", "t", "re", "ve", "m", "ll", "d")
#: Merged pre-tokens that a worker remembers, and the longest that it does.
_CACHE, _CACHE_BYTES = 200_000, 64


@functools.cache
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    out = np.array([kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(sys.maxunicode + 1)], np.uint8)
    for kind, ranges in ((_LETTER, _NEW_LETTERS), (_NUMBER, _NEW_NUMBERS)):
        for first, last in ranges:
            out[first : last + 1] = kind
    out[_WHITE] = _SPACE
    return out


@functools.cache
def letters() -> np.ndarray:
    """Is a code point a letter?"""
    return _classes() == _LETTER


def boundaries(points: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Where pre-tokens start among the code points of several texts; ``firsts`` are the places where texts begin."""
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    new = np.zeros(n + 1, bool)
    new[firsts[firsts < n]] = True
    new[n] = True
    before = np.zeros(n, np.uint8)
    before[1:] = kind[:-1]
    before[new[:n]] = 0
    after = np.zeros(n, np.uint8)
    after[:-1] = kind[1:]
    after[new[1:]] = 0
    white = kind == _SPACE
    starts = kind != before
    # The last white space before something else stands alone, and a blank there joins what follows.
    starts |= white & (after != 0) & (after != _SPACE)
    joined = np.zeros(n, bool)
    joined[1:] = ~white[1:] & (before[1:] == _SPACE) & (points[:-1] == 32)
    starts &= ~joined
    quotes = np.flatnonzero((points == 39) & starts & (after == _LETTER))
    for text in _CONTRACTIONS:
        at = quotes[quotes + len(text) < n]
        for k, letter in enumerate(text, 1):
            at = at[(points[at + k] == ord(letter)) & ~new[at + k]]
        starts[at + 1] = False
        ends = at + len(text) + 1
        starts[ends[ends < n]] = True
    return np.flatnonzero(starts)


class Vocabulary:
    """Ranks of byte strings, their merge, and a bounded cache of merged pre-tokens."""

    def __init__(self, data: bytes):
        pairs = [line.split() for line in data.splitlines() if line]
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        size = max(self.ranks.values(), default=-1) + 1
        tokens = [b""] * size
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.lengths = np.array([len(x) for x in tokens], np.int64)
        self.places = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.cache: dict[bytes, tuple[int, ...]] = {}

    def token_ids(self, piece: bytes) -> tuple[int, ...]:
        found = self.cache.get(piece)
        if found is None:
            found = self._merged(piece)
            if len(piece) <= _CACHE_BYTES:
                if len(self.cache) >= _CACHE:
                    self.cache.clear()
                self.cache[piece] = found
        return found

    def _merged(self, piece: bytes) -> tuple[int, ...]:
        """Join the neighbouring pair of lowest rank, leftmost first, until none has a rank."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        end = list(range(1, n + 1))  # end of the part that begins here; 0 once it is joined to the left
        begin_before = list(range(-1, n - 1))
        queue = []

        def offer(a: int) -> None:
            b = end[a]
            if b < n:
                rank = ranks.get(piece[a : end[b]])
                if rank is not None:
                    heapq.heappush(queue, (rank, a, b, end[b]))

        for a in range(n - 1):
            offer(a)
        while queue:
            _, a, b, c = heapq.heappop(queue)
            if end[a] != b or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                begin_before[c] = a
            offer(a)
            if begin_before[a] >= 0:
                offer(begin_before[a])
        out, a = [], 0
        while a < n:
            out.append(ranks[piece[a : end[a]]])
            a = end[a]
        return tuple(out)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts that lie in ``data`` one after another, and where each text's ids begin and end."""
        raw = data[offsets[0] : offsets[-1]].tobytes()
        points = np.frombuffer(raw.decode("utf-8").encode("utf-32-le"), np.uint32)
        size = (points >= 0x80).astype(np.int64)
        size += points >= 0x800
        size += points >= 0x10000
        ends = np.cumsum(size + 1)  # byte offset after each code point
        firsts = np.searchsorted(ends, offsets[:-1] - offsets[0], side="right")
        starts = boundaries(points, firsts)
        cuts = (ends[starts] - size[starts] - 1).tolist() + [len(raw)]
        merged = [self.token_ids(raw[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]
        counts = np.zeros(len(merged) + 1, np.int64)
        counts[1:] = np.cumsum(np.fromiter(map(len, merged), np.int64, len(merged)))
        ids = np.fromiter(chain.from_iterable(merged), np.int32, int(counts[-1]))
        return ids, counts[np.searchsorted(starts, np.append(firsts, len(points)))]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes of the texts, where each text begins and ends in them, and each token's length."""
        lengths = self.lengths[ids]
        ends = np.zeros(len(ids) + 1, np.int64)
        ends[1:] = np.cumsum(lengths)
        at = np.arange(int(ends[-1])) + np.repeat(self.places[ids] - ends[:-1], lengths)
        return self.bytes[at], ends[offsets], lengths


@functools.lru_cache(maxsize=2)
def _vocabulary(data: bytes) -> Vocabulary:
    return Vocabulary(data)


def _binary(data: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _shared(vocabulary: str):
    """The bytes of a vocabulary file, read once on the driver and broadcast; a file of a fixed and small size."""
    with open(vocabulary, "rb") as f:
        return SparkSession.active().sparkContext.broadcast(f.read())


def encode(text: Column, vocabulary: str) -> Column:
    """Token ids of the whole text as an array of int, without special tokens.

    ``vocabulary`` is the path of a file of base64 tokens and ranks that has all 256 bytes. A null or empty text has no ids.
    Each row is encoded alone, so repeated rows and null ids need no care.
    """
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _vocabulary(shared.value)
        for texts in batches:
            yield _joined([ids for ids, _ in _encoded(own, texts)], pa.list_(pa.int32()))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """The bytes of the tokens as binary; null ids give no bytes, an unknown id is an error."""
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _vocabulary(shared.value)
        for column in batches:
            if column.null_count:
                column = pa.array([x or [] for x in column.to_pylist()], pa.list_(pa.int32()))
            offsets, values = np.asarray(column.offsets, np.int64), np.asarray(column.values, np.int64)
            data, ends, _ = own.decode(values[offsets[0] : offsets[-1]], offsets - offsets[0])
            yield _binary(data, ends)

    return F.arrow_udf(run, "binary")(ids)


def round_trip(text: Column, vocabulary: str) -> Column:
    """A struct of ``ids`` as ``encode`` gives them and ``decoded`` as ``decode`` makes of them, in one task."""
    shared = _shared(vocabulary)
    kind = pa.struct([("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _vocabulary(shared.value)
        for texts in batches:
            out = []
            for ids, ends in _encoded(own, texts):
                data, to, _ = own.decode(np.asarray(ids.values, np.int64), ends)
                out.append(pa.StructArray.from_arrays([ids, _binary(data, to)], fields=list(kind)))
            yield _joined(out, kind)

    return F.arrow_udf(run, "ids array<int>, decoded binary")(text)


def _encoded(own: Vocabulary, texts: pa.Array) -> Iterator[tuple[pa.ListArray, np.ndarray]]:
    data, offsets = utf8(texts)
    for a, b in slices(offsets):
        ids, ends = own.encode(data, offsets[a : b + 1])
        yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32())), ends


def _joined(pieces: list[pa.Array], kind: pa.DataType) -> pa.Array:
    return pa.concat_arrays(pieces) if pieces else pa.array([], kind)
