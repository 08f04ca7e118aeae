"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes, and how widely a pair is found.

Both token sequences of a text tile the same bytes, so every stretch between neighbouring token ends of either belongs to
exactly one token of each: stretches are the links, and ends that both share cut groups. The index is inverted: for a pair
of ids it holds a compressed bitmap of the documents that link them, in containers of 65,536 documents, and planes of further
bitmaps with the bits of the number of further links. A task ORs the bitmaps of its slices into containers; popcounts, summed
over the disjoint containers of a pair, are its documents, and weighted by plane its links. The postings then carry their
pair's score back: they are dealt by container, so a container's documents are summed in one array of bounded size.

A pair found in every document costs a bit a document, so common pairs are not hot keys.
"""

from __future__ import annotations

import functools
import hashlib
import json
from base64 import b64encode
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.llm import bpe
from mailloom.llm.common import col, slices, utf8
from mailloom.llm.triebpe import byte_letters
from mailloom.sources.staging import staged

#: Documents of a container and the entries from which a plain bitmap is smaller than a list of 16-bit numbers.
_BITS = 16
_SPARSE, _BITMAP = 1 << 12, 1 << 13
#: Links and documents that a task gathers before it writes their containers.
_LINKS, _DOCS = 4 << 20, 1 << 20
#: Bytes of a slice.
_SLICE = 1 << 20


class ByteLevel:
    """A byte-level BPE file: ids of texts, and the bytes of each id."""

    def __init__(self, data: bytes):
        of = {x: b for b, x in enumerate(byte_letters())}
        vocabulary = json.loads(data)["model"]["vocab"]
        lines = [b64encode(bytes(of[x] for x in token)) + b" %d" % i for token, i in vocabulary.items()]
        self.own = bpe.Vocabulary(b"\n".join(lines))

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.own.encode(data, offsets)


class Pieces:
    """A sentencepiece model: ids of texts, and the bytes of each id."""

    def __init__(self, data: bytes):
        self.own = sentencepiece.SentencePieceProcessor(model_proto=data)
        names = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(x[3:5], 16)]) if self.own.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.lengths = np.array([len(x) for x in self.bytes], np.int64)

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.own.encode(texts, num_threads=1)


@functools.lru_cache(maxsize=2)
def _tokenizers(first: bytes, second: bytes) -> tuple[ByteLevel, Pieces]:
    return ByteLevel(first), Pieces(second)


@functools.cache
def _written(size_a: int, size_b: int) -> list[bytes]:
    """Each id of A before ``,`` and before ``|``, each id of B before ``,`` and before ``;``, in that order."""
    return [b"%d%c" % (i, sign) for size, signs in ((size_a, b",|"), (size_b, b",;")) for sign in signs for i in range(size)]


@dataclass
class _Slice:
    """Tokens, groups and links of some texts."""

    tokens: np.ndarray  # (text, 2)
    groups: np.ndarray  # (text,)
    written: list[bytes]
    link_text: np.ndarray
    link_a: np.ndarray
    link_b: np.ndarray


def align_texts(first: ByteLevel, second: Pieces, texts: list[str]) -> _Slice:
    """Align the texts; those that are empty or whose tokens do not give blank + text back have no tokens."""
    pieces = second.encode(texts)
    whole = [b" " + x.encode() for x in texts]
    same = [bool(x) and b"".join(map(second.bytes.__getitem__, own)) == y for x, own, y in zip(texts, pieces, whole, strict=True)]
    at = np.flatnonzero(same)
    tokens, groups, written = np.zeros((len(texts), 2), np.int64), np.zeros(len(texts), np.int64), [b""] * len(texts)
    empty = np.zeros(0, np.int64)
    if not len(at):
        return _Slice(tokens, groups, written, empty, empty, empty)
    joined = b"".join([whole[i] for i in at])
    ends = np.cumsum([0, *[len(whole[i]) for i in at]])
    a, a_bounds = first.encode(np.frombuffer(joined, np.uint8), ends)
    b = np.fromiter(chain.from_iterable([pieces[i] for i in at]), np.int64)
    a = a.astype(np.int64)
    tokens[at, 0], tokens[at, 1] = np.diff(a_bounds), [len(pieces[i]) for i in at]
    a_ends, b_ends = np.cumsum(first.own.lengths[a]), np.cumsum(second.lengths[b])
    in_a, in_b = np.zeros(len(joined) + 1, bool), np.zeros(len(joined) + 1, bool)
    in_a[a_ends], in_b[b_ends] = True, True
    cuts = np.flatnonzero(in_a | in_b)
    of_a, of_b = np.cumsum(in_a[cuts]) - in_a[cuts], np.cumsum(in_b[cuts]) - in_b[cuts]
    text = np.searchsorted(ends, cuts) - 1
    both = in_a & in_b
    groups[at] = np.bincount(text[both[cuts]], minlength=len(at))
    # Tokens in the order of the written groups: those of A, then those of B.
    group = np.cumsum(both)
    size_a, size_b = len(first.own.lengths), len(second.lengths)
    codes = np.concatenate([a + size_a * both_at(in_b, a_ends), 2 * size_a + b + size_b * both_at(in_a, b_ends)])
    order = np.argsort(np.concatenate([2 * (group[a_ends] - both[a_ends]), 2 * (group[b_ends] - both[b_ends]) + 1]), kind="stable")
    parts = list(map(_written(size_a, size_b).__getitem__, codes[order].tolist()))
    bounds = np.cumsum([0, *tokens[at].sum(axis=1)]).tolist()
    for i, x, y in zip(at.tolist(), bounds, bounds[1:], strict=False):
        written[i] = b"".join(parts[x:y])[:-1]
    return _Slice(tokens, groups, written, at[text], a[of_a], b[of_b])


def both_at(flags: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """1 where the other sequence has an end at the same place."""
    return flags[ends].astype(np.int64)


def _containers(lows: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Sorted 16-bit numbers, cut at ``bounds``, as compressed bitmaps: the numbers, or 8,192 bytes where there are many."""
    counts = np.diff(bounds)
    sizes = np.where(counts < _SPARSE, 2 * counts, _BITMAP)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    if (counts < _SPARSE).all():
        data = lows.astype("<u2").tobytes()
    else:
        data = b"".join([_container(lows[x:y]) for x, y in zip(bounds, bounds[1:], strict=False)])
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(data)])


def _container(lows: np.ndarray) -> bytes:
    if len(lows) < _SPARSE:
        return lows.astype("<u2").tobytes()
    bits = np.zeros(1 << _BITS, np.uint8)
    bits[lows] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def members(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The documents of all containers of a column, and for each its row in the column."""
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    sizes = np.diff(ends)
    if (sizes < _BITMAP).all():
        lows = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]].view("<u2") if len(column) and ends[-1] > ends[0] else np.zeros(0, "<u2")
        return lows.astype(np.int64), np.repeat(np.arange(len(column)), sizes // 2)
    raw = np.frombuffer(data, np.uint8)
    found = [np.flatnonzero(np.unpackbits(raw[x:y], bitorder="little")) if y - x == _BITMAP else raw[x:y].view("<u2") for x, y in zip(ends, ends[1:], strict=False)]
    return np.concatenate(found).astype(np.int64), np.repeat(np.arange(len(column)), [len(x) for x in found])


_SCHEMA = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups", pa.string()),
    ("a", pa.int32()), ("b", pa.int32()), ("chunk", pa.int64()), ("plane", pa.int32()), ("card", pa.int64()), ("docs", pa.binary()),
])
_DDL = "row long, doc_id long, n_a long, n_b long, n_groups long, groups string, a int, b int, chunk long, plane int, card long, docs binary"


def _batch(**columns: pa.Array) -> pa.RecordBatch:
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([columns.get(x.name, pa.nulls(rows, x.type)) for x in _SCHEMA], schema=_SCHEMA)


class _Gathered:
    """Links of a task: each slice's pairs and documents, ORed into containers when they are written."""

    def __init__(self):
        self.rows, self.keys, self.counts, self.size = [], [], [], 0

    def add(self, rows: np.ndarray, found: _Slice) -> None:
        first = len(self.rows)
        self.rows += rows.tolist()
        key, n = np.unique((found.link_a << 16 | found.link_b) << 24 | (found.link_text + first), return_counts=True)
        self.keys.append(key)
        self.counts.append(n)
        self.size += len(key)

    def full(self) -> bool:
        return self.size >= _LINKS or len(self.rows) >= _DOCS

    def containers(self) -> Iterator[pa.RecordBatch]:
        if self.size:
            keys, counts = np.concatenate(self.keys), np.concatenate(self.counts)
            order = np.argsort(keys)
            keys, more = keys[order], counts[order] - 1
            row = np.array(self.rows, np.int64)[keys & (1 << 24) - 1]
            pair = keys >> 24
            for plane in range(-1, int(more.max()).bit_length()):
                at = np.flatnonzero(more >> plane & 1) if plane >= 0 else np.arange(len(pair))
                if not len(at):  # no number of further links has this bit
                    continue
                own, chunk, low = pair[at], row[at] >> _BITS, row[at] & (1 << _BITS) - 1
                firsts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (chunk[1:] != chunk[:-1])]))
                bounds = np.append(firsts, len(own))
                for x in range(0, len(firsts), 1 << 14):
                    here = firsts[x : x + (1 << 14)]
                    cut = bounds[x : x + len(here) + 1]
                    yield _batch(
                        a=pa.array((own[here] >> 16).astype(np.int32)), b=pa.array((own[here] & 0xFFFF).astype(np.int32)), chunk=pa.array(chunk[here]),
                        plane=pa.array(np.full(len(here), plane, np.int32)), card=pa.array(np.diff(cut)), docs=_containers(low[cut[0] : cut[-1]], cut - cut[0]),
                    )
        self.__init__()


@dataclass(frozen=True)
class Alignment:
    """``documents (row, doc_id, n_a, n_b, n_groups, groups)``, one row for each input row, and ``postings (a, b, chunk, plane,
    card, docs)``, the index: plane -1 is the bitmap of the documents that link ``a`` and ``b``, plane k that of those whose
    number of further links has bit k."""

    documents: DataFrame
    postings: DataFrame

    def pairs(self) -> DataFrame:
        """``a, b, documents, links, best``: how many documents link a pair, how many links it has, and whether no other pair
        of ``a`` is in more documents."""
        weight = F.when(F.col("plane") < 0, F.lit(1)).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.greatest(F.col("plane"), F.lit(0))))
        found = self.postings.groupBy("a", "b").agg(F.sum(F.when(F.col("plane") < 0, F.col("card")).otherwise(0)).alias("documents"), F.sum(weight * F.col("card")).alias("links"))
        most = found.groupBy("a").agg(F.max("documents").alias("most"))
        return found.join(most, "a").select("a", "b", "documents", "links", (F.col("documents") == F.col("most")).alias("best"))

    def scores(self) -> DataFrame:
        """``documents`` and ``n_links``, ``n_best`` (links whose pair is a best one) and ``count_sum`` (documents of the pair,
        summed over the links)."""
        told = self.postings.join(self.pairs().select("a", "b", "documents", "best"), ["a", "b"]).select("chunk", "plane", "docs", "documents", "best")
        summed = told.groupBy("chunk").applyInArrow(_returned, "row long, n_links long, n_best long, count_sum long")
        names = ("n_links", "n_best", "count_sum")
        return self.documents.join(summed, "row", "left").select(*self.documents.columns, *[F.coalesce(x, F.lit(0).cast("long")).alias(x) for x in names])


def _returned(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums over the documents of one container number; an array of 65,536 for each sum, however many pairs come."""
    sums = np.zeros((3, 1 << _BITS), np.int64)
    for batch in batches:
        low, at = members(batch.column("docs"))
        plane = np.asarray(batch.column("plane"), np.int64)
        weight = np.where(plane < 0, 1, np.int64(1) << np.maximum(plane, 0))
        best, count = np.asarray(batch.column("best").cast(pa.int64())), np.asarray(batch.column("documents"), np.int64)
        for own, each in zip(sums, (weight, weight * best, weight * count), strict=True):
            np.add.at(own, low, each[at])
    there = np.flatnonzero(sums[0])
    yield pa.RecordBatch.from_arrays([pa.array((key[0].as_py() << _BITS) + there), *[pa.array(x[there]) for x in sums]], ["row", "n_links", "n_best", "count_sum"])


def align(docs: DataFrame, first: str, second: str, *, text: str = "text", doc_id: str = "doc_id", digest: bool = False) -> Alignment:
    """Align the tokens of two tokenizers on the whole texts of ``docs``.

    ``first`` is the path of a byte-level BPE file, which gets a blank before the text, ``second`` that of a sentencepiece
    model, which adds it itself; strings of special tokens are plain text. ``groups`` is ``a1,a2|b1;a3|b2,b3`` with the ids of
    each group, or its lower-case SHA-256 with ``digest`` (empty without tokens). Null and empty texts, and texts that either
    tokenizer does not give back byte by byte, have no tokens. Every row is a document of its own, with a repeated or a null
    id too. An empty table gives no rows; other columns play no part. Texts are encoded whole, one by one; links are gathered
    up to a bound. The index and the documents are written once to the folder of ``spark.checkpoint.dir``.
    """
    data = [open_bytes(path) for path in (first, second)]
    shared = docs.sparkSession.sparkContext.broadcast(tuple(data))
    rows = docs.select(F.monotonically_increasing_id().alias("row"), col(doc_id).cast("long").alias("doc_id"), col(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizers(*shared.value)
        gathered = _Gathered()
        for batch in batches:
            column = batch.column("text")
            _, offsets = utf8(column)
            number = np.asarray(batch.column("row"), np.int64)
            for x, y in slices(offsets, _SLICE):
                found = align_texts(*own, [t or "" for t in column[x:y].to_pylist()])
                groups = [hashlib.sha256(w).hexdigest() if digest and w else w.decode() for w in found.written]
                yield _batch(row=batch.column("row")[x:y], doc_id=batch.column("doc_id")[x:y], n_a=pa.array(found.tokens[:, 0]), n_b=pa.array(found.tokens[:, 1]), n_groups=pa.array(found.groups), groups=pa.array(groups, pa.string()))
                gathered.add(number[x:y], found)
                if gathered.full():
                    yield from gathered.containers()
        yield from gathered.containers()

    table = staged(rows.mapInArrow(run, _DDL), "alignment")
    documents = table.where("row is not null").select("row", "doc_id", "n_a", "n_b", "n_groups", "groups")
    return Alignment(documents, table.where("row is null").select("a", "b", "chunk", "plane", "card", "docs"))


def open_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()
