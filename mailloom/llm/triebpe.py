"""BPE with word ends: whole texts to token ids and back, words encoded in a prefix-sharing trie.

The distinct words of a piece of text that are not known yet are inserted into a trie of symbols: a word's bytes, the last one
marked as its end. Merging has one last token for every prefix of a word, and it depends on that prefix alone, so a trie node
has it as its state. It is the token that ends at the node and stands next to the last token of the node where it begins, in
a pair that merging leaves apart. States are passed on depth first; words with a common prefix share its states, and a word's
ids are read from its leaf backwards.

Two tokens stand next to each other if no merge bridges them: following the pieces of the left token that touch the border
and those of the right one, from both tokens down to single symbols, no merge of two such pieces comes before the merges that
use them up. As merges apply in the order of their rank and, within a rank, from the left, a merge across the border goes
ahead at a rank below that which uses up the left piece, and not above that which uses up the right one.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import bpe
from mailloom.llm.common import SLICE_BYTES, slices, utf8

#: Words that a worker remembers, and the longest that it does; a longer one than the second has a path instead of a trie.
_CACHE, _CACHE_BYTES, _TRIE_BYTES = 150_000, 64, 512
_PAIRS = 400_000
_NEVER = 1 << 40
_ONE, _BYTES = (1,), [bytes([b]) for b in range(256)]
#: Capital letters of newer Unicode than Python's tables, and how far their small letters are, fixed values.
_NEW_CASES: tuple[tuple[int, int, int], ...] = (
    (0x1C89, 0x1C89, 1), (0xA7CB, 0xA7CB, -42343), (0xA7CC, 0xA7CC, 1), (0xA7CE, 0xA7CE, 1), (0xA7D2, 0xA7D2, 1), (0xA7D4, 0xA7D4, 1),
    (0xA7DA, 0xA7DA, 1), (0xA7DC, 0xA7DC, -42561), (0x10D50, 0x10D65, 32), (0x16EA0, 0x16EB8, 27),
)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it is printable, else the next free one."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    out = [chr(b) if b in printable else "" for b in range(256)]
    free = iter(range(0x100, 0x200))
    return [x or chr(next(free)) for x in out]


@functools.cache
def _pieces(most: int) -> re.Pattern:
    """Contractions, runs of letters, single numbers, and runs of anything else but white space, for texts of code points up to
    ``most``: the fewer ranges a class has, the faster it is."""
    kinds = bpe._classes()[: most + 1]

    def chars(kind: int) -> str:
        there = np.flatnonzero(np.diff(np.concatenate([[0], (kinds == kind).astype(np.int8), [0]])))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in there.reshape(-1, 2).tolist())

    letter, number, space = chars(bpe._LETTER), chars(bpe._NUMBER), chars(bpe._SPACE)
    contractions = "|".join("'" + x for x in bpe._CONTRACTIONS)
    return re.compile(f"[{letter}]+|{contractions}|[{number}]|[^{space}{letter}{number}]+")


_BEYOND = re.compile("[\u0250-\U0010ffff]"), re.compile("[\U00010000-\U0010ffff]")


def words(text: str) -> list[str]:
    """The words of a text that has no special tokens."""
    text = normalised(text)
    if text.isascii():
        most = 0x7F
    else:
        most = 0x10FFFF if _BEYOND[1].search(text) else 0xFFFF if _BEYOND[0].search(text) else 0x24F
    return _pieces(most).findall(text)


@functools.cache
def _lower_table() -> dict[int, int]:
    """What ``str.lower`` does not do letter by letter as Unicode's simple mapping does: the final sigma, newer letters."""
    return {0x3A3: 0x3C3} | {c: c + by for first, last, by in _NEW_CASES for c in range(first, last + 1)}


def normalised(text: str) -> str:
    """NFC, each letter in lower case. White space is left as it is; it only separates."""
    if text.isascii():
        return text.lower()
    text = unicodedata.normalize("NFC", text)
    return (text.translate(_lower_table()) if _OWN_CASE.search(text) else text).lower()


def _lengths(table: dict[bytes, int]) -> dict[bytes, tuple[int, ...]]:
    """For the last bytes of a prefix, three or fewer, the lengths of the tokens that can end there, longest first."""
    found: dict[bytes, set[int]] = {}
    for token in table:
        found.setdefault(token[-3:], set()).add(len(token))
    return {tail: tuple(sorted({k for k in range(1, len(tail)) if tail[-k:] in table} | own, reverse=True)) for tail, own in found.items()}


_OWN_CASE = re.compile("[" + "".join(map(chr, _lower_table())) + "]")


class Words:
    """A vocabulary of byte-level BPE with word ends: merges, states of trie nodes, and the words met so far."""

    def __init__(self, data: bytes):
        whole = json.loads(data)
        model = whole["model"]
        vocabulary, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        of = {x: b for b, x in enumerate(letters)}
        self.specials = {x["content"]: x["id"] for x in whole["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))) if self.specials else None
        self.strings = {i: x for x, i in vocabulary.items()} | {i: x for x, i in self.specials.items()}
        # Tokens inside a word and at its end, by their bytes.
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        self.size: dict[int, int] = {}
        for token, i in vocabulary.items():
            ends = token.endswith(suffix) and len(token) > len(suffix)
            own = bytes(of[x] for x in (token.removesuffix(suffix) if ends else token))
            (final if ends else inner)[own] = i
            self.size[i] = len(own)
        self.tables = [(x, _lengths(x)) for x in (inner, final)]
        self.edges: dict[int, list[tuple[int, int]]] = {}
        self.joins: dict[int, dict[int, int]] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right, joined = vocabulary[a], vocabulary[b], vocabulary[a + b]
            self.joins.setdefault(left, {}).setdefault(right, rank)
            self.halves.setdefault(joined, (left, right, rank))
        self.apart: dict[int, bool] = {}
        self.known: dict[str, tuple[bytes, bytes]] = {}
        self.older: dict[str, tuple[bytes, bytes]] = {}

    def _firsts(self, token: int) -> list[tuple[int, int]]:
        """The pieces of a token that begin where it does, each with the rank of the merge that uses it up."""
        out, until = [], _NEVER
        while True:
            out.append((token, until))
            if token not in self.halves:
                return out
            token, _, until = self.halves[token]

    def _stand_apart(self, left: int, right: int) -> bool:
        firsts = self.edges.get(right)
        if firsts is None:
            firsts = self.edges[right] = self._firsts(right)
        until, x = _NEVER, left
        while True:
            joins = self.joins.get(x)
            if joins is not None:
                for y, y_until in firsts:
                    bridge = joins.get(y)
                    if bridge is not None and bridge < until and bridge <= y_until:
                        return False
            if x not in self.halves:
                return True
            _, x, until = self.halves[x]

    def _last_token(self, path: bytes, depth: int, ends: bool, last) -> int:
        """The last token of the first ``depth`` bytes of ``path``, from the last tokens of all shorter prefixes."""
        table, lengths = self.tables[ends]
        apart = self.apart
        for n in lengths.get(path[max(0, depth - 3) : depth]) or lengths.get(path[max(0, depth - 2) : depth], _ONE):
            if n > depth:
                continue
            token = table.get(path[depth - n : depth])
            if token is None:
                continue
            if n == depth:
                return token
            before = last[depth - n - 1]
            key = before << 32 | token
            found = apart.get(key)
            if found is None:
                if len(apart) >= _PAIRS:
                    apart.clear()
                found = apart[key] = self._stand_apart(before, token)
            if found:
                return token
        raise ValueError("the vocabulary lacks a byte")

    def _backwards(self, last, depth: int) -> list[int]:
        out = []
        while depth:
            token = last[depth - 1]
            out.append(token)
            depth -= self.size[token]
        return out[::-1]

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Token ids of distinct, non-empty words.

        Words enter the trie in sorted order: a word leaves the path of the one before it at their first different symbol, and
        what follows are new nodes. So nodes are numbered depth first, and going through them by number is the traversal.
        """
        out: list[list[int]] = [[]] * len(words)
        symbols, depths, leaf_of = [], [], {}
        before = b""
        for k in sorted(range(len(words)), key=words.__getitem__):
            word = words[k]
            if len(word) > _TRIE_BYTES:
                out[k] = self._path(word)
                continue
            branch = 0
            for x, y in zip(before[:-1], word[:-1]):
                if x != y:
                    break
                branch += 1
            symbols += word[branch:]
            depths += range(branch + 1, len(word) + 1)
            leaf_of[len(symbols) - 1] = k
            before = word
        path, last = [b""] * (_TRIE_BYTES + 1), [0] * _TRIE_BYTES
        for node, (symbol, depth) in enumerate(zip(symbols, depths, strict=True)):
            own = path[depth] = path[depth - 1] + _BYTES[symbol]
            leaf = leaf_of.get(node)
            last[depth - 1] = self._last_token(own, depth, leaf is not None, last)
            if leaf is not None:
                out[leaf] = self._backwards(last, depth)
        return out

    def _path(self, word: bytes) -> list[int]:
        """A very long word: the same states along its one path."""
        last = array("i")
        for depth in range(1, len(word) + 1):
            last.append(self._last_token(word, depth, depth == len(word), last))
        return self._backwards(last, len(word))

    def _learn(self, words: set[str]) -> None:
        """Take words over from the older half of the cache, and encode the others."""
        new = []
        for word in words:
            found = self.older.get(word)
            if found is None and word in self.specials:
                # A special token never is a word: words are in lower case and have letters apart from signs.
                found = np.array([self.specials[word]], "<u4").tobytes(), word.encode()
            if found is None:
                new.append(word)
            else:
                self.known[word] = found
        strings = self.strings
        for word, ids in zip(new, self.encode_words([x.encode() for x in new]), strict=True):
            self.known[word] = array("I", ids).tobytes(), " ".join([strings[i] for i in ids]).encode()

    def _cut(self, text: str) -> list[str]:
        """Words and special tokens of a text in order."""
        if self.special is None or not self.special.search(text):
            return words(text)
        out, at = [], 0
        for found in self.special.finditer(text):
            out += words(text[at : found.start()])
            out.append(found[0])
            at = found.end()
        return out + words(text[at:])

    def encode(self, texts: list[str]) -> list[tuple[bytes, bytes]]:
        """For each text its ids as little-endian unsigned 32-bit numbers, and its decoded text in UTF-8."""
        if len(self.known) >= _CACHE // 2:
            self.older, self.known = self.known, {}
        cut = [[self._cut(window) for window in _windows(text)] for text in texts]
        new = set()
        for windows in cut:
            for found in windows:
                new |= set(found).difference(self.known)
        self._learn(new)
        of, out = self.known.__getitem__, []
        for windows in cut:
            pairs = [list(map(of, found)) for found in windows if found]
            out.append((b"".join([x for own in pairs for x, _ in own]), b" ".join([x for own in pairs for _, x in own])))
        for word in new:
            if len(word) > _CACHE_BYTES:
                del self.known[word]
        return out

    def decode(self, ids: list[int]) -> str:
        """The tokens' strings, joined by blanks, as the vocabulary has no decoder of its own."""
        return " ".join([self.strings[i] for i in ids])


def _windows(text: str) -> Iterator[str]:
    """A long text in pieces that begin at a blank, which no word, special token or composition crosses."""
    at = 0
    while len(text) - at > SLICE_BYTES:
        cut = text.find(" ", at + SLICE_BYTES)
        if cut < 0:
            break
        yield text[at:cut]
        at = cut
    yield text[at:]


@functools.lru_cache(maxsize=2)
def _words(data: bytes) -> Words:
    return Words(data)


def _shared(vocabulary: str):
    """The bytes of a vocabulary file, read once on the driver and broadcast; a file of a fixed and small size."""
    with open(vocabulary, "rb") as f:
        return SparkSession.active().sparkContext.broadcast(f.read())


def _slices(column: pa.Array) -> Iterator[list[str]]:
    """The texts of a batch, null as empty, about ``SLICE_BYTES`` at a time; a task never holds the results of a whole batch."""
    _, offsets = utf8(column)
    for a, b in slices(offsets):
        yield [x or "" for x in column[a:b].to_pylist()]


def encode(text: Column, vocabulary: str) -> Column:
    """Token ids of the whole text as an array of int.

    ``vocabulary`` is the path of a tokenizer file: byte-level BPE with word ends, texts in NFC and lower case, words cut by
    the public pattern. Special tokens are found where a text holds their strings, and none are added. Null and empty texts,
    and those of white space alone, have no ids. Each row is encoded alone, so repeated rows, null ids and other columns
    need no care; a very long text is worked off in pieces, a very long word along one path.
    """
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _words(shared.value)
        for texts in chain.from_iterable(map(_slices, batches)):
            ids = [np.frombuffer(x, "<u4") for x, _ in own.encode(texts)]
            ends = np.cumsum([0, *map(len, ids)])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *ids]).astype(np.int32)))

    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, vocabulary: str) -> Column:
    """The tokens' strings joined by blanks, special tokens included; null or no ids give an empty text, an unknown id is an error."""
    shared = _shared(vocabulary)

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _words(shared.value)
        for column in batches:
            yield pa.array([own.decode(x or []) for x in column.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(ids)


def round_trip(text: Column, vocabulary: str) -> Column:
    """A struct of ``packed``, the ids that ``encode`` gives as little-endian unsigned 32-bit numbers, and ``decoded``, what
    ``decode`` makes of them, in one task."""
    shared = _shared(vocabulary)
    kind = pa.struct([("packed", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = _words(shared.value)
        for texts in chain.from_iterable(map(_slices, batches)):
            found = own.encode(texts)
            decoded = pa.array([x for _, x in found], pa.binary()).cast(pa.string())
            yield pa.StructArray.from_arrays([pa.array([x for x, _ in found], pa.binary()), decoded], fields=list(kind))

    return F.arrow_udf(run, "packed binary, decoded string")(text)
