"""Word-end BPE against the tokenizers library, alignment against a brute-force walk over both token sequences."""

import hashlib
import json
import random
from collections import Counter

import numpy as np
import public_tokenizers
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mailloom.llm import alignment, triebpe

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = Tokenizer.from_file(WORDS)
ODD = ["'s", "'", "'re", "'LL", "<|endoftext|>", "<|startoftext|>", "Σ", "ΑΣ", "aaaaaaa", "ing", " ", "\n", "\x1c", "İ", "é", "é", "漢字", "12", "٣", "!'s", "😀", "\x00", "K", "가", "▁", "ﬁ", "힣", "\U00010d50"]
EMPTY = [(90, None), (91, ""), (92, " \t\n"), (None, "alone here"), (None, "alone here"), (90, None), (93, "same Same")]


def table(spark, rows):
    """(doc_id, text) with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, 1, 2, "x") for i, t in rows], "doc_id long, text string, row long, ids long, groups string")


def odd_texts(seed, n):
    rng = random.Random(seed)
    letters = ["".join(rng.choice("abcdeinorst") for _ in range(rng.randrange(1, 40))) for _ in range(n)]
    return [*letters, *["".join(rng.choice(ODD) for _ in range(rng.randrange(25))) for _ in range(n)]]


def test_words_equal_the_library(spark):
    texts = [*odd_texts(1, 300), "a" * 3000, "ab" * 400 + " x", "word " * 300_000]
    rows = table(spark, [*enumerate(texts), *EMPTY])
    found = rows.select("text", triebpe.encode(F.col("text"), WORDS).alias("i"), triebpe.round_trip(F.col("text"), WORDS).alias("t"))
    found = found.select("text", "i", "t.*", triebpe.decode(F.col("i"), WORDS).alias("again")).collect()
    assert len(found) == len(texts) + len(EMPTY)
    for r in found:
        want = LIBRARY.encode(r["text"] or "", add_special_tokens=False).ids
        assert r["i"] == want and np.frombuffer(r["packed"], "<u4").tolist() == want
        assert r["decoded"] == r["again"] == LIBRARY.decode(want, skip_special_tokens=False)
    assert rows.limit(0).select(triebpe.encode(F.col("text"), WORDS)).count() == 0


def test_words_of_every_code_point():
    own = triebpe.Words(open(WORDS, "rb").read())
    points = [chr(c) for c in [*range(0xD800), *range(0xE000, 0x32000)]]
    texts = ["".join(f"a{c}b{c}1 " for c in points[k : k + 500]) for k in range(0, len(points), 500)]
    for text, (ids, _) in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def test_states_are_shared_and_forgotten_words_learned_again(monkeypatch):
    own = triebpe.Words(open(WORDS, "rb").read())
    words = sorted({f"{a}{b}" for a in ("inter", "internal", "internalise") for b in ("", "s", "d", "tion", "x" * 600)})
    steps = []
    monkeypatch.setattr(own, "_last_token", lambda path, depth, *rest: steps.append(path[:depth]) or triebpe.Words._last_token(own, path, depth, *rest))
    found = own.encode_words([w.encode() for w in words])
    assert found == [LIBRARY.encode(w, add_special_tokens=False).ids for w in words]
    short = [w for w in words if len(w) < 600]
    # A node for each different prefix, and one more where a prefix of other words also ends a word.
    assert sum(len(x) < 100 for x in steps) - 3 * 99 <= len({w[:k] for w in short for k in range(1, len(w) + 1)}) + len(short)
    monkeypatch.setattr(triebpe, "_CACHE", 4)
    for text in odd_texts(5, 60) * 2:
        assert np.frombuffer(own.encode([text])[0][0], "<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(own.known) <= 30


def brute(texts):
    """Rows as op12 has them, and how many documents and links each pair has."""
    a_lib = Tokenizer.from_file(BYTES)
    a_lib.encode_special_tokens = True
    b_lib = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    of = {x: b for b, x in enumerate(triebpe.byte_letters())}
    a_bytes = {i: bytes(of[x] for x in t) for t, i in json.load(open(BYTES))["model"]["vocab"].items()}
    b_bytes = [bytes([int(b_lib.id_to_piece(i)[3:5], 16)]) if b_lib.is_byte(i) else b_lib.id_to_piece(i).replace("▁", " ").encode() for i in range(b_lib.get_piece_size())]
    rows, linked = [], []
    for text in texts:
        a = a_lib.encode(" " + text, add_special_tokens=False).ids if text else []
        b = b_lib.encode(text) if text else []
        if not text or not b"".join(a_bytes[i] for i in a) == b"".join(b_bytes[i] for i in b) == (" " + text).encode():
            rows.append((0, 0, 0, ""))
            linked.append([])
            continue
        i = j = end_a = end_b = 0
        links, groups, own_a, own_b = [], [], [], []
        while i < len(a):
            links.append((a[i], b[j]))
            next_a, next_b = end_a + len(a_bytes[a[i]]), end_b + len(b_bytes[b[j]])
            if next_a <= next_b:
                own_a.append(a[i])
                end_a, i = next_a, i + 1
            if next_b <= next_a:
                own_b.append(b[j])
                end_b, j = next_b, j + 1
            if end_a == end_b:
                groups.append(",".join(map(str, own_a)) + "|" + ",".join(map(str, own_b)))
                own_a, own_b = [], []
        rows.append((len(a), len(b), len(groups), ";".join(groups)))
        linked.append(links)
    return rows, linked


def test_alignment(spark, monkeypatch):
    texts = [*odd_texts(2, 60), "the cat sat on the mat " * 700, "<|endoftext|> <s> </s> <0x41>", "two  blanks", " lead", "z" * 5000]
    given = [*enumerate(texts), *EMPTY]
    found = alignment.align(table(spark, given), BYTES, PIECES)
    got = found.scores().collect()
    rows, linked = brute([t or "" for _, t in given])
    documents, links = Counter(x for own in linked for x in set(own)), Counter(x for own in linked for x in own)
    most = Counter()
    for (a, _), n in documents.items():
        most[a] = max(most[a], n)
    want = [(str(i), *r, len(own), sum(documents[x] == most[x[0]] for x in own), sum(documents[x] for x in own)) for (i, _), r, own in zip(given, rows, linked, strict=True)]
    names = ("n_a", "n_b", "n_groups", "groups", "n_links", "n_best", "count_sum")
    assert sorted((str(r["doc_id"]), *[r[x] for x in names]) for r in got) == sorted(want)
    assert sum(r[0] == 0 for r in rows) >= 4 and max(links.values()) > 700
    pairs = {(r["a"], r["b"]): r for r in found.pairs().collect()}
    assert {k: (r["documents"], r["links"], r["best"]) for k, r in pairs.items()} == {k: (n, links[k], n == most[k[0]]) for k, n in documents.items()}
    digest = alignment.align(table(spark, given), BYTES, PIECES, digest=True).documents.collect()
    assert sorted(r["groups"] for r in digest) == sorted(w[4] and hashlib.sha256(w[4].encode()).hexdigest() for w in want)
    assert alignment.align(table(spark, []), BYTES, PIECES).scores().count() == 0


def test_containers():
    rng = np.random.default_rng(3)
    for sizes in ([1, 3, 0, 7], [5000, 2, 65536, 4095, 4096]):
        lows = [np.sort(rng.choice(1 << 16, n, replace=False)) for n in sizes]
        column = alignment._containers(np.concatenate(lows), np.cumsum([0, *sizes]))
        assert all(len(x.as_py()) == min(2 * n, 8192) for x, n in zip(column, sizes, strict=True))
        for part in (column, column[1:3]):
            low, at = alignment.members(part)
            first = 0 if part is column else 1
            assert all((low[at == k] == lows[first + k]).all() for k in range(len(part)))
    # Slices of one task meet in a container; another container number, another row.
    gathered = alignment._Gathered()
    one = lambda text, a, b: alignment._Slice(None, None, None, np.array(text), np.array(a), np.array(b))
    gathered.add(np.array([5, 6]), one([0, 0, 0, 1], [3, 3, 4, 3], [9, 9, 9, 9]))
    gathered.add(np.array([7, 1 << 16]), one([0, 1, 1], [3, 3, 3], [9, 9, 9]))
    found = [r for batch in gathered.containers() for r in batch.to_pylist()]
    held = {(r["a"], r["b"], r["chunk"], r["plane"]): np.frombuffer(r["docs"], "<u2").tolist() for r in found}
    assert held == {(3, 9, 0, -1): [5, 6, 7], (3, 9, 1, -1): [0], (4, 9, 0, -1): [5], (3, 9, 0, 0): [5], (3, 9, 1, 0): [0]}


def test_containers_skip_planes_without_a_bit():
    """A pair linked three times, or six: no number of further links has bit 0, or bit 1."""
    for times, planes in ((3, [1]), (6, [0, 2])):
        gathered = alignment._Gathered()
        gathered.add(np.array([4]), alignment._Slice(None, None, None, np.zeros(times, int), np.full(times, 3), np.full(times, 9)))
        found = [r for batch in gathered.containers() for r in batch.to_pylist()]
        assert [(r["a"], r["b"], r["plane"], r["card"]) for r in found] == [(3, 9, p, 1) for p in (-1, *planes)]
