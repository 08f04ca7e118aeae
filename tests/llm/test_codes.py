"""Vector codes against k-means on Python integers, and the limb product against Python integers beyond 2^53."""

import math

import numpy as np
import pytest

from mailloom.llm import codes


def brute(rows, parts, entries, rounds, scale):
    """(books, [(code, error)]) for vectors of one length, ``rows`` of (id, components)."""
    ints = [[math.floor(scale * x) for x in e] for _, e in rows]
    wide = -(-len(ints[0]) // parts) * parts
    ints = [v + [0] * (wide - len(v)) for v in ints]
    cut = [[v[p * wide // parts : (p + 1) * wide // parts] for p in range(parts)] for v in ints]
    first = {}
    for (i, e), c in zip(rows, cut, strict=True):
        if i is not None and (i not in first or e < first[i][0]):
            first[i] = (e, c)
    books = [[first[i][1][p] for i in sorted(first)[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            members = [[] for _ in books[p]]
            for c in cut:
                members[near(c[p], books[p])[1]].append(c[p])
            books[p] = [[sum(x) // len(m) for x in zip(*m, strict=True)] if m else old for m, old in zip(members, books[p], strict=True)]
    found = [[near(c[p], books[p]) for p in range(parts)] for c in cut]
    return books, [(bytes(k for _, k in f), sum(d for d, _ in f)) for f in found]


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, 1, 2) for i, e, label in rows], "vec_id long, embedding array<double>, label int, size long, code int")


def vectors(seed, n, size, spread=1.0):
    x = np.random.default_rng(seed).normal(size=(n, size)) * spread
    x[n // 2 :: 3] = x[1]
    return x.tolist()


@pytest.mark.parametrize(("size", "entries", "spread"), [(8, 12, 1.0), (6, 300, 0.01), (3, 5, 900.0)])
def test_codes_equal_integers(spark, size, entries, spread):
    good = [(k * 7 - 20, v, k % 3 or None) for k, v in enumerate(vectors(1, 90, size, spread))]
    good += [good[3], (None, [spread] * size, None), (good[5][0], [-spread] * size, 1), (900, [0.0] * size, 2)]
    bad = [(901, None, 1), (902, [None] * size, 1), (903, [float("nan")] * size, 1), (904, [float("-inf")] * size, None)]
    rows = table(spark, good + bad)
    entries = min(entries, 256)
    books, want = brute([(i, e) for i, e, _ in good], 4, entries, 4, 1024)
    found = codes.learn(rows, entries=entries)
    assert found.books[size].tolist() == books
    coded = codes.encode(rows, found)
    got = sorted((str(r["vec_id"]), bytes(r["code"]), r["error"], str(r["label"])) for r in coded.collect())
    assert got == sorted((str(i), c, d, str(label)) for (i, _, label), (c, d) in zip(good, want, strict=True))
    sums = {}
    for (_, _, label), (_, d) in zip(good, want, strict=True):
        sums[label] = sums.get(label, 0) + d
    assert {r["of_label"]: r["label_error"] for r in codes.label_errors(coded).collect()} == sums
    for r in codes.decode(coded, found).collect():
        wide = -(-size // 4)
        assert r["embedding"] == [x / 1024 for p, k in enumerate(bytes(r["code"])) for x in books[p][k]][:size] and len(books[0][0]) == wide


def test_lengths_apart_and_empty_tables(spark):
    rows = table(spark, [(1, [1.0] * 4, 1), (2, [2.0] * 8, 1), (3, [], 2), (4, [3.0] * 4, None), (None, [5.0] * 12, 7)])
    found = codes.learn(rows)
    assert sorted(found.books) == [0, 4, 8]
    coded = {r["vec_id"]: (r["code"] and bytes(r["code"]), r["error"]) for r in codes.encode(rows, found).collect()}
    assert coded == {1: (bytes(4), 0), 2: (bytes(4), 0), 3: (bytes(4), 0), 4: (b"\1" * 4, 0), None: (None, None)}
    empty = codes.learn(rows.limit(0))
    assert empty.books == {} and codes.encode(rows.limit(0), empty).count() == 0


def test_limbs_are_exact():
    rng = np.random.default_rng(2)
    for size, bits in ((16, 9), (16, 29), (1000, 26), (3, 30)):
        x, c = (rng.integers(-(1 << bits), 1 << bits, (n, size)) for n in (20, 9))
        want = [[sum(int(a) * int(b) for a, b in zip(u, v, strict=True)) for v in c] for u in x]
        assert codes.dots(x, c).tolist() == want
        width = 11
        parts = codes.limbs(x, width)
        assert sum(p.astype(np.int64) << (width * k) for k, p in enumerate(parts)).tolist() == x.tolist()
        assert all((p >= 0).all() and (p < 1 << width).all() for p in parts[:-1]) and np.abs(parts[-1]).max() <= 1 << width
    with pytest.raises(ValueError, match="exact error"):
        codes._integers(np.array([1e7] * 64), 64, 4, 1024)
