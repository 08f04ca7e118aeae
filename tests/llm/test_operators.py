"""Each operator on small rows against a brute-force version, with nulls, empty texts, ties, repeats and clashing columns."""

import base64
import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F

from mailloom.llm import blockjoin, bpe, chat, hnsw, langid, licenses, mixing, simhash, substring, urls

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = "stone river lantern copper meadow orchard violet harbour winter falcon amber thistle saddle ribbon".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + str(rng.randrange(40)) for _ in range(n))


def table(spark, rows):
    """(doc_id, text) with columns whose names clash with those that operators add."""
    return spark.createDataFrame([(i, t, 1, 2, 3) for i, t in rows], "doc_id long, text string, block_ long, n_words long, score long")


EMPTY = [(90, None), (91, ""), (92, " \t\n"), (None, "alone here"), (90, None)]


def test_substring_dedup(spark):
    shared, other = prose(1, 40), prose(2, 13)
    texts = [(1, f"{prose(3, 9)} {shared}"), (2, f"{shared} {prose(4, 20)}"), (3, f"{prose(5, 5)}\n\n{other} end"), (4, other), (5, prose(6, 12)), (6, prose(6, 12)), (7, f"{other} x {other}"), (8, prose(7, 30000)), *EMPTY, (2, f"{shared} {prose(4, 20)}"), (None, shared)]
    found = substring.remove_repeats(table(spark, texts), whitespace="single").collect()
    order = {None: 1 << 70}
    first = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        for s in range(len(w) - 12):
            key = tuple(w[s : s + 13])
            first[key] = min(first.get(key, 1 << 71), order.get(i, i))
    want = []
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = set()
        for s in range(len(w) - 12):
            if first[tuple(w[s : s + 13])] < order.get(i, i):
                gone |= set(range(s, s + 13))
        want.append((str(i), len(w), len(gone), " ".join(x for k, x in enumerate(w) if k not in gone)))
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["text"]) for r in found) == sorted(want)
    cut = {r["doc_id"]: r for r in substring.remove_repeats(table(spark, texts[:8])).collect()}
    assert cut[2]["text"] == prose(4, 20) and [(r["start"], r["end"]) for r in cut[2]["removed"]] == [(0, 40)]
    assert cut[3]["text"] == texts[2][1] and cut[7]["text"] == "x" and cut[2]["block_"] == 1
    assert substring.remove_repeats(table(spark, [])).count() == 0


def test_substring_blocks_are_read_in_bounded_pieces():
    """Working memory of a block: a few times its text though every window is shared. With all its words at once it was 13 times."""
    texts = [prose(i % 150, 1800) for i in range(300)]
    block = pa.table({"doc_id": pa.array(range(300), pa.int64()), "text": texts})
    none = np.zeros(0, np.uint64)
    tracemalloc.start()
    seeds = substring._seeds(block, "text", 13)
    found, ids = substring._extended(block, "text", "doc_id", 13, seeds)
    lost = [int(gone.sum()) for _, gone in substring._gone(block, "text", "doc_id", 13, none, none.astype(np.int64))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 150 * 1788 and ids.max() == 149 and sum(lost) == 150 * 1800
    assert peak < 7 * sum(map(len, texts))


def fingerprint(text):
    w = (text or "").encode().lower().split()
    shingles = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def test_simhash(spark):
    base = prose(1, 400)
    texts = [(k, base.replace("stone1 ", f"stone{k} ", 1)) for k in range(1, 25)] + [(100 + k, prose(k, 60)) for k in range(20)] + [(200, base), (3, base), *EMPTY]
    found = simhash.near_duplicates(table(spark, texts)).collect()
    prints = np.array([fingerprint(t) for _, t in texts], np.uint64)
    label = np.arange(len(texts))
    near = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3
    for _ in texts:
        label = np.where(near, label[None, :], 1 << 30).min(axis=1)
    want = []
    for k, (i, _) in enumerate(texts):
        ids = [j for (j, _), x in zip(texts, label, strict=True) if x == label[k] and j is not None]
        want.append((str(i), int(prints[k].view(np.int64)), str(min(ids, default=None))))
    assert sorted((str(r["doc_id"]), r["fp"], str(r["component_id"])) for r in found) == sorted(want)
    kept = simhash.deduplicate(table(spark, texts)).collect()
    assert len(kept) == len({w[2] if w[2] != "None" else w for w in want}) and kept[0]["n_words"] == 2
    lost = table(spark, [(None, base), (None, base), (None, prose(900, 60)), (1, prose(901, 60)), (None, prose(901, 60)), (2, None)])
    assert sorted(map(str, (r["doc_id"] for r in simhash.deduplicate(lost).collect()))) == ["1", "2", "None", "None"]
    assert simhash.deduplicate(lost.limit(0)).count() == 0
    assert simhash.near_duplicates(table(spark, [])).count() == 0


def test_simhash_index_finds_every_link(spark):
    rng = np.random.default_rng(5)
    seeds = rng.integers(0, 1 << 63, 60)
    values = {int(x) ^ sum(1 << int(b) for b in rng.choice(63, rng.integers(0, 5), replace=False)) for x in np.repeat(seeds, 12)}
    values = np.array(sorted(values), np.int64)
    links = simhash.links(spark.createDataFrame([(int(x),) for x in values], "fp long")).collect()
    place = {int(x): k for k, x in enumerate(values)}
    near = np.bitwise_count(values.view(np.uint64)[:, None] ^ values.view(np.uint64)[None, :]) <= 3
    label = np.arange(len(values))
    for _ in range(30):
        label = np.where(near, label[None, :], len(values)).min(axis=1)
    mine = list(range(len(values)))

    def root(k):
        while mine[k] != k:
            k = mine[k]
        return k

    for r in links:
        a, b = sorted((root(place[r["a"]]), root(place[r["b"]])))
        assert near[place[r["a"]], place[r["b"]]] or label[place[r["a"]]] == label[place[r["b"]]]
        mine[b] = a
    assert [root(k) for k in range(len(values))] == label.tolist()


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    pieces = ["'", "'s", "'re", "'LL", " ", "  ", "\n", "\r\n", "a", "Zo", "é", "ß", "42", "٣", "漢字", "!", "…", "\u3000", "\xa0", "😀", "e\u0301", "\x00", "\x1c", "\ud7a3"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randrange(30))) for _ in range(400)] + ["a" * 9000, " " * 3000 + "x", prose(1, 9000)]
    rows = table(spark, [*enumerate(texts), *EMPTY])
    for r in rows.select("text", bpe.round_trip(F.col("text"), VOCABULARY).alias("t")).select("text", "t.*").collect():
        assert r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]).decode() == (r["text"] or "")
    ids = rows.select("text", bpe.encode(F.col("text"), VOCABULARY).alias("ids"))
    assert all(bytes(r["d"]).decode() == (r["text"] or "") for r in ids.select("text", bpe.decode(F.col("ids"), VOCABULARY).alias("d")).collect())


def test_language_profiles(spark):
    own = {"xx": "alba comoru dentile", "yy": "krzyk wschod brzeg"}
    rng = random.Random(1)
    rows = [(k, " ".join(rng.choice(own[name].split()) for _ in range(30)), name) for k, name in enumerate(["xx", "yy"] * 20)]
    docs = spark.createDataFrame([*rows, (50, None, "xx"), (51, "123 !!", None), (52, "", "yy"), (None, "alba alba", None), (53, "krzyk" * 20000, None)], "doc_id long, text string, lang string").withColumn("score", F.lit("own"))
    found = langid.predict(docs, langid.learn(docs.where("doc_id < 20"))).collect()
    for r in found:
        want = {50: "und", 51: "und", 52: "und", None: "xx", 53: "yy"}.get(r["doc_id"], r["lang"])
        assert r["lang_pred"] == want and 0 <= r["score"] <= 1 and 0 <= r["margin"] <= 1
    assert len(found) == len(rows) + 5
    assert {r["lang_pred"] for r in langid.predict(docs, langid.learn(docs.limit(0))).collect()} == {"und"}
    assert langid.reject_unknown(docs, langid.learn(docs)).count() == len(rows) + 2


def test_language_distances_equal_brute_force(spark):
    """Ranks, distances, scores and margins by counting n-grams of words one by one."""
    own = {"aa": "mano pelo tarde noche", "bb": "stein wasser himmel garten", "cc": "stone river window garden"}
    rng = random.Random(12)
    rows = [(k, " ".join(rng.choice(own[name].split()) + rng.choice(["", "s", ", ", "1"]) for _ in range(rng.randrange(3, 25))), name) for k, name in enumerate(list(own) * 12)]
    rows += [(100, "Garten? garden! GARTEN", None), (101, "s", None), (102, "garten " * 3000, None), (103, "ñandú río", None)]

    def ranked(texts, size):
        count = {}
        for text in texts:
            for word in re.findall(r"[^\W\d_]+", text.lower()):
                grams = list(word) + [f" {word} "[k : k + 2] for k in range(len(word) + 1)] + [f" {word} "[k : k + 3] for k in range(len(word))]
                for g in grams:
                    count[g] = count.get(g, 0) + 1
        code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
        return sorted(count, key=lambda g: (-count[g], code(g)))[:size]

    size = 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    profiles = langid.learn(docs, size=size)
    assert profiles.languages == ("aa", "bb", "cc")
    known = {name: {g: k for k, g in enumerate(ranked([t for _, t, x in rows if x == name], size))} for name in own}
    found = {r["doc_id"]: r for r in langid.predict(docs, profiles).collect()}
    for i, text, _ in rows:
        top = ranked([text], size)
        cost = {name: sum(abs(ranks[g] - k) if g in ranks else size for k, g in enumerate(top)) for name, ranks in known.items()}
        best = min(sorted(cost), key=cost.get)
        second = min(x for name, x in cost.items() if name != best)
        r = found[i]
        assert r["lang_pred"] == best and abs(r["score"] - (1 - cost[best] / (size * len(top)))) < 1e-12
        assert abs(r["margin"] - (1 - cost[best] / second if second else 0)) < 1e-12


def test_mixing(spark):
    rng = random.Random(2)
    kinds = {"toxic": "scorn", "good": "lucid", "plain": "filler"}
    rows, labels = [], []
    for k in range(600):
        kind = ["toxic", "good", "plain"][0 if k % 10 == 0 else 1 + k % 2]
        rows.append((k, f"{prose(k, rng.randrange(5, 60))} {kinds[kind]}"))
        if k % 2 or k % 4 == 0:
            labels.append((k, int(kind != "plain"), int(kind == "toxic")))
    labels += [(0, None, 1), (None, 1, 0), (1, labels[0][1], 0)]
    shares = {"good": 0.6, "plain": 0.38, "toxic": 0.02}
    given = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out, fitted = mixing.mix(table(spark, [*rows, *EMPTY]), given, shares)
    out = out.collect()
    assert len(out) == len(rows) + len(EMPTY)
    p, t, r = (np.array([x[c] for x in out]) for c in ("posteriors", "tokens", "rate"))
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all() and sum(x["tokens"] == 0 for x in out) == 4
    reached = (r * t) @ p
    assert np.allclose(reached, fitted.reached) and np.allclose(reached / t.sum(), [0.02, 0.6, 0.38], rtol=0.01)
    assert {x["copies"] - int(x["rate"]) for x in out} <= {0, 1}
    # The same least squares by plain projected gradient, small steps.
    members = spark.createDataFrame([(float(n), x.tolist()) for n, x in zip(t, p, strict=True)], "tokens double, posteriors array<double>")
    ridged = mixing.fit(members, fitted.targets, ridge=1e-3)
    found = members.select(ridged.rate(F.col("posteriors")).alias("r"), "tokens").collect()
    want, plain = np.array(fitted.targets), np.ones(len(t))
    for _ in range(20000):
        plain = np.maximum(0, plain - 0.5 * (p @ ((plain * t) @ p - want) / t.sum() + 1e-3 * (plain - 1)))
    assert np.allclose(sorted(plain), sorted(x["r"] for x in found), atol=0.02)
    assert mixing.mix(table(spark, []), given, shares)[0].count() == 0
    assert mixing.by_share({"good": 3, "plain": 1}) == [0, 0.75, 0.25]
    for wrong in ({"good": -1.0}, {"other": 1.0}, {}, {"good": 0.0}):
        with pytest.raises(ValueError, match="shares"):
            mixing.by_share(wrong)


def test_mixing_cuts_labelled_texts_only(spark):
    labels = spark.createDataFrame([(0, 1), (2, 2)], "labelled long, domain int")
    docs = table(spark, [(0, "stone river"), (1, "lantern"), (2, "copper copper"), *EMPTY])
    texts = docs.join(F.broadcast(labels), docs["doc_id"] == labels["labelled"]).select("domain", mixing._read(F.col("text"))["buckets"].alias("b"))
    rows = mixing._buckets(texts)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "split(" not in plan[plan.index("Join Inner") :]
    assert sorted(rows.groupBy("domain").count().collect()) == [(1, 5), (2, 4)]
    no_words = spark.createDataFrame([(1, [])], "domain int, b array<int>")
    assert mixing._buckets(no_words).count() == 0


def test_mixing_classifier_equals_naive_bayes(spark):
    rng = random.Random(8)
    docs, labels = [], []
    for k in range(240):
        kind = k % 3
        words = [rng.choice(WORDS) for _ in range(rng.randrange(8, 40))] + (["scorn"] if kind == 0 else [])
        docs.append((k, " ".join(w.upper() + "!!" if kind == 2 else w for w in words)))
        labels.append((k, int(kind == 1), int(kind == 0)))

    def features(text):
        own = re.findall(r"[^\W\d_]+", text.lower())
        if not own:
            return set()
        shape = (sum(not c.isalnum() and not c.isspace() for c in text) * 50 // len(text), sum(c.isupper() for c in text) * 20 // len(text), len(set(own)) * 10 // len(own))
        return {*own, *[(name, min(10, x)) for name, x in zip(("signs", "capitals", "different"), shape, strict=True)]}

    domain = np.array([0 if t else 1 if q else 2 for _, q, t in labels])
    seen = [features(t) for _, t in docs]
    n = np.bincount(domain, minlength=3).astype(float)
    prior, weight = np.log((n + 1) / (n.sum() + 3)), [{} for _ in n]
    for f in set().union(*seen):
        c = np.bincount(domain[[f in s for s in seen]], minlength=3).astype(float)
        for k in range(3):
            i, o, n_i, n_o = c[k] + 0.5, c.sum() - c[k] + 0.5, n[k] + 1, n.sum() - n[k] + 1
            odds = np.log(i / n_i) - np.log(o / n_o)
            error = np.sqrt(max(1 / i - 1 / n_i + 1 / o - 1 / n_o, 1e-9))
            if abs(odds) >= max(1.5, 4 * error) and min(i / n_i, o / n_o) < 0.5:
                absent = np.log1p(-i / n_i) - np.log1p(-o / n_o)
                weight[k][f] = odds - absent
                prior[k] += absent
    assert weight[0] and weight[2]
    rows = table(spark, [*docs, *[(i and i + 1000, t) for i, t in EMPTY]])
    own = mixing.learn(rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    for r in rows.select("text", own.posteriors(F.col("text")).alias("p")).collect():
        score = np.array([prior[k] + sum(weight[k].get(f, 0) for f in features(r["text"] or "")) for k in range(3)])
        odds = np.exp(score - score.max())
        assert np.allclose(r["p"], odds / odds.sum(), atol=1e-3)


VECTORS = [(900, None), (901, []), (902, [0.0] * 6), (903, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (904, [float("nan")] * 6), (905, [float("inf")] * 6), (None, [1.0] * 6), (906, [1.0, 2.0])]


def vectors(spark, seed, n, d=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    x[n // 2 : n // 2 + 40] = x[3] + rng.normal(size=(40, d)) * 0.02
    x[-10:] = x[5]
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    return x, spark.createDataFrame([*rows, rows[7], *VECTORS], "vec_id long, embedding array<double>").withColumn("score", F.lit(1))


def test_block_join(spark):
    x, rows = vectors(spark, 1, 300)
    found = {}
    for r in blockjoin.nearest(rows, candidates=64, queries=8).collect():
        found.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    assert sorted(found) == list(range(0, 300, 20))
    for q, got in found.items():
        score = x @ x[q]
        want = sorted((-s, k) for k, s in enumerate(score) if k != q)[:20]
        got.sort()
        assert [k for _, k, _ in got] == [k for _, k in want] and np.allclose([s for *_, s in got], [-s for s, _ in want])
    assert blockjoin.nearest(rows.limit(0)).count() == 0


def test_hnsw(spark):
    x, rows = vectors(spark, 2, 400)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    label = np.arange(len(x))
    for _ in range(60):
        label = np.minimum(label, np.where(near, label[None, :], len(x)).min(axis=1))
    found = {r["vec_id"]: r for r in hnsw.near_vectors(rows, shard_rows=100, block_rows=150).collect()}
    assert len(found) == len(x) + len(VECTORS)
    links = sum(found[k]["n_links"] for k in range(len(x)))
    assert links >= 0.99 * near.sum() and all(found[k]["n_links"] <= near[k].sum() for k in range(len(x)))
    assert [found[k]["component_id"] for k in range(len(x))] == label.tolist()
    assert all(found[k]["n_links"] == 0 and found[k]["component_id"] == k and found[k]["kept"] for k in range(900, 907))
    assert not found[None]["kept"] and hnsw.near_vectors(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    ("text", "labels", "base", "places"),
    [
        ("Licensed under the Apache License, Version 2.0.", "apache-2.0", "", []),
        ("licensed under the apache license 2.0", "apache-2.0", "", []),
        ("licensed under the apache licence 2.0", "", "", []),
        ("CC-BY cc by, cc BY-NC", "cc-by", "cc-by", [0, 2, 4]),
        ("Copyright (c) 2020 Some One. All rights reserved", "copyright-notice,reserved", "reserved", [5]),
        ("copyright a b c d e f g all rights reserved", "reserved", "reserved", [8]),
        ("licensed under licensed under cc by nc 4 0", "cc-by,cc-by-nc-4.0", "cc-by", [4]),
        ("ALL RIGHTS RESERVED É", "reserved", "reserved", [0]),
        ("Licensed under the MIT License.", "mit-notice", "", []),
        ("licensed by the MIT license", "", "", []),
        ("// SPDX-License-Identifier: Zlib", "spdx", "", []),
        ("It is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl,gpl-notice", "gpl", [18]),
        ("free software you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License, version 2 as published by the free software foundation", "gpl,lgpl-notice", "gpl", [17]),
        ("free software you can redistribute it under the terms of the GNU General Public License as published by the Free Software Foundation", "gpl", "gpl", [12]),
        ("subject to the terms of the Mozilla Public License, v. 2.0", "mpl-2.0", "", []),
        ("subject to the terms of the Mozilla Public License, v. 1.1", "", "", []),
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "isc", "", []),
        ("Permission to use, copy, modify, and distribute this software for any purpose without fee is hereby granted", "", "", []),
        ("licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License", "cc-notice", "", []),
        ("licensed under new Creative Commons Attribution 4.0 International License", "", "", []),
        (None, "", "", []),
        ("", "", "", []),
    ],
)
def test_licenses(spark, text, labels, base, places):
    got = table(spark, [(1, text)]).select(licenses.scan(F.col("text")).alias("s")).first()["s"]
    assert (got["labels"], got["base_labels"], got["n_base"]) == (labels, base, len(places))
    assert (got["first_word"], got["last_word"]) == (min(places, default=None), max(places, default=None))
    assert got["score"] == (1.0 if labels != base else 0.5 if base else 0.0)


def _plain_match(pieces, words, at):
    """Every end of a template's wording that begins at a word, by trying each choice."""
    if not pieces:
        return {at}
    head, rest = pieces[0], pieces[1:]
    if isinstance(head, list):
        return _plain_match(head + rest, words, at) | _plain_match(rest, words, at)
    if isinstance(head, int):
        return set().union(*(_plain_match(rest, words, at + k) for k in range(head + 1) if at + k <= len(words)))
    return _plain_match(rest, words, at + 1) if at < len(words) and words[at] == head else set()


def test_license_automata_equal_brute_force():
    rng = random.Random(8)

    def pieces(depth):
        return [pieces(depth - 1) if depth and x < 0.25 else rng.randrange(3) if x < 0.35 else rng.choice("ab") for x in (rng.random() for _ in range(rng.randrange(1, 4)))]

    def written(ps):
        return " ".join(f"[{written(p)}]" if isinstance(p, list) else f"{{{p}}}" if isinstance(p, int) else p for p in ps)

    for _ in range(400):
        template = ["a", *pieces(3)]
        automaton = licenses.Automaton.compile(written(template))
        for _ in range(20):
            words = [rng.choice("abc") for _ in range(rng.randrange(12))]
            for at in range(len(words)):
                assert automaton.accepts([w.encode() for w in words], at) == min(_plain_match(template, words, at), default=None)


def test_license_odd_rows(spark):
    full = " ".join(licenses.TEMPLATES["bsd-3-clause"].replace("[", "").replace("]", "").replace("{12}", "the owner nor the names of its contributors").split())
    rows = [(1, full.upper()), (1, full), (2, "word " * 300000 + licenses.TEMPLATES["isc"].replace("[or]", "")), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("labels", F.lit("own")).withColumn("score", F.lit(-1))
    found = docs.select("doc_id", "labels", licenses.scan(F.col("text")).alias("s")).collect()
    assert sorted((r["doc_id"] or 0, r["s"]["labels"]) for r in found) == [(0, ""), (1, "bsd,bsd-2-clause,bsd-3-clause"), (1, "bsd,bsd-2-clause,bsd-3-clause"), (2, "isc")]
    assert [m["start"] for r in found if r["doc_id"] == 2 for m in r["s"]["matches"]] == [300000]
    assert docs.limit(0).select(licenses.scan(F.col("text"))).count() == 0


def test_url_filter(spark):
    rules = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}
    given = [
        ("https://A.Example.ORG/es/x?y", "a.example.org", "/es/x", "example.org/es/", "block"), ("http://b.org", "b.org", "", None, None),
        ("http://example.org/en/12#x", "example.org", "/en/12", "example.org/en/1", "block"), ("x://b.org/en/1", "b.org", "/en/1", "org/", "allow"),
        ("http://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("http://q.com/fr/", "q.com", "/fr/", "com/fr/", "allow"),
        ("http://q.com/de/?a=http://x.org/", "q.com", "/de/", "com/de/", "block"), (None, "", "", None, None), ("", "", "", None, None), ("no scheme", "", "", None, None),
    ]
    rows = [(k, u, "own") for k, (u, *_) in enumerate(given)] + [(100 + k, f"http://h{k}.com/{'fr' if k % 2 else 'de'}/{'9' * (k % 7)}", "own") for k in range(60)] + [(7, "http://w.com/en/" + "a" * 5000, "own")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    found = {(r["page_id"], r["url"]): r for r in urls.judge(pages, rules, trees=3).collect()}
    for k, (u, *want) in enumerate(given):
        r = found[k, u]
        assert [r["host"], r["path"], r["rule"]] == want[:3] and r["verdict"] in ("allow", "block") and want[3] in (None, r["verdict"])
    learned = urls.judge(spark.createDataFrame([*[(i, u) for i, u, _ in rows], (900, "http://z.net/fr/9"), (901, "http://z.net/de/9")], "page_id long, url string"), rules)
    assert learned.where("score < 0 or score > 1").count() == 0
    assert {r["verdict"] for r in urls.judge(pages.where("page_id = 8"), rules).collect()} == {"allow"}
    assert urls.judge(pages.limit(0), rules).count() == 0


def test_url_features_equal_brute_force(spark):
    rng = random.Random(5)
    given = ["".join(rng.choice("ab1.-/?&=:é9") for _ in range(rng.randrange(30))) for _ in range(200)]
    given = ["http://" + u for u in given[:150]] + given[150:] + ["", None, "http://x.org/" + "a1/" * 3000 + "f.html"]
    rows = spark.createDataFrame(list(enumerate(given)), "i int, url string").withColumns({"h": urls.host(F.col("url")), "p": urls.path(F.col("url"))})
    for r in urls.features(rows, "url", "h", "p").collect():
        u = r["url"] or ""
        after = u.split("://", 1)[1] if "://" in u else ""
        h = re.split("[/?#]", after)[0]
        p = re.split("[?#]", after[len(h):])[0] if after else ""
        assert (r["h"], r["p"]) == (h, p)
        assert [r["length"], r["host_length"], r["path_length"], r["labels"], r["depth"]] == [len(u), len(h), len(p), h.count("."), p.count("/")]
        assert [r["digits"], r["host_digits"], r["dashes"]] == pytest.approx([sum(c in "0123456789" for c in u) / max(1, len(u)), sum(c in "0123456789" for c in h) / max(1, len(h)), h.count("-") / max(1, len(h))])
        assert r["parameters"] == u.count("?") + u.count("&")
        assert r["entropy"] == pytest.approx(-sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)))


def test_suffix_shares_leave_out_the_own_fold(spark):
    rng = random.Random(6)
    labelled = [(f"h{k}.{rng.choice(['org', 'com', 'net'])}", float(rng.random() < 0.6), rng.randrange(urls.FOLDS)) for k in range(300)]
    asked = [(s, f) for s in ("org", "com", "net", "none") for f in range(urls.FOLDS + 1)]
    rows = spark.createDataFrame(asked, "suffix string, own_fold int")
    found = urls.with_suffix_shares(rows, spark.createDataFrame(labelled, "host string, label double, fold int"), 0.6).collect()
    assert len(found) == len(asked)
    for r in found:
        own = [label for h, label, f in labelled if h.endswith("." + r["suffix"]) and f != r["own_fold"]]
        assert (r["suffix_share"], r["suffix_seen"]) == pytest.approx(((sum(own) + 6) / (len(own) + 10), math.log1p(len(own))))


def test_trees_judge_held_out_urls(spark):
    """Labels that follow from the form of the path, so suffixes alone do not tell them; the judged hosts are new."""
    rng = random.Random(7)

    def url(k, bad):
        path = "/".join("".join(rng.choice("0123456789" if bad else "abcdefgh") for _ in range(6)) for _ in range(rng.randrange(1, 4)))
        return f"{path}"

    rules = {"org/": "allow", "com/": "block"}
    train = [(k, f"http://h{k}.{'com' if k % 2 else 'org'}/{url(k, k % 2)}") for k in range(400)]
    held = [(1000 + k, f"http://n{k}.net/{url(k, k % 2)}") for k in range(200)]
    found = urls.judge(spark.createDataFrame(train + held, "page_id long, url string"), rules).where("page_id >= 1000").collect()
    assert sum((r["verdict"] == "block") == bool(r["page_id"] % 2) for r in found) >= 190


def test_chat_round_trip(spark):
    rng = random.Random(4)
    pieces = ["### ", "</turn>", "\\", "\n", ": ", "user", " ", "é", "### assistant: ", "\n</turn>\n", "%3A"]
    turns = [(k % 5, k // 5, rng.choice(["user", "assistant", "sys: t%em\n", None]), "".join(rng.choice(pieces) for _ in range(rng.randrange(9))) if k % 9 else None) for k in range(300)]
    turns += [(None, None, "assistant", "x"), (7, 1, "user", "same"), (7, 1, "user", "same"), (8, 0, "assistant", "y " * 50000)]
    rows = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    for role, text in {(r or "", t or "") for _, _, r, t in turns}:
        whole, begin, end = chat.render_turn(role, text)
        assert chat.parse(whole * 2) == [(role, text)] * 2 and whole[begin - 2 : begin] == ": " and whole[end:] == chat.CLOSE
    found = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(rows)).collect()}
    assert len(found) == 8
    for conv, r in found.items():
        own = sorted(((t, chat.render_turn(role or "", text or "")[0], role or "", text or "") for c, t, role, text in turns if c == conv), key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode()))
        loss = "".join(text for _, _, role, text in own if role == "assistant")
        assert r["n_turns"] == len(own) and r["formatted_chars"] == sum(len(x[1]) for x in own) and r["loss_chars"] == len(loss)
        assert r["turns_sha256"] == hashlib.sha256("".join(f"{role}\n{text}\n" for *_, role, text in own).encode()).hexdigest()
        assert r["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(rows.limit(0))).count() == 0
