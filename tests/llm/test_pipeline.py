"""The pipeline at the smallest size, each stage held against what the stage before it left."""

import corpus_pipeline as P
import public_tokenizers

import numpy as np
import xxhash

from mailloom.llm import bpe

SF = "/root/testdata/sf0.001"


def fingerprint(text):
    w = text.encode().lower().split()
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def firsts(texts):
    """The smallest id of each group of fingerprints that differ in 3 bits or fewer."""
    ids = sorted(texts)
    prints = np.array([fingerprint(texts[i]) for i in ids], np.uint64)
    near, label = np.bitwise_count(prints[:, None] ^ prints[None, :]) <= 3, np.arange(len(ids))
    for _ in ids:
        label = np.where(near, label[None, :], len(ids)).min(axis=1)
    return {ids[k] for k in label}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, left = docs.columns, [docs]
    for name, stage in P.STAGES:
        stage(spark, left[-1], SF).write.parquet(str(tmp_path / name))
        left.append(spark.read.parquet(str(tmp_path / name)))
    language, unique, cut, mixed, tokens = [{r["doc_id"]: r for r in x.collect()} for x in left[1:]]
    assert all(x.columns == columns for x in left[1:5])
    given = {r["doc_id"]: r for r in docs.collect()}
    assert set(language) == {i for i, r in given.items() if any(c.isalpha() for c in r["text"] or "")}
    assert set(unique) == firsts({i: r["text"] for i, r in language.items()})
    assert set(cut) == set(unique) and all(r["n_chars"] == len(r["text"]) for r in cut.values())
    assert set(mixed) <= set(cut) and all(mixed[i]["text"] == cut[i]["text"] for i in mixed)
    toxic = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 1").collect()}
    assert len((set(cut) - set(mixed)) - toxic) <= 2
    rows = [r["doc_id"] for r in left[4].collect()]
    assert sorted(rows) == sorted(r["doc_id"] for r in left[5].collect()) and max(rows.count(i) for i in mixed) <= 4
    own = bpe.Vocabulary(open(public_tokenizers.path(P.VOCABULARY), "rb").read())
    tokens_of = [b""] * len(own.lengths)
    for token, rank in own.ranks.items():
        tokens_of[rank] = token
    assert set(tokens) == set(mixed)
    for i, r in tokens.items():
        assert r["round_trip"] and r["n_tokens"] == len(r["ids"])
        assert b"".join(tokens_of[x] for x in r["ids"]).decode() == mixed[i]["text"]


def test_stages_on_odd_rows(spark):
    """Empty tables, null ids and texts, repeated rows, and columns named like those that stages add."""
    good = "The river and the garden are quiet in the evening, and the people of the town walk along the water. "
    rows = [(1, good * 3), (1, good * 3), (2, None), (None, good + "Another one of the stories about the old house by the sea is told."), (None, None), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 2, 3) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, verdict long, fingerprint_ long")
    for rows_, want in ((docs, [3, 3, 6, 6, 6]), (docs.limit(0), [0] * 5)):
        for (name, stage), n in zip(P.STAGES, want, strict=True):
            found = stage(spark, rows_, SF)
            assert found.count() == n or name == "mixture" and found.count() >= n, name
            assert name == "token_ids" or found.columns == docs.columns, name
