"""Language identification by rank-order profiles.

A profile is the list of a language's most frequent letter n-grams, most frequent first. A text is ranked the same way, and
each language is charged, for each n-gram of the text, how far its rank is out of place; an n-gram that the profile lacks
costs the length of the profile. The language with the smallest sum is predicted.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from mailloom.llm.bpe import letters
from mailloom.llm.common import col, fresh

UNKNOWN = "und"
#: Least score of a document of ``ENOUGH`` different n-grams or more whose language counts as known; with fewer it falls in
#: proportion. The lowest of the labelled rows of sf0.001, sf0.01, sf0.1 and two larger tables is 0.359; other scripts score 0,
#: random letters mostly under 0.3. A word or two has too few n-grams to rank them: there it is enough that a profile has some.
LEAST_SCORE, ENOUGH = 0.3, 40


def _counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed letter n-grams of the whole text, in order, and their counts. Words are runs of letters, padded by a blank on
    either side; an n-gram lies in one word."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    letter = letters()[points]
    if not letter.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    kept = letter.copy()
    kept[1:] |= letter[:-1]  # the first of several others stands for the blank
    x = np.where(letter, points, 32)[kept]
    x = np.concatenate([[32] * int(x[0] != 32), x, [32] * int(x[-1] != 32)]).astype(np.int64)
    whole = x[1:-1] != 32
    grams = np.concatenate([x[x != 32], x[:-1] << 21 | x[1:], (x[:-2] << 42 | x[1:-1] << 21 | x[2:])[whole]])
    grams.sort()
    new = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
    return grams[new], np.diff(np.append(new, len(grams)))


def _top(grams: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The ``size`` most frequent n-grams, most frequent first, ties by their code."""
    if len(grams) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        there = counts >= least
        grams, counts = grams[there], counts[there]
    return grams[np.lexsort((grams, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """Languages in order, and per language its n-grams by rank."""

    languages: tuple[str, ...]
    ranked: tuple[np.ndarray, ...]
    size: int

    def table(self) -> tuple[np.ndarray, np.ndarray]:
        """All n-grams in order, and each language's rank of each (``size`` where it has none)."""
        grams = np.unique(np.concatenate(self.ranked)) if self.ranked else np.zeros(0, np.int64)
        ranks = np.full((len(self.languages), len(grams) + 1), self.size, np.int64)
        for k, own in enumerate(self.ranked):
            ranks[k, np.searchsorted(grams, own)] = np.arange(len(own))
        return grams, ranks


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", doc_id: str = "doc_id", size: int = 300, train_docs: int = 4000) -> Profiles:
    """Profiles from the rows of ``docs`` that have a text and a language.

    Learns from a sample of about ``train_docs`` documents a language, chosen by a hash of the id, so its cost is bounded;
    a language with fewer is used whole. Ties of counts are settled by the n-gram itself. Rows with a null text, language
    or id, and texts without letters, teach nothing; no rows give no languages, and then every prediction is ``und``.
    """
    known = docs.where(col(text).isNotNull() & col(lang).isNotNull() & col(doc_id).isNotNull()).select(col(doc_id).alias("id"), col(lang).cast("string").alias("lang"), col(text).alias("text"))
    sizes = known.groupBy("lang").count().collect()
    share = [(r["lang"], min(1 << 30, int((1 << 30) * train_docs / r["count"]) + 1)) for r in sizes]
    if not share:
        return Profiles((), (), size)
    limit = F.coalesce(*[F.when(F.col("lang") == name, F.lit(most)) for name, most in share])
    chosen = known.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < limit).select("lang", "text")

    def count(batches):
        total: dict[str, Counter] = {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found, n = _counts(value.as_py())
                total.setdefault(name, Counter()).update(dict(zip(found.tolist(), n.tolist(), strict=True)))
        for name, own in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(own), pa.string()), pa.array(own.keys(), pa.int64()), pa.array(own.values(), pa.int64())], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # The best of each sixteenth of the n-grams, then of those: at most 16 x size rows a language reach the driver.
    best = Window.partitionBy("lang", "part").orderBy(F.desc("n"), "gram")
    rows = counts.withColumn("part", F.pmod(F.xxhash64("gram"), F.lit(16))).withColumn("at", F.row_number().over(best)).where(F.col("at") <= size).select("lang", "gram", "n").collect()
    languages = tuple(sorted({r["lang"] for r in rows}))
    ranked = []
    for name in languages:
        own = [r for r in rows if r["lang"] == name]
        ranked.append(_top(np.array([r["gram"] for r in own], np.int64), np.array([r["n"] for r in own], np.int64), size))
    return Profiles(languages, tuple(ranked), size)


def predict(docs: DataFrame, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` string, ``score`` double and ``margin`` double, from the whole text alone.

    ``score`` is 1 - distance / largest possible distance of the predicted language, ``margin`` how much nearer it is than
    the next language, as a share of that one's distance; both lie in 0..1. A null text, one without a letter, or no learned
    language gives ``und``, 0 and 0. Equal distances go to the language that sorts first. Repeated rows are judged each;
    existing columns of these names are replaced.
    """
    found = fresh(docs, "verdict")
    names = [x for x in docs.columns if x.lower() not in ("lang_pred", "score", "margin")]
    judged = docs.withColumn(found, _verdict(profiles)(col(text)))
    return judged.select(*[col(x) for x in names], *[F.col(f"{found}.{x}").alias(x) for x in ("lang_pred", "score", "margin")])


def reject_unknown(docs: DataFrame, profiles: Profiles, *, text: str = "text", least: float = LEAST_SCORE, enough: int = ENOUGH) -> DataFrame:
    """The documents whose language is known, with their own columns.

    ``und`` documents go, so null texts and those without a letter do, and all if no language was learned. So do those whose
    score does not exceed ``least``, in proportion for texts of fewer than ``enough`` different n-grams: too few of their
    n-grams are near their place in any profile. Repeated rows and null ids are judged like any other; an empty table stays
    empty, and columns of any name stay as they are.
    """
    found = fresh(docs, "verdict")
    judged = docs.withColumn(found, _verdict(profiles)(col(text)))
    level = F.lit(least) * F.least(F.lit(1.0), F.col(f"{found}.grams") / F.lit(float(enough)))
    return judged.where((F.col(f"{found}.lang_pred") != UNKNOWN) & (F.col(f"{found}.score") >= level)).drop(found)


def _verdict(profiles: Profiles):
    """A column function: text to its language, score, margin and how many n-grams decided."""
    grams_known, ranks = profiles.table()
    languages, size = profiles.languages, profiles.size
    kind = pa.struct([("lang_pred", pa.string()), ("score", pa.float64()), ("margin", pa.float64()), ("grams", pa.int64())])

    def judge(value: str | None) -> dict:
        found, counts = _counts(value) if value and languages else ((), ())
        if not len(found):
            return {"lang_pred": UNKNOWN, "score": 0.0, "margin": 0.0, "grams": 0}
        top = _top(found, counts, size)
        where = np.searchsorted(grams_known, top)
        where[grams_known[np.minimum(where, len(grams_known) - 1)] != top] = len(grams_known)
        known = ranks[:, where]
        distance = np.where(known == size, size, np.abs(known - np.arange(len(top)))).sum(axis=1)
        best = int(np.argmin(distance))
        others = np.delete(distance, best)
        margin = 1.0 - distance[best] / others.min() if len(others) and others.min() else 0.0
        return {"lang_pred": languages[best], "score": float(1.0 - distance[best] / (size * len(top))), "margin": float(margin), "grams": len(top)}

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([judge(value.as_py()) for value in texts], kind)

    return F.arrow_udf(run, "lang_pred string, score double, margin double, grams long")
