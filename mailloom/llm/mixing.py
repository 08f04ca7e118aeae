"""Mixing documents to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier on hashed words and on the shape of the text (signs, capitals, repeated words), learned from the labelled table, gives each document its posterior over the
domains. Document rates, 0 or more, are then fitted so that the expected tokens of each domain, the sum of rate x tokens x
posterior, match the targets: least squares by projected gradient. A step is a number for each domain, and a rate is a
function of the document's posterior and of the steps so far, so an iteration is one aggregate of a few sums over the
documents; nothing of their number returns to the driver, and the plan does not grow.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import col, fresh, materialised

#: Domains from the labels, in the order in which they apply.
DOMAINS = ("toxic", "good", "plain")
BUCKETS = 1 << 16


def words(text: Column) -> Column:
    """Runs of letters, in lower case; null: none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda x: x != "")


def _hashed(words_: Column) -> Column:
    return F.transform(words_, lambda x: F.pmod(F.xxhash64(x), F.lit(BUCKETS)).cast("int"))


def _shape(text: Column, count: Column, different: Column) -> Column:
    """Hash buckets of what a text looks like, in steps: its shares of signs, of capitals, and of different words."""
    size = F.greatest(F.length(text), F.lit(1))
    signs = F.floor(F.regexp_count(text, F.lit(r"[^\p{L}\p{N}\s]")) * 50 / size)
    capitals = F.floor(F.regexp_count(text, F.lit(r"\p{Lu}")) * 20 / size)
    own = F.floor(different * 10 / F.greatest(count, F.lit(1)))
    told = [F.concat(F.lit(f" {name} "), F.least(x, F.lit(10)).cast("string")) for name, x in (("signs", signs), ("capitals", capitals), ("different", own))]
    return F.when(count > 0, _hashed(F.array(*told))).otherwise(F.array().cast("array<int>"))


def _read(text: Column) -> Column:
    """``tokens``, the number of words, and ``buckets``, those of the words and of the text's shape, each once; cut only once."""
    text = F.coalesce(text, F.lit(""))

    def counted(h: Column, once: Column) -> Column:
        buckets = F.array_union(once, _shape(text, F.size(h), F.size(once)))
        return F.struct(F.size(h).cast("double").alias("tokens"), buckets.alias("buckets"))

    return _let(_hashed(words(text)), lambda h: _let(F.array_distinct(h), lambda once: counted(h, once)))


@dataclass(frozen=True)
class Classifier:
    """Prior log odds and, for each hash bucket, the evidence for each domain."""

    priors: tuple[float, ...]
    weights: tuple[tuple[float, ...], ...]

    def posteriors(self, text: Column) -> Column:
        """An array of the probability of each domain of ``DOMAINS``."""
        return _let(_read(text), self._posteriors)

    def judged(self, text: Column) -> Column:
        """A struct of ``tokens``, the words of the whole text, and its ``posteriors``."""
        return _let(_read(text), lambda r: F.struct(r["tokens"].alias("tokens"), self._posteriors(r).alias("posteriors")))

    def _posteriors(self, read: Column) -> Column:
        return _let(F.array(*[self._score(k, read["buckets"]) for k in range(len(self.priors))]), _softmax)

    def _score(self, k: int, buckets: Column) -> Column:
        own = F.split(F.lit(",".join(f"{x:.6g}" for x in self.weights[k])), ",").cast("array<double>")
        return F.lit(self.priors[k]) + F.aggregate(buckets, F.lit(0.0), lambda a, b: a + F.element_at(own, b + 1))


def _let(value: Column, fn) -> Column:
    return F.element_at(F.transform(F.array(value), fn), 1)


def _softmax(scores: Column) -> Column:
    return _let(F.transform(scores, lambda x: F.exp(x - F.array_max(scores))), lambda e: F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b)))


def _buckets(texts: DataFrame) -> DataFrame:
    """A row for each of the buckets ``b``. From a plain explode the optimizer infers a filter on the array's size, which it moves
    below the join with the labels: every text would be cut twice there, labelled or not."""
    return texts.select("domain", F.explode_outer("b").alias("b")).where(F.col("b").isNotNull())


def learn(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id", train_docs: int = 20000, least_z: float = 4.0, least_odds: float = 1.5) -> Classifier:
    """A classifier from the labelled documents.

    Learns from about ``train_docs`` labelled documents, chosen by a hash of the id, so the labels that are broadcast are
    bounded. A document counts a word once. Evidence is the log odds of a bucket's share of documents in the domain against
    the others, where it is at least ``least_odds`` and ``least_z`` standard errors from none, else 0. Labels with a null column teach nothing; of
    several labels of one id, toxic and then plain wins. Without any label all posteriors are equal.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & F.col("toxic").isNotNull())
    share = min(1 << 30, (1 << 30) * train_docs // max(1, known.count()))
    chosen = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < share).groupBy("doc_id").agg(F.max("toxic").alias("t"), F.min("quality").alias("q"))
    chosen = chosen.select(F.col("doc_id").alias("labelled"), F.when(F.col("t") > 0, 0).when(F.col("q") > 0, 1).otherwise(2).alias("domain"))
    texts = docs.join(F.broadcast(chosen), col(doc_id) == F.col("labelled")).select("domain", _read(col(text))["buckets"].alias("b"))
    each = [F.sum((F.col("domain") == k).cast("long")).alias(f"n{k}") for k in range(len(DOMAINS))]
    sizes = texts.agg(*each).first()
    total = np.array([x or 0 for x in sizes], float)
    if not total.sum():
        return Classifier((0.0,) * len(DOMAINS), ((0.0,) * BUCKETS,) * len(DOMAINS))
    counts = np.zeros((len(DOMAINS), BUCKETS))
    for row in _buckets(texts).groupBy("b").agg(*each).collect():
        counts[:, row["b"]] = list(row)[1:]
    weights, priors = [], np.log((total + 1) / (total.sum() + len(DOMAINS)))
    for k in range(len(DOMAINS)):
        inside, outside = counts[k] + 0.5, counts.sum(axis=0) - counts[k] + 0.5
        n_in, n_out = total[k] + 1, total.sum() - total[k] + 1
        present = np.log(inside / n_in) - np.log(outside / n_out)
        error = np.sqrt(np.maximum(1 / inside - 1 / n_in + 1 / outside - 1 / n_out, 1e-9))
        absent = np.log1p(-inside / n_in) - np.log1p(-outside / n_out)
        told = (np.abs(present) >= np.maximum(least_odds, least_z * error)) & (np.minimum(inside / n_in, outside / n_out) < 0.5)
        priors[k] += absent[told].sum()
        weights.append(tuple(np.where(told, present - absent, 0.0).tolist()))
    return Classifier(tuple(priors.tolist()), tuple(weights))


def _free(posteriors: list[Column], pull: list[float]) -> Column:
    """1 plus the pull of the document's domains."""
    return sum((F.lit(float(y)) * p for y, p in zip(pull, posteriors, strict=True)), F.lit(1.0))


def _rate(posteriors: list[Column], pull: list[float], least: float, most: float) -> Column:
    """1 plus the pull of the document's domains, projected to ``least`` .. ``most``."""
    return F.least(F.lit(most), F.greatest(F.lit(least), _free(posteriors, pull)))


@dataclass(frozen=True)
class Fit:
    """The pull of each domain on the rate, the targets, the expected tokens of each domain that the rates reach, and their bounds."""

    pull: list[float]
    targets: list[float]
    reached: list[float]
    least: float = 0.0
    most: float = float("inf")

    def rate(self, posteriors: Column) -> Column:
        return _let(posteriors, lambda p: _rate([F.element_at(p, k + 1) for k in range(len(DOMAINS))], self.pull, self.least, self.most))


def totals(rows: DataFrame) -> list[float]:
    """Expected tokens of each domain."""
    return [float(x or 0) for x in rows.agg(*[F.sum(F.col("tokens") * F.col("posteriors")[k]) for k in range(len(DOMAINS))]).first()]


def by_share(shares: dict[str, float]) -> list[float]:
    """The shares in the order of ``DOMAINS``, adding up to 1; a domain that is not named has none."""
    if not set(shares) <= set(DOMAINS) or any(x < 0 for x in shares.values()) or not sum(shares.values()) > 0:
        raise ValueError(f"shares must be 0 or more for domains of {DOMAINS}, and not all 0: {shares}")
    return [shares.get(d, 0.0) / sum(shares.values()) for d in DOMAINS]


def fit(rows: DataFrame, targets: list[float], *, least: float = 0.0, most: float = float("inf"), ridge: float = 1e-7, rounds: int = 60, tolerance: float = 1e-5) -> Fit:
    """Rates for ``rows (tokens, posteriors)`` whose expected domain tokens match ``targets``, tokens in the order of ``DOMAINS``.

    Minimises the squared gaps of the domains (as shares of all tokens) plus ``ridge`` times the token-weighted squared
    distance of the rates from 1, over rates of ``least`` (0) to ``most``. A round is a projected gradient step, scaled by the
    Gram matrix of the documents whose rate is not at a bound; it is halved while the optimality gap grows. Rates are then
    1 + pull of the domains within the bounds, so equal posteriors have equal rates. The ridge only chooses among rates that
    reach the targets. Targets out of reach give the nearest rates; no rows, or none with tokens, keep a pull of 0.
    """
    k = len(DOMAINS)
    rows = rows.select("tokens", *[F.col("posteriors")[i].alias(f"p{i}") for i in range(k)])
    p = [F.col(f"p{i}") for i in range(k)]
    wanted = np.array(targets, float)

    def sums(pull: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rated = rows.withColumn("r", _rate(p, pull.tolist(), least, most))
        free = F.when(_free(p, pull.tolist()).between(least, most), F.col("tokens")).otherwise(0.0)
        row = rated.agg(*[F.sum(F.col("r") * F.col("tokens") * x) for x in p], *[F.sum(free * p[i] * p[j]) for i in range(k) for j in range(i, k)]).first()
        values = [float(x or 0) for x in row]
        gram = np.zeros((k, k))
        gram[np.triu_indices(k)] = values[k:]
        return np.array(values[:k]), gram + np.triu(gram, 1).T

    pull, scale = np.zeros(k), 1.0
    reached, gram = sums(pull)
    total = reached.sum()
    if not total:
        return Fit(pull.tolist(), wanted.tolist(), reached.tolist(), least, most)
    gap = wanted - reached
    for _ in range(rounds):
        if np.linalg.norm(gap) <= tolerance * total:
            break
        trial = pull + scale * np.linalg.solve(gram + ridge * total * np.eye(k), gap)
        new, new_gram = sums(trial)
        new_gap = wanted - new - ridge * total * trial
        if np.linalg.norm(new_gap) < np.linalg.norm(gap):
            pull, reached, gram, gap, scale = trial, new, new_gram, new_gap, min(1.0, scale * 2)
        else:
            scale /= 2
            if scale < 1e-4:
                break
    return Fit(pull.tolist(), wanted.tolist(), reached.tolist(), least, most)


def copies(rate: Column, row: Column) -> Column:
    """How often a document is taken: its rate rounded up or down, by a hash of the row so that the mean is the rate."""
    return F.floor(rate + F.pmod(row, F.lit(1 << 30)) / F.lit(float(1 << 30)))


def members(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> tuple[DataFrame, Classifier]:
    """``doc_id``, ``tokens`` (words of the whole text), ``posteriors`` and ``row`` (a hash) of every row, and the classifier.

    Null and empty texts have no tokens, so they carry no weight; their posterior is that of a text without evidence. Null
    ids and repeated rows are members like any other. An empty table gives no rows. Other columns play no part.
    """
    classifier = learn(docs, labels, text=text, doc_id=doc_id)
    own = docs.select(col(doc_id).alias("doc_id"), col(text).alias("text_"))
    rows = own.select("doc_id", classifier.judged(F.col("text_")).alias("own"), F.xxhash64("doc_id", "text_").alias("row"))
    return materialised(rows).select("doc_id", "own.tokens", "own.posteriors", "row"), classifier


def mix(docs: DataFrame, labels: DataFrame, shares: dict[str, float], *, text: str = "text", doc_id: str = "doc_id", ridge: float = 1e-7) -> tuple[DataFrame, Fit]:
    """``members`` with ``rate`` and ``copies``, so that each domain of ``shares`` has its share of all tokens; and the fit.

    Shares need not add up to 1, and a domain that is not named has none. Rows without tokens have a rate too, which moves
    nothing; repeated rows are drawn alike. An empty table gives no rows and a fit that reaches nothing.
    """
    wanted = by_share(shares)
    rows, _ = members(docs, labels, text=text, doc_id=doc_id)
    total = sum(totals(rows))
    fitted = fit(rows, [total * x for x in wanted], ridge=ridge)
    out = rows.withColumn("rate", fitted.rate(F.col("posteriors")))
    return out.withColumn("copies", copies(F.col("rate"), F.col("row"))).drop("row"), fitted


def resample(docs: DataFrame, labels: DataFrame, shares: dict[str, float], *, unwanted: str = "toxic", most: float = 4.0, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` mixed to ``shares`` by repeating rows, without the documents that ``unwanted`` dominates.

    A document whose posterior of ``unwanted`` is 0.5 or more goes, however rare it is. All others stay: their rates lie
    between 1 and ``most``, and are fitted to the smallest totals that have the shares and take nothing from a domain. A row
    is repeated as its rate says, the fraction drawn by a hash of id and text. ``unwanted`` and domains without a share keep
    the expected tokens that the other documents carry. Null and empty texts have no evidence and stay, null ids and
    repeated rows are rows like any other, an empty table stays empty; the columns are those of ``docs``, whatever their names.
    """
    wanted = [0.0 if d == unwanted else x for d, x in zip(DOMAINS, by_share(shares), strict=True)]
    bad = DOMAINS.index(unwanted)
    rows, classifier = members(docs, labels, text=text, doc_id=doc_id)
    good = rows.where(F.col("posteriors")[bad] < 0.5)
    own = totals(good)
    total = max(x / share for x, share in zip(own, wanted, strict=True) if share)
    fitted = fit(good, [total * share if share else x for x, share in zip(own, wanted, strict=True)], least=1.0, most=most)
    mark, copy = fresh(docs, "posteriors_"), fresh(docs, "copy_")
    times = F.when(F.col(mark)[bad] >= 0.5, F.lit(0)).otherwise(copies(fitted.rate(F.col(mark)), F.xxhash64(col(doc_id), col(text))))
    judged = docs.withColumn(mark, classifier.posteriors(col(text)))
    return judged.withColumn(copy, F.explode(F.array_repeat(F.lit(1), times.cast("int")))).drop(copy, mark)
