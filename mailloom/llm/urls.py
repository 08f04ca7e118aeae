"""URL filters: host and path rules, and gradient-boosted trees on lexical features for the urls that no rule fits."""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.llm.common import col, fresh

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Folds of the labelled urls for the statistics of suffixes.
FOLDS = 5
FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "host_digits", "dashes", "parameters", "entropy", "suffix_share", "suffix_seen", "extension")


def host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lowered; null or no ``://``: empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; null or no ``://``: empty."""
    return F.coalesce(F.regexp_extract(url, r"://([^/?#]*)([^?#]*)", 2), F.lit(""))


def rule(rules: dict[str, str], host_: Column, path_: Column) -> Column:
    """The longest rule (``host/path``) that fits the host or a parent domain of it and begins the path; else null."""
    out = F.lit(None).cast("string")
    for name in sorted(rules, key=lambda x: (len(x), x)):
        own, _, rest = name.partition("/")
        fits = ((host_ == own) | host_.endswith(f".{own}")) & path_.startswith(f"/{rest}")
        out = F.when(fits, F.lit(name)).otherwise(out)
    return out


def suffix(host_: Column) -> Column:
    return F.substring_index(host_, ".", -1)


def _ratio(text: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(text, pattern, "")) / F.greatest(F.length(text), F.lit(1))


def _entropy(text: Column) -> Column:
    """Bits a character."""
    letters = F.split(text, "")
    size = F.greatest(F.length(text), F.lit(1)).cast("double")
    shares = F.transform(F.array_distinct(letters), lambda x: (F.length(text) - F.length(F.replace(text, x, F.lit("")))) / size)
    return -F.aggregate(F.filter(shares, lambda x: x > 0), F.lit(0.0), lambda a, x: a + x * F.log2(x))


def features(df: DataFrame, url: str, host_: str, path_: str) -> DataFrame:
    """``df`` with the lexical features of its urls (null: as the empty url); statistics of suffixes are joined later."""
    whole, h, p = F.coalesce(col(url), F.lit("")), col(host_), col(path_)
    return df.withColumns({
        "length": F.length(whole).cast("double"),
        "host_length": F.length(h).cast("double"),
        "path_length": F.length(p).cast("double"),
        "labels": (F.length(h) - F.length(F.replace(h, F.lit("."), F.lit("")))).cast("double"),
        "depth": (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("double"),
        "digits": _ratio(whole, "[^0-9]"),
        "host_digits": _ratio(h, "[^0-9]"),
        "dashes": _ratio(h, "[^-]"),
        "parameters": (F.length(whole) - F.length(F.regexp_replace(whole, "[?&]", ""))).cast("double"),
        "entropy": _entropy(whole),
        "extension": F.length(F.regexp_extract(p, r"\.([A-Za-z0-9]+)$", 1)).cast("double"),
    })


def fold(address: Column) -> Column:
    """The fold of a url; equal urls are in one fold."""
    return F.pmod(F.xxhash64(F.lit("fold"), address), F.lit(FOLDS))


def with_suffix_shares(rows: DataFrame, labelled: DataFrame, rate: float) -> DataFrame:
    """``rows`` with the share of allowed urls and the number of urls that ``labelled (host, label, fold)`` has for their suffix.

    A row leaves out the labelled urls of its ``own_fold``, so a training row's statistics do not hold its own label; no
    fold has the number ``FOLDS``. Shares lean towards ``rate`` by ten urls. The statistics are broadcast: they have at most
    a row for each labelled url and fold, and the labelled urls are bounded.
    """
    sums = labelled.groupBy(suffix(F.col("host")).alias("suffix")).pivot("fold", list(range(FOLDS))).agg(F.sum("label").alias("s"), F.count("label").alias("n"))
    sums = sums.fillna(0)
    kept = [(F.col("own_fold") != k, F.col(f"{k}_s"), F.col(f"{k}_n")) for k in range(FOLDS)]
    allowed, seen = (sum((F.when(use, pair[i]).otherwise(0.0) for use, *pair in kept), F.lit(0.0)) for i in (0, 1))
    joined = rows.join(F.broadcast(sums), "suffix", "left").fillna(0, [f"{k}_{x}" for k in range(FOLDS) for x in "sn"])
    return joined.withColumns({"suffix_share": (allowed + 10 * rate) / (seen + 10), "suffix_seen": F.log1p(seen)})


def judge(pages: DataFrame, rules: dict[str, str], *, url: str = "url", train_rows: int = 20000, trees: int = 10, depth: int = 3, seed: int = 7) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule``, ``verdict`` (allow or block) and ``score`` (share of allow, 0 to 1).

    ``rules`` gives allow or block for each ``host/path``. A url that a rule fits has that rule's verdict; such urls are also
    the labelled ones from which the trees learn, about ``train_rows`` of them, chosen by a hash of the url, so that the
    statistics of suffixes, which are broadcast, are bounded too; a training row takes them from the other folds. Each other url, a null or empty one included, has the
    verdict of the trees (allow from 0.5). If the labelled urls hold one verdict only, or none, the trees are left out: that
    verdict, or allow. Repeated rows have equal verdicts; existing columns of the added names are replaced.
    """
    added = ["host", "path", "rule", "verdict", "score"]
    mine = [x for x in pages.columns if x.lower() not in added]
    pages = pages.select(*[col(x) for x in mine])
    address = fresh(pages, "address")
    keep = F.struct(*[col(x) for x in mine]).alias("row")
    rows = pages.select(keep, col(url).alias(address))
    rows = rows.withColumns({"host": host(F.col(address)), "path": path(F.col(address))})
    rows = rows.withColumn("rule", rule(rules, F.col("host"), F.col("path")))
    given = F.coalesce(*[F.when(F.col("rule") == name, F.lit(what)) for name, what in rules.items()]) if rules else F.lit(None).cast("string")
    rows = rows.withColumn("given", given)
    sizes = {r["given"]: r["count"] for r in rows.where(F.col("given").isNotNull()).groupBy("given").count().collect()}
    out = [F.col(f"row.`{x}`").alias(x) for x in mine]
    if len(sizes) < 2:
        only = next(iter(sizes), "allow")
        return rows.select(*out, "host", "path", "rule", F.coalesce("given", F.lit(only)).alias("verdict"), F.when(F.coalesce("given", F.lit(only)) == "allow", 1.0).otherwise(0.0).alias("score"))
    share = min(1 << 30, (1 << 30) * train_rows // sum(sizes.values()) + 1)
    chosen = rows.where(F.col("given").isNotNull() & (F.pmod(F.xxhash64(address), F.lit(1 << 30)) < share))
    chosen = chosen.select(address, "host", "path", (F.col("given") == "allow").cast("double").alias("label"))
    chosen = chosen.withColumn("fold", fold(F.col(address)))
    rate = chosen.agg(F.avg("label")).first()[0] or 0.5
    assemble = VectorAssembler(inputCols=list(FEATURES), outputCol="features")

    def ready(df: DataFrame, own_fold: Column) -> DataFrame:
        own = features(df.withColumns({"suffix": suffix(F.col("host")), "own_fold": own_fold}), address, "host", "path")
        return assemble.transform(with_suffix_shares(own, chosen, rate))

    train = ready(chosen.drop("fold"), fold(F.col(address)))
    model = GBTClassifier(maxIter=trees, maxDepth=depth, seed=seed, featuresCol="features", labelCol="label").fit(train.select("features", "label"))
    judged = model.transform(ready(rows, F.lit(FOLDS))).withColumn("score", vector_to_array("probability")[1])
    learned = F.when(F.col("score") >= 0.5, "allow").otherwise("block")
    return judged.select(*out, "host", "path", "rule", F.coalesce("given", learned).alias("verdict"), "score")
