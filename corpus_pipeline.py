"""From raw documents to token ids: language ID, near-dedup, substring dedup, mixing, encoding.

Each stage works on what the stage before it wrote, and all but the last return the columns of documents.
"""

from __future__ import annotations

import tempfile
import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.llm import bpe, langid, mixing, simhash, substring
from mailloom.llm.common import bounded_batches
from mailloom.session import ship_package

#: Shares of the training tokens; toxic documents go.
WEIGHTS = {"good": 0.9, "plain": 0.1}
VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: No SQL can express a trained classifier, chains of similar sets or byte-pair merges; tests hold each stage against brute force.
ORACLE_SQL = None


def _prepare(spark: SparkSession) -> None:
    ship_package(spark)
    bounded_batches(spark)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those without a letter or far from every profile go.

    Null and empty texts go; a word or two stays if its letters are known. Null ids and repeated rows are judged like any other.
    """
    _prepare(spark)
    return langid.reject_unknown(docs, langid.learn(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash near-duplicate group (3-word shingles, 3 or fewer differing bits): that with the smallest id.

    Null and wordless texts are one group; of repeated rows one stays; a null id stays only where its group has no other.
    """
    _prepare(spark)
    return simhash.deduplicate(docs, words=3, most=3)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 13 words or more that an earlier document has; every document stays.

    A null text becomes empty; rows of one id, null too, are one document and take nothing from each other.
    """
    _prepare(spark)
    found = substring.remove_repeats(docs).drop("n_words", "n_removed", "removed")
    return found.withColumn("n_chars", F.length("text").cast("long"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mixed to ``WEIGHTS``: toxic ones go, every other stays and is repeated as its fitted rate says, at most 4 times.

    Texts without evidence (null, empty) stay; null ids and repeated rows are rows like any other.
    """
    return mixing.resample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), WEIGHTS, unwanted="toxic")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id``, ``ids``, ``n_tokens``, and whether decoding gives the text back; a null text counts as empty, each row is encoded."""
    _prepare(spark)
    path = public_tokenizers.path(VOCABULARY)
    whole = docs.select("doc_id", "text", bpe.round_trip(F.col("text"), path).alias("t")).select("doc_id", "text", "t.ids", "t.decoded")
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "utf-8")
    return whole.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", same.alias("round_trip"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("substrings", substrings), ("mixture", mixture), ("token_ids", token_ids)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="mailloom-pipeline-")
    folder = f"{folder.rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
