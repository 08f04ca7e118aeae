"""Counts, positions and existence of matching messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.operators.numbering import FOLDER_KEYS, newest, number_range, with_numbers

_PLACE = (*FOLDER_KEYS, "internal_date", "uid")


def count_messages(df: DataFrame, predicate: Column | None = None) -> DataFrame:
    """One row with the number of (matching) messages; no message gives 0."""
    rows = df if predicate is None else df.filter(predicate)
    return rows.agg(F.count("*").alias("n"))


def count_by_folder(df: DataFrame, predicate: Column | None = None, text_range: str | None = None) -> DataFrame:
    """Count per folder, of the given number range when there is one; a folder without hits has 0."""
    hit = F.lit(True) if predicate is None else predicate
    if text_range is None:
        return df.groupBy(*FOLDER_KEYS).agg(F.count_if(hit).alias("n"))
    in_range = number_range(df.withColumn("_hit", hit).select(*_PLACE, "_hit"), text_range)
    found = in_range.select(*FOLDER_KEYS, F.col("_hit").cast("int").alias("n"))
    # Every folder once with no hit: null accounts and folders are keys like any other, and no join is needed.
    every = df.select(*FOLDER_KEYS).distinct().withColumn("n", F.lit(0))
    return found.unionByName(every).groupBy(*FOLDER_KEYS).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def positions(df: DataFrame, predicate: Column) -> DataFrame:
    """Numbers of the matching messages, one row each, over the whole folder.

    What the predicate says is settled at the scan, so its columns (subjects, bodies) never move.
    """
    hits = with_numbers(df.withColumn("_hit", predicate).select(*_PLACE, "_hit"))
    return hits.filter("_hit").select(*FOLDER_KEYS, "email_no")


def position_list(df: DataFrame, predicate: Column, pool: int) -> DataFrame:
    """``1,7`` per folder for the newest ``pool`` messages; no match gives the empty text.

    The pool bounds the list, so it is built from at most that many numbers.
    """
    hits = F.sort_array(F.collect_list(F.when(F.col("_hit"), F.col("email_no"))))
    rows = newest(df.withColumn("_hit", predicate).select(*_PLACE, "_hit"), pool)
    return rows.groupBy(*FOLDER_KEYS).agg(F.array_join(hits, ",").alias("positions"))


def position_pieces(df: DataFrame, predicate: Column, size: int = 100_000) -> DataFrame:
    """The list over whole folders: a row for each ``size`` message numbers that hold a match, ``piece`` counting from 1.

    Pieces in order, joined by commas, are the folder's list; none is built from more than ``size`` numbers, however large
    the folder. A folder without a match has one piece with the empty text.
    """
    found = positions(df, predicate).withColumn("piece", F.floor((F.col("email_no") - 1) / size).cast("long") + 1)
    lists = found.groupBy(*FOLDER_KEYS, "piece").agg(F.array_join(F.sort_array(F.collect_list("email_no")), ",").alias("positions"))
    hit = any_match_by_folder(df, predicate).filter(~F.col("found"))
    return lists.unionByName(hit.select(*FOLDER_KEYS, F.lit(1).cast("long").alias("piece"), F.lit("").alias("positions")))


def any_match(df: DataFrame, predicate: Column) -> DataFrame:
    """One row, true when some message matches."""
    return df.agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("found"))


def any_match_by_folder(df: DataFrame, predicate: Column) -> DataFrame:
    return df.groupBy(*FOLDER_KEYS).agg(F.coalesce(F.bool_or(predicate), F.lit(False)).alias("found"))
