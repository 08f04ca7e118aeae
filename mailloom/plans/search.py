"""Mailbox search: the flow behind listing, counting and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame

from mailloom.operators.counts import positions
from mailloom.operators.filters import not_sent
from mailloom.operators.numbering import first_matches, newest


def search(df: DataFrame, predicate: Column, pool: int | None = None, stop_after: int | None = None) -> DataFrame:
    """Matching messages with their numbers among the newest ``pool``, sent mail left out.

    Numbers are given before the filter, so they are mailbox positions.
    """
    inbox = not_sent(df)
    if stop_after is not None:
        return first_matches(inbox, predicate, stop_after, pool)
    if pool is None:
        raise ValueError("give a pool size, or use matching_positions for whole folders")
    return newest(inbox, pool).filter(predicate)


def matching_positions(df: DataFrame, predicate: Column) -> DataFrame:
    """Positions of all matches in every folder."""
    return positions(not_sent(df), predicate)
