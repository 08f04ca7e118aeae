"""Chain operators over a message table: the split happens once per row, nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions import chain as C
from mailloom.functions.text import as_col, let


def segments(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """One row per segment: index (0 = newest), headers, body."""
    return df.select(*keys, F.inline(C.split_chain(body)))


def _types(bodies: Column) -> Column:
    return F.transform(bodies, C.classify)


def segment_type_counts(df: DataFrame, body: str, *keys: str) -> DataFrame:
    """One row per (message, segment type) with its count."""
    counts = let(_types(C.segment_bodies(body)), C.type_counts)
    return df.select(*keys, F.inline(counts))


def dominant_types(df: DataFrame, body: str, *keys: str) -> DataFrame:
    dominant = C.dominant_type(_types(C.segment_bodies(body)))
    return df.select(*keys, dominant.alias("dominant_type"))


def _if_chained(body: Column, narrowed: Column) -> Column:
    """Narrowed body of a chain, other text as it is; image reference lines go in both cases."""
    chosen = F.when(C.is_chained(body), F.coalesce(narrowed, body)).otherwise(body)
    return let(chosen, C.remove_cid_lines)


def narrowed_body(body: Column | str) -> Column:
    """Bodies of the dominant segment type as one text."""
    body = as_col(body)

    def narrowed(bodies: Column) -> Column:
        return let(_types(bodies), lambda t: C.narrow_to_dominant(bodies, t, C.dominant_type(t)))

    return _if_chained(body, let(C.segment_bodies(body), narrowed))


def best_body(body: Column | str, prefer: str = "latest") -> Column:
    """Body of the segment that most likely holds the request."""
    body = as_col(body)
    return _if_chained(body, C.best_segment(C.segment_bodies(body), prefer))


def best_body_for_task(body: Column | str, pattern: str | None, narrow_by: str = "date-range") -> Column:
    """Body of the segment chosen for a task; see :func:`mailloom.functions.chain.narrow_by_task`."""
    body = as_col(body)
    return _if_chained(body, C.narrow_by_task(C.segment_bodies(body), pattern, narrow_by))


def is_thank_you_chain(body: Column | str) -> Column:
    """Whether the newest message with text is a plain thank-you."""
    body = as_col(body)
    newest = F.when(C.is_chained(body), C.newest_text_segment(C.segment_bodies(body))).otherwise(body)
    return let(newest, C.is_thank_you)
