"""Body lookup, fallback and rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.html import by_tag, columns_map, grid_columns, html_to_text, leaf_elements, table_grid
from mailloom.functions.text import as_col, blank_to_null, let, preview
from mailloom.operators.filters import MESSAGE_KEYS


def first_part(parts: DataFrame, subtype: str, keys: tuple[str, ...] = MESSAGE_KEYS) -> DataFrame:
    """First ``text/<subtype>`` leaf of each message by its path in the part tree.

    The path is chosen from keys and paths alone; contents come in by a join for the chosen leaf, so a message moves one
    content, whatever the number of its parts. A path listed twice gives one of its rows. Parts without a path or with a
    null key belong to no message.
    """
    leaf = parts.filter((F.lower("type") == "text") & (F.lower("subtype") == subtype))
    first = leaf.groupBy(*keys).agg(F.min("path").alias("_first"))
    rows = leaf.join(first, list(keys)).filter(F.col("path") <= F.col("_first"))
    nth = F.count(F.lit(1)).over(Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("_first", nth).filter(F.col("_first") == 1).select(*keys, *[c for c in parts.columns if c not in keys])


def part_bodies(
    messages: DataFrame, parts: DataFrame, subtype: str, name: str, keys: tuple[str, ...] = MESSAGE_KEYS
) -> DataFrame:
    """Add the content of the first ``text/<subtype>`` part as column ``name``."""
    chosen = first_part(parts, subtype, keys).select(*keys, F.col("content").alias(name))
    return messages.join(chosen, list(keys), "left")


def parts_of(messages: DataFrame, parts: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS) -> DataFrame:
    """Every part of the given messages."""
    return messages.join(parts, list(keys))


def refetched(
    messages: DataFrame, raw: DataFrame, body: str = "body", keys: tuple[str, ...] = MESSAGE_KEYS
) -> DataFrame:
    """Fill blank bodies from the raw table.

    Only blank messages take part in a join, and the raw table is first reduced to their keys, so
    the raw text of all other messages stays where it is. If the raw table has a key several times, the smallest of its
    texts that are not blank stands, and the message still comes once.
    """
    is_blank = blank_to_null(body).isNull()
    blank = messages.filter(is_blank)
    wanted = raw.select(*keys, F.col("raw_text").alias("_raw")).join(blank.select(*keys), list(keys), "left_semi")
    wanted = wanted.groupBy(*keys).agg(F.coalesce(F.min(F.when(blank_to_null("_raw").isNotNull(), F.col("_raw"))), F.min("_raw")).alias("_raw"))
    filled = blank.join(wanted, list(keys), "left").withColumn(body, F.col("_raw")).select(*messages.columns)
    return messages.filter(~is_blank).unionByName(filled)


def body_with_fallback(html: Column | str, text: Column | str, raw: Column | str | None = None) -> Column:
    """Rendered HTML part if it has text, else the text part, else (when given) the raw text.

    Filters leave out the raw text.
    """
    rendered = let(F.when(blank_to_null(html).isNotNull(), html_to_text(html)), blank_to_null)
    options = [rendered, blank_to_null(text)]
    if raw is not None:
        options.append(blank_to_null(raw))
    return F.coalesce(*options, F.lit(""))


def render(c: Column | str, is_html: bool, mode: str = "text") -> Column:
    """Body in the wanted mode: text, html (as is), json:table (columns), json:html (elements by tag)."""
    c = as_col(c)
    if not is_html or mode in ("html", "raw"):
        return c
    if mode == "json:table":
        return columns_map(grid_columns(table_grid(c)))
    if mode == "json:html":
        return by_tag(leaf_elements(c))
    return html_to_text(c)


def shown_body(c: Column | str, full: bool = False) -> Column:
    """Body as listed: cut to 200 characters unless the whole text was asked for."""
    return as_col(c) if full else preview(c, 200)


def table_cells(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """One row per cell: table, row and column positions (from 1) and the clean text."""
    return (
        pages.select(*keys, F.posexplode(table_grid(html)).alias("t", "rows"))
        .select(*keys, "t", F.posexplode("rows").alias("r", "cells"))
        .select(*keys, "t", "r", F.posexplode("cells").alias("c", "text"))
        .select(*keys, *[(F.col(x) + 1).cast("bigint").alias(n) for x, n in zip("trc", ("table_no", "row_no", "col_no"))], "text")
    )


def table_columns(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """One row per (page, header) with the ordered values."""
    return pages.select(*keys, F.inline(grid_columns(table_grid(html))))


def elements(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """One row per text element of a page."""
    return pages.select(*keys, F.inline(leaf_elements(html)))


def elements_by_tag(pages: DataFrame, html: str, *keys: str) -> DataFrame:
    """One row per (page, tag) with the texts in page order."""
    return pages.select(*keys, F.inline(by_tag(leaf_elements(html))))
