"""Ingestion of raw messages (one RFC 822 message per file or row) into the message tables.

Header blocks, the part tree, transfer encodings, charsets of one byte and UTF-8 are column expressions
(``functions.rfc822``): a message never leaves its row, whatever its depth, and rows are dealt out once ahead. Python only reads what Spark has no codec for:
encoded words in headers and names, and texts in charsets of several bytes. Messages without either send it nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from email.errors import HeaderParseError
from email.header import decode_header

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions import rfc822 as R
from mailloom.functions.text import let
from mailloom.sources.staging import spread

_ENCODED = re.compile(r"=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?=(?:\s+=\?[^?\s]+\?[bBqQ]\?[^?\s]*\?=)*")


def _text(data: bytes, charset: str | None) -> str:
    try:
        return data.decode(charset or "utf-8", "replace")
    except LookupError:
        return data.decode("utf-8", "replace")


def _words(value: str) -> str:
    """A header value with its encoded words resolved; words that do not decode stay as they are written."""

    def run(m: re.Match[str]) -> str:
        try:
            joined: list[tuple[bytes, str | None]] = []
            for data, charset in decode_header(m[0]):
                if joined and joined[-1][1] == charset:  # a character may be cut between two words
                    joined[-1] = (joined[-1][0] + data, charset)
                else:
                    joined.append((data, charset))
            return "".join(_text(data, charset) for data, charset in joined)
        except (HeaderParseError, ValueError):
            return m[0]

    return _ENCODED.sub(run, value)


def _resolve_words(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for values in batches:
        yield pa.array([None if row is None else [x and _words(x) for x in row] for row in values.to_pylist()], pa.list_(pa.string()))


def _resolve_texts(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for contents, charsets in batches:
        yield pa.array([None if c is None else _text(c, s) for c, s in zip(contents.to_pylist(), charsets.to_pylist())], pa.string())


def _first_text(parts: Column, subtype: str) -> Column:
    inline = F.filter(parts, lambda p: _is_inline_text(p) & (p["subtype"] == subtype))
    return F.get(inline, F.lit(0))


def _is_inline_text(p: Column) -> Column:
    shown = (p["type"] == "text") & p["subtype"].isin("plain", "html")
    return shown & ~p["disposition"].eqNullSafe(F.lit("attachment")) & p["name"].isNull()


def _decoded_text(p: Column) -> Column:
    """A part's text; charsets of several bytes go to Python, all other rows send it nulls."""
    other = ~R.is_plain_charset(p["charset"])
    by_python = F.arrow_udf(_resolve_texts, "string")(F.when(other, p["content"]), F.when(other, p["charset"]))
    return F.when(p.isNull(), F.lit(None)).when(other, by_python).otherwise(R.charset_text(p["content"], p["charset"]))


def parse_messages(df: DataFrame, raw: str, *keys: str) -> DataFrame:
    """Parse a column of raw messages (bytes, or texts in UTF-8); ``keys`` are kept next to the result.

    Adds ``headers`` (lower-case name to its values in order), ``sent_at`` (the ``Date`` header in UTC), ``text`` and ``html``
    (first part of each kind that is neither named nor marked as an attachment) and ``attachments`` (all parts but such
    texts, with their place among the leaves). Parts without a type are plain text; attached messages are attachments. A
    null message gives nulls and no attachments; broken ones give what can be read of them.
    """
    is_binary = isinstance(df.schema[raw].dataType, T.BinaryType)
    names = [F.col(k) for k in keys]
    rows = spread(df.select(*dict.fromkeys([*keys, raw]))).select(*names, R.latin(F.col(raw), is_binary).alias("_raw"))
    rows = rows.select(*names, R.head_and_body(F.col("_raw"))["head"].alias("_head"), F.transform(R.leaves(F.col("_raw")), R.part).alias("_parts"))
    lines = F.transform(R.header_lines(F.col("_head")), lambda x: F.struct(x["name"].alias("name"), R.utf8_text(R.to_bytes(x["value"])).alias("value")))
    rows = rows.select(*names, "_parts", lines.alias("_lines"))
    # One array for Python: header values, then part names, where any of them holds an encoded word.
    values = F.concat(F.transform("_lines", lambda x: x["value"]), F.transform("_parts", lambda p: p["name"]))
    coded = let(values, lambda v: F.when(F.exists(v, lambda x: F.contains(x, F.lit("=?"))), v))
    rows = rows.withColumn("_words", F.arrow_udf(_resolve_words, "array<string>")(coded))
    n = F.size("_lines")
    lines = F.when(F.col("_words").isNull(), F.col("_lines")).otherwise(F.transform("_lines", lambda x, i: F.struct(x["name"].alias("name"), F.get("_words", i).alias("value"))))
    numbered = F.transform("_parts", lambda p, i: F.struct(
        (i + 1).alias("part_no"), p["type"].alias("type"), p["subtype"].alias("subtype"), p["disposition"].alias("disposition"),
        F.coalesce(F.get("_words", n + i), p["name"]).alias("name"), p["content"].alias("content")))
    rows = rows.select(
        *names, lines.alias("_lines"), _first_text(F.col("_parts"), "plain").alias("_text"), _first_text(F.col("_parts"), "html").alias("_html"),
        F.coalesce(F.filter(numbered, lambda p: ~_is_inline_text(p)), F.filter(F.array(), lambda p: F.lit(False)).cast(_PARTS)).alias("attachments"))
    headers = let(F.col("_lines"), lambda ls: F.map_from_entries(F.transform(
        F.array_distinct(F.transform(ls, lambda x: x["name"])),
        lambda name: F.struct(name, F.transform(F.filter(ls, lambda x: x["name"] == name), lambda x: x["value"])))))
    date = F.get(F.filter("_lines", lambda x: x["name"] == "date"), F.lit(0))["value"]
    return rows.select(
        *names, headers.alias("headers"), R.sent_at(date).alias("sent_at"),
        _decoded_text(F.col("_text")).alias("text"), _decoded_text(F.col("_html")).alias("html"), "attachments")


_PARTS = "array<struct<part_no: int, type: string, subtype: string, disposition: string, name: string, content: binary>>"


def read_archive(spark: SparkSession, path: str, glob: str = "*.eml") -> DataFrame:
    """Parse every message file under ``path``; the file path is the key."""
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select("path", "content")
    )
    return parse_messages(files, "content", "path")


def to_messages(parsed: DataFrame, *keys: str) -> DataFrame:
    """Header and body columns of parsed messages; ``date_hdr`` is the date as it was written."""

    def header(name: str):
        return F.array_join(F.try_element_at("headers", F.lit(name)), " ")

    return parsed.select(
        *keys,
        F.col("sent_at").alias("internal_date"),
        header("from").alias("from_addr"),
        header("return-path").alias("return_path"),
        header("to").alias("to_addrs"),
        header("subject").alias("subject"),
        F.get(F.try_element_at("headers", F.lit("date")), F.lit(0)).alias("date_hdr"),
        F.col("text").alias("body_text"),
        F.col("html").alias("body_html"),
    )


def to_attachments(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per attachment with its bytes."""
    return parsed.select(*keys, F.inline("attachments"))
