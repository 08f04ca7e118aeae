"""Request resolution from message text to document, date range, recipient and files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.quality import request_gate
from mailloom.functions.request import as_dates, date_range_in_digits, document_type, recipient, words_to_digits
from mailloom.operators.chains import narrowed_body
from mailloom.operators.mapping import file_counts, resolve_document, resolve_recipient, with_file_lists
from mailloom.sources.request_map import RequestMap
from mailloom.sources.staging import spread, staged


def read_requests(
    df: DataFrame,
    body: str,
    rules: RequestMap,
    ref_date: dt.date,
    task_email: Column | None = None,
    task_file: Column | None = None,
) -> DataFrame:
    """Add what the text asks for; every step is a row expression. Rows are dealt out once ahead of them.

    Columns: doc_type, range_text, range, who, document, folder, contact, pattern.
    """
    return (
        spread(df).withColumn("_text", narrowed_body(body))
        .withColumn("_digits", words_to_digits("_text"))
        .withColumns(
            {
                "doc_type": document_type("_text"),
                "range_text": date_range_in_digits(F.col("_digits"), ref_date),
                "who": recipient("_text"),
            }
        )
        .withColumns(
            {
                "range": as_dates("range_text"),
                "document": resolve_document("doc_type", rules),
                "contact": resolve_recipient("who", rules, task_email, task_file),
            }
        )
        .withColumns(
            {
                "folder": F.col("document.folder"),
                "pattern": F.coalesce("contact.file", "document.file"),
            }
        )
        .drop("_text", "_digits")
    )


def summary(file_names: Column | None = None, folder_found: Column | None = None) -> Column:
    """Readable summary of a resolved request, with its files or the missing folder where they are given."""
    span = F.col("range_text")
    document = F.coalesce(
        F.concat(F.lit('"'), F.col("folder"), F.lit('"')), F.col("doc_type"), F.lit("could not be determined")
    )
    dates = F.concat(
        F.coalesce(span["start"], F.lit("null")), F.lit(" to "), span["end"], F.lit("  ("), span["description"], F.lit(")")
    )
    contact = F.coalesce(F.concat(F.lit('"'), F.col("contact.email"), F.lit('"')), F.col("who.display"))
    lines = [
        F.concat(F.lit("Document: "), document),
        F.concat(F.lit("Date Range: "), F.coalesce(dates, F.lit("none"))),
        F.concat(F.lit("Recipient: "), contact),
    ]
    if file_names is not None:
        found = F.concat(F.lit("Files matching:\n   "), F.array_join(file_names, "\n   "))
        lines.append(F.when(F.size(file_names) > 0, found))
    if folder_found is not None:
        lines.append(F.when(~folder_found, F.concat(F.lit("Error: Folder not found: "), F.col("folder"))))
    return F.concat_ws("\n", *lines)


def resolve_requests(
    df: DataFrame, body: str, files: DataFrame, rules: RequestMap, ref_date: dt.date, *keys: str
) -> DataFrame:
    """Requests with their number of matching files, the files, a summary that names them, and the verdict.

    What the texts ask for is staged once, without the texts, because it is read for the ranges and for the result.
    Requests of one range share its list.
    """
    asked = staged(read_requests(df.select(*keys, body), body, rules, ref_date).drop(body), "requests")
    listed = with_file_lists(asked, files, rules.file_patterns(), ref_date)
    n_files = F.coalesce(F.array_size("file_names"), F.lit(0)).cast("bigint")
    return listed.withColumns(
        {
            "n_files": n_files,
            "summary": summary(F.col("file_names"), F.col("folder_found")),
            "verdict": request_gate(F.col("range").isNotNull(), n_files),
        }
    )


def gated_requests(
    df: DataFrame, body: str, files: DataFrame, rules: RequestMap, ref_date: dt.date, *keys: str
) -> DataFrame:
    """Requests with their number of matching files and the verdict only: texts are read once and nothing is written."""
    asked = read_requests(df.select(*keys, body), body, rules, ref_date).drop(body)
    counted = file_counts(asked, files, rules.file_patterns(), ref_date)
    return counted.withColumn("verdict", request_gate(F.col("range").isNotNull(), "n_files"))
