"""Checks on an extraction result, and the marked text blocks that carry it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import as_col, has_text

# Block names, error codes and reasons.
EXTRACTION_ERROR = "EXTRACTION_ERROR"
NO_FILES_MATCHED = "NO_FILES_MATCHED"
NO_DATE_RANGE = "NO_DATE_RANGE"
NO_RECIPIENT = "NO_RECIPIENT"
NO_CARDHOLDER = "NO_CARDHOLDER"
EMPTY_ATTACHMENTS = "EMPTY_ATTACHMENTS"
INVALID_RESULT = "INVALID_RESULT"
ATTACHMENTS_REASON = "No attachments found or matched for the extracted date range"
DATE_RANGE_REASON = "No date range could be extracted from the email"
RECIPIENT_REASON = "No recipient was resolved from the email"
RESULT_REASON = "Result is null or not an object"
CARDHOLDER_REASON = "No cardholder / account name was provided"
GATE_DATE_REASON = "No date range extracted from the email body"
GATE_FILES_REASON = "No files matched the extracted date range"


def _failure(failed: Column, field: str, code: str, reason: str) -> Column:
    return F.when(
        failed, F.struct(F.lit(field).alias("field"), F.lit(code).alias("code"), F.lit(reason).alias("reason"))
    )


def result_errors(
    n_attachments: Column | str,
    date_range: Column | str,
    recipient: Column | str,
    cardholder: Column | str,
    require_attachments: bool = True,
    result: Column | str | None = None,
) -> Column:
    """``array<struct<field, code, reason>>`` of what is missing, in this fixed field order.

    Where ``result``, the whole result as a struct, is null, that alone is the error.
    """
    n = F.coalesce(as_col(n_attachments), F.lit(0))
    checks = [
        _failure(~has_text(date_range), "dateRange", NO_DATE_RANGE, DATE_RANGE_REASON),
        _failure(~has_text(recipient), "recipient", NO_RECIPIENT, RECIPIENT_REASON),
        _failure(~has_text(cardholder), "cardholder", NO_CARDHOLDER, CARDHOLDER_REASON),
    ]
    if require_attachments:
        checks.insert(0, _failure(n == 0, "attachments", EMPTY_ATTACHMENTS, ATTACHMENTS_REASON))
    found = F.array_compact(F.array(*checks))
    if result is None:
        return found
    nothing = as_col(result).isNull()
    return F.when(nothing, F.array(_failure(nothing, "result", INVALID_RESULT, RESULT_REASON))).otherwise(found)


def wrap_block(name: str, content: Column | str) -> Column:
    return F.concat(F.lit(f"-??{name}\n"), as_col(content), F.lit(f"\n??{name}-"))


def error_block(code: Column, reason: Column, detail: Column | None = None) -> Column:
    lines = [F.concat(F.lit("CODE: "), code), F.concat(F.lit("REASON: "), reason)]
    if detail is not None:
        lines.append(F.when(detail != "", F.concat(F.lit("DETAIL: "), detail)))
    return wrap_block(EXTRACTION_ERROR, F.concat_ws("\n", *lines))


def result_error(errors: Column | str) -> Column:
    """Error block of the first failure with the other fields as detail; null for a valid row."""
    errors = as_col(errors)
    first = F.get(errors, F.lit(0))
    others = F.transform(F.slice(errors, F.lit(2), F.greatest(F.size(errors), F.lit(1))), lambda e: e["field"])
    detail = F.when(
        F.size(errors) > 1, F.concat(F.lit("Additional failures: "), F.array_join(others, ", "))
    ).otherwise("")
    return F.when(F.size(errors) > 0, error_block(first["code"], first["reason"], detail))


def is_extraction_error(c: Column | str) -> Column:
    return F.coalesce(F.contains(as_col(c), F.lit(f"-??{EXTRACTION_ERROR}")), F.lit(False))


def parse_blocks(c: Column | str) -> Column:
    """``map<name, content>`` of all marked blocks; a repeated name keeps its last block."""
    pattern = r"-\?\?(\w+)\n([\s\S]*?)\n\?\?\1-"
    names = F.regexp_extract_all(as_col(c), F.lit(pattern), 1)
    blocks = F.arrays_zip(
        names.alias("name"), F.regexp_extract_all(as_col(c), F.lit(pattern), 2).alias("content")
    )
    def keep_last(acc: Column, b: Column) -> Column:
        others = F.filter(acc, lambda kept: kept["name"] != b["name"])
        return F.array_append(others, b)

    empty = F.array().cast("array<struct<name: string, content: string>>")
    return F.map_from_entries(F.aggregate(blocks, empty, keep_last))


def request_gate(has_range: Column, n_files: Column | str) -> Column:
    """``struct<valid, code, reason>``: a request needs a date range and at least one file."""
    n = F.coalesce(as_col(n_files), F.lit(0))

    def verdict(valid: bool, code: str, reason: str) -> Column:
        return F.struct(F.lit(valid).alias("valid"), F.lit(code).alias("code"), F.lit(reason).alias("reason"))

    return (
        F.when(~has_range, verdict(False, NO_DATE_RANGE, GATE_DATE_REASON))
        .when(n == 0, verdict(False, NO_FILES_MATCHED, GATE_FILES_REASON))
        .otherwise(verdict(True, "", ""))
    )
