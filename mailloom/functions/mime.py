"""MIME part rules: what is an attachment, and what it is called."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import as_col

# Characters that may not occur in a file name.
ILLEGAL_IN_NAMES = '/\\:*?"<>|'


def _filled(c: Column) -> Column:
    return F.coalesce(c != "", F.lit(False))


def is_attachment(
    disposition: Column | str,
    type_: Column | str,
    subtype: Column | str,
    disp_filename: Column | str,
    param_name: Column | str,
    param_filename: Column | str,
    size: Column | str | None = None,
) -> Column:
    """Attachment disposition, or any file name, or an application part with a subtype.

    With ``size`` given, a nameless application part counts only if it is not empty.
    """
    kind = F.lower(F.coalesce(as_col(disposition), F.lit("")))
    application = F.coalesce(F.lower(as_col(type_)) == "application", F.lit(False))
    typed = _filled(as_col(subtype))
    if size is not None:
        typed = typed & F.coalesce(as_col(size) > 0, F.lit(False))
    named = _filled(as_col(disp_filename)) | _filled(as_col(param_name)) | _filled(as_col(param_filename))
    return (kind == "attachment") | named | (application & ((kind == "inline") | typed))


def attachment_name(
    disp_filename: Column | str, param_name: Column | str, param_filename: Column | str, subtype: Column | str
) -> Column:
    """First name given, else ``attachment.<subtype>``, else ``attachment``."""
    names = [F.when(_filled(as_col(c)), as_col(c)) for c in (disp_filename, param_name, param_filename)]
    typed = F.when(_filled(as_col(subtype)), F.concat(F.lit("attachment."), F.lower(as_col(subtype))))
    return F.coalesce(*names, typed, F.lit("attachment"))


def safe_name(c: Column | str) -> Column:
    return F.translate(as_col(c), ILLEGAL_IN_NAMES, "_" * len(ILLEGAL_IN_NAMES))


def extension(c: Column | str) -> Column:
    """Lower-case extension with its dot; a leading dot alone does not start one."""
    return F.lower(F.regexp_extract(as_col(c), r"^.+?(\.[^.]*)$", 1))
