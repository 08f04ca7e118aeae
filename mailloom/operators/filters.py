"""Row filters over a message table; every text test ignores case and looks for a substring."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.functions.patterns import IgnoreRule, ignored
from mailloom.functions.text import as_col, icontains
from mailloom.operators.numbering import FOLDER_KEYS

MESSAGE_KEYS = (*FOLDER_KEYS, "uid")
# Flag that marks a sent message, and urgent wording.
SENT_FLAG = r"(?i)^[\\$]sent\z"
URGENT_WORDS = ("urgent", "asap", "critical", "emergency")


def from_contains(p: str, c: Column | str = "from_addr") -> Column:
    return icontains(c, p)


def subject_contains(p: str, c: Column | str = "subject") -> Column:
    return icontains(c, p)


def body_contains(p: str, c: Column | str = "body") -> Column:
    return icontains(c, p)


def sender_contains(p: str, c: Column | str = "return_path") -> Column:
    """The return path; a message without one has an empty sender."""
    return icontains(c, p)


def all_of(*predicates: Column | None) -> Column:
    """Conjunction in which an unset predicate passes."""
    return reduce(Column.__and__, (p for p in predicates if p is not None), F.lit(True))


def criteria(
    from_: str | None = None, subject: str | None = None, body: str | None = None, sender: str | None = None
) -> Column:
    """Conjunction of the header and body tests that are set."""
    return all_of(
        from_contains(from_) if from_ else None,
        subject_contains(subject) if subject else None,
        sender_contains(sender) if sender else None,
        body_contains(body) if body else None,
    )


def with_attachment(df: DataFrame, attachments: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS) -> DataFrame:
    """Messages that have an attachment."""
    return df.join(attachments.select(*keys), list(keys), "left_semi")


def is_sent(flags: Column | str = "flags") -> Column:
    return F.coalesce(F.exists(as_col(flags), lambda f: f.rlike(SENT_FLAG)), F.lit(False))


def not_sent(df: DataFrame, flags: Column | str = "flags") -> DataFrame:
    """Drop sent messages; comes before numbering and every other filter."""
    return df.filter(~is_sent(flags))


def not_ignored(df: DataFrame, rules: list[IgnoreRule], columns: dict[str, str] | None = None) -> DataFrame:
    """Drop messages hit by a rule on ``from``, ``subject`` or ``body``.

    Body rules are documented for the matched tool but never reach its code; they work here.
    """
    columns = columns or {"from": "from_addr", "subject": "subject", "body": "body"}
    used = {r.field for r in rules}
    hits = [ignored(column, field, rules) for field, column in columns.items() if field in used]
    return df.filter(~reduce(Column.__or__, hits)) if hits else df


def not_ignored_attachments(attachments: DataFrame, rules: list[IgnoreRule], name: str = "name") -> DataFrame:
    """Drop attachments whose own name is hit; names with commas stay whole."""
    return attachments.filter(~ignored(name, "attachment", rules))


def is_stop_request(subject: Column | str = "subject") -> Column:
    return F.lower(as_col(subject)) == "stop"


def hints_unsubscribe(subject: Column | str = "subject") -> Column:
    return icontains(subject, "stop")


def is_urgent(subject: Column | str = "subject", words: tuple[str, ...] = URGENT_WORDS) -> Column:
    return reduce(Column.__or__, (icontains(subject, w) for w in words))


def older_than(days: int, ref_date: dt.date, date: Column | str = "internal_date") -> Column:
    """Received before the day that lies ``days`` back; the bound is a literal and reaches the scan."""
    bound = dt.datetime.combine(ref_date - dt.timedelta(days=days), dt.time())
    return as_col(date) < F.lit(bound.isoformat(sep=" ")).cast("timestamp_ntz")
