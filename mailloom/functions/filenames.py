"""File patterns with ``{% date(<mm>-<dd>-<yyyy>) %}``, resolved once on the driver."""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.dates import rolled_date
from mailloom.functions.request import MONTHS
from mailloom.functions.text import as_col, java_regex

# Date codes, what they match in a name, and how their value is captured.
CODES = {
    "mm": r"\d{2}",
    "m": r"\d{1,2}",
    "dd": r"\d{2}",
    "d": r"\d{1,2}",
    "yyyy": r"\d{4}",
    "yy": r"\d{2}",
    "MONTH": "(?:January|February|March|April|May|June|July|August|September|October|November|December)",
    "MM": "(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)",
}
CAPTURES = {"mm": r"\d{1,2}", "m": r"\d{1,2}", "dd": r"\d{1,2}", "d": r"\d{1,2}", "yyyy": r"\d{4}", "yy": r"\d{2}"}

_DATE_SYNTAX = re.compile(r"\{%\s*date\((.*?)\)\s*%\}")
_CODE = re.compile(r"<([^>]+)>")
_SPECIAL = re.compile(r"[.*+?^${}()|\[\]\\]")


def _escape(literal: str) -> str:
    return _SPECIAL.sub(lambda m: "\\" + m[0], literal)


@dataclass(frozen=True)
class FilePattern:
    """``regex`` finds matching names; ``date_regex`` captures the date parts named in ``codes``.

    Only the first date syntax is resolved, and text outside of it is regular expression already.
    """

    source: str
    regex: str
    date_regex: str | None
    codes: tuple[str, ...]

    @classmethod
    def parse(cls, source: str) -> FilePattern:
        found = _DATE_SYNTAX.search(source)
        if not found:
            return cls(source, source, None, ())
        name, capture, codes, at = [], [], [], 0
        for code in _CODE.finditer(found[1]):
            literal = _escape(found[1][at : code.start()])
            name += [literal, CODES.get(code[1], ".*")]
            capture += [literal, f"({CAPTURES.get(code[1]) or CODES.get(code[1], '.*')})"]
            codes.append(code[1])
            at = code.end()
        tail = _escape(found[1][at:])
        regex = source[: found.start()] + "".join(name) + tail + source[found.end() :]
        return cls(source, regex, "".join(capture) + tail, tuple(codes))

    @property
    def dated(self) -> bool:
        return self.date_regex is not None

    def matches(self, file_name: Column | str) -> Column:
        return F.coalesce(as_col(file_name).rlike(java_regex(self.regex)), F.lit(False))

    def date_of(self, file_name: Column | str, ref_date: dt.date) -> Column:
        """Date in the name; missing parts are January, 1 and the reference year. Null without syntax.

        Month names are read back, too.
        """
        if self.date_regex is None:
            return F.lit(None).cast("date")
        c, rx = as_col(file_name), java_regex(self.date_regex)
        year, month, day = F.lit(ref_date.year), F.lit(1), F.lit(1)
        for group, code in enumerate(self.codes, start=1):
            value = F.regexp_extract(c, rx, group)
            number = value.try_cast("int")
            if code in ("mm", "m"):
                month = number
            elif code in ("dd", "d"):
                day = number
            elif code == "yyyy":
                year = number
            elif code == "yy":
                year = number + 2000
            elif code in ("MONTH", "MM"):
                short = F.lower(F.substring(value, 1, 3))
                month = F.array_position(F.array(*[F.lit(m[0]) for m in MONTHS]), short).cast("int")
        return F.when(c.rlike(rx), rolled_date(year, month, day))
