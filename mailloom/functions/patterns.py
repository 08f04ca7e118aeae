"""Search patterns: literals, templates, globs and ignore rules, resolved once on the driver.

A resolved pattern is a small frozen value; :meth:`Pattern.found_in` turns it into a Column with a
literal regex, which Spark compiles once per task.
"""

from __future__ import annotations

import datetime as dt
import re
from dataclasses import dataclass

from pyspark.errors import PySparkException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.dates import placeholder_values
from mailloom.functions.text import as_col, icontains, java_regex

_TEMPLATE = re.compile(r"\{\{(.*?)\}\}", re.DOTALL)
_LONE_BRACE = re.compile(r"\\.|\{\d+(?:,\d*)?\}|([{}])", re.DOTALL)


@dataclass(frozen=True)
class Pattern:
    """``kind`` is ``text`` (substring) or ``regex`` (search); both ignore case."""

    kind: str
    value: str

    def found_in(self, c: Column | str) -> Column:
        if self.kind == "text":
            return icontains(c, self.value)
        source = _LONE_BRACE.sub(lambda m: "\\" + m[1] if m[1] else m[0], self.value)
        return F.coalesce(as_col(c), F.lit("")).rlike(java_regex(source, ignore_case=True))


def template_pattern(source: str | None, ref_date: dt.date) -> Pattern | None:
    """Resolve ``text {{ regex }} {{ dates.x }}``; empty input gives None, which matches all."""
    if not source:
        return None
    if "{{" not in source:
        return Pattern("text", source)
    values = placeholder_values(ref_date)
    regex, plain, at = [], [], 0
    for m in _TEMPLATE.finditer(source):
        literal, expr = source[at : m.start()], m[1].strip()
        resolved = values.get(expr, expr)
        regex += [re.escape(literal), re.escape(resolved) if expr in values else expr]
        plain += [literal, resolved]
        at = m.end()
    regex.append(re.escape(source[at:]))
    plain.append(source[at:])
    found = Pattern("regex", "".join(regex))
    return found if _runs(found) else Pattern("text", "".join(plain))


def _runs(pattern: Pattern) -> bool:
    """Does the engine that will run the pattern take it? Evaluated on one literal row by the optimizer, without a job."""
    try:
        SparkSession.active().sql("values ('')").select(pattern.found_in(F.col("col1"))).head()
    except PySparkException:
        return False
    return True


def glob_pattern(source: str) -> Pattern:
    """``*`` and ``?`` wildcards over the whole value."""
    body = "".join({"*": ".*", "?": "."}.get(ch, re.escape(ch)) for ch in source)
    return Pattern("regex", f"^{body}$")


def ignore_pattern(source: str, ref_date: dt.date) -> Pattern | None:
    """The form used by ignore rules: template, else glob, else plain text."""
    source = re.sub(r"^[\"']|[\"']$", "", source)
    if "{{" not in source and re.search(r"[*?]", source):
        return glob_pattern(source)
    return template_pattern(source, ref_date)


def matches(c: Column | str, pattern: Pattern | None) -> Column:
    """Pattern test in which no pattern means true."""
    return F.lit(True) if pattern is None else pattern.found_in(c)


@dataclass(frozen=True)
class IgnoreRule:
    """Any of ``patterns`` found in ``field`` drops the row."""

    field: str
    patterns: tuple[Pattern | None, ...]


# Other names of the attachment field.
FIELD_ALIASES = {"attachments": "attachment", "att": "attachment"}


def ignore_rule(field: str, *sources: str, ref_date: dt.date) -> IgnoreRule:
    field = field.strip().lower()
    return IgnoreRule(
        FIELD_ALIASES.get(field, field), tuple(ignore_pattern(s.strip(), ref_date) for s in sources)
    )


_RULE = re.compile(r"(\w+)\s*=\s*(\[[^\]]*\]|\"[^\"]*\"|'[^']*'|[^\s,\]]+)")


def ignore_rules(text: str, ref_date: dt.date) -> list[IgnoreRule]:
    """Read ``field=value``, ``field=[a, b]`` or ``[field=value, field=value]``."""
    rules = []
    bracketed = re.fullmatch(r"\s*\[(.+)\]\s*", text, re.DOTALL)
    if bracketed:
        pairs = _RULE.findall(bracketed[1])
    else:
        field, eq, value = text.partition("=")
        pairs = [(field, value)] if eq and field else []
    for field, value in pairs:
        value = re.sub(r"^[\"']|[\"']$", "", value)
        listed = re.fullmatch(r"\[(.+)\]", value, re.DOTALL)
        sources = listed[1].split(",") if listed else [value]
        rules.append(ignore_rule(field, *sources, ref_date=ref_date))
    return rules


def ignored(c: Column | str, field: str, rules: list[IgnoreRule]) -> Column:
    """True when any rule for ``field`` hits; rules for other fields are left out."""
    hit = F.lit(False)
    for rule in rules:
        if rule.field == field:
            for pattern in rule.patterns:
                hit = hit | matches(c, pattern)
    return hit
