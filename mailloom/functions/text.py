"""String primitives with the whitespace, boundary and case rules of the mail tool being matched.

Its regular expressions differ from Java's in four ways that change results: ``$`` never matches
before a final newline, ``\\s`` covers every Unicode space, ``\\b`` looks at ASCII word characters
only, and case folding is not limited to ASCII. :func:`java_regex` turns a pattern written with
those rules into the Java pattern that Spark runs.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters counted as white space.
WHITESPACE = (
    "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000\ufeff"
)
# The same set as the inside of a Java character class, with and without the newline.
WS = r"\t-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_WS = r"\t\x0B-\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"

_ESCAPES = {
    "s": (f"[{WS}]", WS),
    "S": (f"[^{WS}]", f"\\t-\\r&&[^{WS}]"),
    "b": (r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))", r"\x08"),
}
_TOKEN = re.compile(r"\\(?P<esc>.)|(?P<open>\[\^?)|(?P<close>\])|(?P<end>\$)", re.DOTALL)
# What follows a boundary in front of a word; anything else ends a word.
_WORD_AHEAD = re.compile(r"\w|[(\[]|\\[dw]")


def java_regex(pattern: str, ignore_case: bool = False, word_edges: bool = False) -> str:
    """Rewrite ``\\s``, ``\\S``, ``\\b`` and ``$`` so that Java agrees with the matched rules.

    ``word_edges`` promises that every ``\\b`` touches a word character of the pattern itself, so
    that looking at one side is enough; this is much faster.
    """
    in_class = False

    def rewrite(m: re.Match[str]) -> str:
        nonlocal in_class
        if m["esc"]:
            if word_edges and m["esc"] == "b" and not in_class:
                return r"(?<!\w)" if _WORD_AHEAD.match(pattern, m.end()) else r"(?!\w)"
            pair = _ESCAPES.get(m["esc"])
            return pair[in_class] if pair else m[0]
        if m["open"]:
            literal = in_class
            in_class = True
            return "\\[" + m[0][1:] if literal else m[0]
        if m["close"]:
            in_class = False
            return m[0]
        return m[0] if in_class else r"\z"

    flags = ("(?i)" if pattern.isascii() else "(?iu)") if ignore_case else ""
    return flags + _TOKEN.sub(rewrite, pattern)


def words_regex(pattern: str, ignore_case: bool = False) -> str:
    """Java form of one of the library's own patterns, whose boundaries all touch a word."""
    return java_regex(pattern, ignore_case, word_edges=True)


def any_of(*patterns: str, ignore_case: bool = False) -> str:
    """One Java pattern that finds what any of the given library patterns would find.

    A boundary that all of them start with is tested once.
    """
    if all(p.startswith(r"\b") for p in patterns):
        joined = r"\b(?:" + "|".join(f"(?:{p[2:]})" for p in patterns) + ")"
    else:
        joined = "|".join(f"(?:{p})" for p in patterns)
    return words_regex(joined, ignore_case)


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` refers to it.

    A lambda variable is bound to the value; repeating the expression inside another lambda would
    compute it again for every array element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


# A noncharacter: never part of text that is exchanged.
CUT = "\uffff"


def split_at(c: Column, pattern: str) -> Column:
    """Split at a Java pattern. The pattern is compiled once per task, not once per row.

    Spark's ``split`` compiles its pattern for every row unless it is a single plain character,
    so the cuts are marked with one first.
    """
    return F.split(F.regexp_replace(F.regexp_replace(c, CUT, ""), pattern, CUT), CUT)


def trim_ws(c: Column | str) -> Column:
    """Strip every kind of white space from both ends; linear time, no regex."""
    return F.btrim(as_col(c), F.lit(WHITESPACE))


def has_text(c: Column | str) -> Column:
    """True when something other than white space is present; null counts as blank."""
    return F.coalesce(F.length(trim_ws(c)) > 0, F.lit(False))


def blank_to_null(c: Column | str) -> Column:
    return F.when(has_text(c), as_col(c))


def icontains(c: Column | str, needle: str) -> Column:
    """Case-insensitive substring test; null is treated as the empty string."""
    return F.contains(F.lower(F.coalesce(as_col(c), F.lit(""))), F.lit(needle.lower()))


def find(c: Column | str, pattern: str, group: int = 0) -> Column:
    """First match of a Java pattern, or null when it does not match."""
    c = as_col(c)
    return F.when(c.rlike(pattern), F.regexp_extract(c, pattern, group))


def hinted(text: Column, words: tuple[str, ...], pattern: str) -> Column:
    """``text.rlike(pattern)`` for a pattern that cannot match without one of the words.

    The substring tests are several times cheaper than the pattern and settle most texts.
    """
    return reduce(Column.__or__, (F.contains(text, F.lit(w)) for w in words)) & text.rlike(pattern)


def preview(c: Column | str, length: int = 200, always: bool = False) -> Column:
    """First ``length`` characters and ``...``; short text stays as is unless ``always``."""
    c = as_col(c)
    cut = F.concat(F.substring(c, 1, length), F.lit("..."))
    return cut if always else F.when(F.length(c) > length, cut).otherwise(c)
