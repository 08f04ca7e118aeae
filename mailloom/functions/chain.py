"""Reply-chain functions: divider detection, splitting, classification and narrowing.

A chain is split inside the row into an array of segments (0 = newest), so that no operator here
needs a shuffle; explode the array only to get one row per segment.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import LINE_WS, any_of, as_col, has_text, hinted, java_regex, let, split_at, trim_ws, words_regex

# Header names that may follow a divider.
HEADER_NAMES = ("from", "sent", "to", "subject", "date", "cc")

# What counts as a date range in a segment.
DATE_RANGE_PATTERNS = (
    r"\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}\s+to\s+\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4}",
    r"(?:from|between)\s+\d{1,2}[\/\-]\d{1,2}",
    r"\b(?:last|past|previous|prior)\s+\d+\s*(?:month|week|day|year)",
    r"\b(?:after|since|before)\s+\d{1,2}[\/\-]\d{1,2}",
    r"\d{1,2}[\/\-]\d{1,2}[\/\-]\d{4}",
    r"\d{1,2}\/\d{1,2}-\d{1,2}\/\d{1,2}",
)

# Segment types, most important first, and the wording that reveals them.
ATTACHMENT_RECEIVED = "attachment-received"
SEND_DATA = "send-data"
DID_YOU_RECEIVE = "did-you-receive"
BOOLEAN_RESPONSE = "boolean"
UNCLASSIFIED = "unclassified"
TYPE_PRIORITY = (ATTACHMENT_RECEIVED, SEND_DATA, DID_YOU_RECEIVE, BOOLEAN_RESPONSE, UNCLASSIFIED)
ATTACHMENT_PATTERNS = (
    r"\battach(ed|ment|ments)\b",
    r"\bstatements?\b",
    r"\bfiles?\s+(are\s+)?attached\b",
    r"\bplease\s+find\s+(the\s+)?attach",
    r"\b(enclosed|included|sending)\b.{0,40}\b(files?|docs?|documents?|statements?)\b",
)
CHASE_PATTERNS = (
    r"\b(just\s+wondering|was\s+wondering)\b",
    r"\bdid\s+you\s+(get|receive|see)\b",
    r"\bhave\s+you\s+(received|gotten|seen)\b",
    r"\b(checking\s+in|following\s+up)\b",
    r"\bany\s+update\b",
)
REQUEST_PATTERNS = (
    r"\b(would\s+you\s+be\s+able|could\s+you|can\s+you|please\s+send|i\s+need|looking\s+for|requesting)\b",
    r"\b(show\s+me|how\s+many|how\s+much|what\s+is|what\s+are)\b",
    r"\b(provide|supply|forward\s+me|email\s+me)\b.{0,60}\b(report|data|file|record|statement|document)\b",
)
BOOLEAN_PATTERNS = (
    r"\bare\s+you\s+(going|able|planning|available|coming)\b",
    r"\b(yes|no|confirmed?|denied?|correct|incorrect|agree|disagree)\b",
    r"\bwill\s+you\b",
    r"\bdo\s+you\s+(plan|intend|want)\b",
)

# Words without which the patterns above cannot match.
ATTACHMENT_HINTS = ("attach", "statement", "enclosed", "included", "sending")
CHASE_HINTS = ("wondering", "you", "checking", "following", "update")

# Thank-you wording, and wording that makes it a request after all.
THANKS_PATTERNS = (
    r"\bthank\s+you\b",
    r"\bthanks\b",
    r"\bthank\s+so\s+much\b",
    r"\breceived[.,]?\s*thanks\b",
    r"\bgot\s+it[.,]?\s*thanks\b",
    r"\bgreatly\s+appreciate\b",
    r"\bmuch\s+appreciated\b",
    r"\bappreciate\s+it\b",
)
FOLLOW_UP_PATTERNS = (
    r"\bcan\s+you\s+(?:also\s+)?(?:send|forward|provide|email)\b",
    r"\bcould\s+you\b",
    r"\bwould\s+you\b",
    r"\bplease\s+send\b",
    r"\bi\s+need\b",
    r"\balso\s+send\b",
    r"\bsend\s+(?:me|us|the)\b",
    r"\bforward\s+(?:me|us|the)\b",
    r"\bfrom\s+last\s+week\b",
    r"\bcan\s+you\s+also\b",
)

# A name alone on its line, and the contact lines that make it a signature.
NAME_LINE = r"[A-Z][a-zA-Z'.]+(?:\s+[A-Z][a-zA-Z'.]+){0,4}"
CONTACT_PATTERNS = (
    r"\d{3}[-.\s]?\d{3}[-.\s]?\d{4}",
    r"\b\d{1,5}\s+\w+\s+(?i:st|street|ave|avenue|rd|road|blvd|hwy|dr|drive|ln|lane|way)\b",
    r"\b[A-Z][a-z]+,?\s+[A-Z]{2}\.?\s+\d{5}\b",
)

_W = f"[{LINE_WS}]"
_NAMES = "(?:" + "|".join(HEADER_NAMES) + ")"
_HEADER = rf"{_W}*+(?i:{_NAMES}){_W}*+:[^\n]*+"
_DIVIDER = rf"(?<![^\n]){_W}*+-{{10,}}{_W}*+"
# Divider line, blank lines, at least one header line, then any blank or header lines. Possessive
# loops keep the matcher iterative, so a long run of blank lines cannot exhaust the stack.
_REAL_DIVIDER = (
    rf"{_DIVIDER}((?:\n{_W}*+(?=\n|\z))*+\n{_HEADER}(?:\n(?:{_HEADER}|{_W}*+)(?=\n|\z))*+)\n?"
)
# The chain test looks at seven lines past the dashes, so at most six of them may be blank.
_CHAINED = rf"{_DIVIDER}(?:\n{_W}*+(?=\n)){{0,6}}+\n{_W}*+(?i:{_NAMES}){_W}*+:"
_CID_LINE = rf"^{_W}*\[cid:[^\]]*\]{_W}*\z"


def _one_line(pattern: str) -> str:
    """White space in the pattern must not cross into the next line."""
    return words_regex(pattern).replace(java_regex(r"\s"), _W).replace(java_regex(r"[\s]")[1:-1], LINE_WS)


_SIGNATURE = (
    rf"(?s)(?<![^\n]){_W}*(?-s:{_one_line(NAME_LINE)}){_W}*(?=\n)"
    rf"(?=(?:\n[^\n]*+){{0,3}}?\n[^\n]*?(?:{'|'.join(_one_line(p) for p in CONTACT_PATTERNS)})).*"
)


def _unix_lines(c: Column) -> Column:
    return F.replace(c, F.lit("\r\n"), F.lit("\n"))


def is_chained(c: Column | str) -> Column:
    """A line of ten or more dashes whose next non-blank line is a mail header."""
    return F.coalesce(_unix_lines(as_col(c)).rlike(_CHAINED), F.lit(False))


def segment_bodies(c: Column | str) -> Column:
    """Trimmed body of each segment, newest first; null or empty text has no segments."""
    c = as_col(c)
    parts = F.transform(split_at(_unix_lines(c), _REAL_DIVIDER), trim_ws)
    return F.when(F.length(c) > 0, parts).otherwise(F.array().cast("array<string>"))


def _header_value(block: Column, name: str) -> Column:
    lines = F.regexp_extract_all(block, F.lit(rf"\n{_W}*+(?i:{name}){_W}*+:([^\n]*+)"), 1)
    return trim_ws(F.try_element_at(lines, F.lit(-1)))


def split_chain(c: Column | str) -> Column:
    """``array<struct<index, headers, body>>``; a header given twice keeps its last value."""
    c = F.coalesce(as_col(c), F.lit(""))
    blocks = F.regexp_extract_all(_unix_lines(c), F.lit(_REAL_DIVIDER), 1)
    pairs = F.arrays_zip(
        segment_bodies(c).alias("body"), F.concat(F.array(F.lit("")), blocks).alias("block")
    )

    def segment(p: Column, i: Column) -> Column:
        entries = [x for n in HEADER_NAMES for x in (F.lit(n), _header_value(p["block"], n))]
        headers = F.map_filter(F.create_map(*entries), lambda _, v: v.isNotNull())
        return F.struct(i.alias("index"), headers.alias("headers"), p["body"].alias("body"))

    return F.transform(F.filter(pairs, lambda p: p["body"].isNotNull()), segment)


def has_date_range(c: Column | str) -> Column:
    """Any date or date range wording; all but the relative one need digits around a separator."""
    c = as_col(c)
    relative, absolute = DATE_RANGE_PATTERNS[2], DATE_RANGE_PATTERNS[:2] + DATE_RANGE_PATTERNS[3:]
    dated = c.rlike(r"\d[/\-]\d") & c.rlike(any_of(*absolute, ignore_case=True))
    return F.coalesce(dated | c.rlike(any_of(relative, ignore_case=True)), F.lit(False))


def remove_cid_lines(c: Column | str) -> Column:
    """Drop lines that are only an inline image reference."""
    lines = F.split(_unix_lines(as_col(c)), "\n")
    return F.array_join(F.filter(lines, lambda line: ~line.rlike(_CID_LINE)), "\n")


def classify(c: Column | str) -> Column:
    """Segment type by wording; the first type in this order of tests wins."""

    def by_wording(text: Column) -> Column:
        question = F.contains(text, F.lit("?")) & ~text.rlike(any_of(r"\battach"))
        return (
            F.when(~has_text(text), UNCLASSIFIED)
            .when(hinted(text, ATTACHMENT_HINTS, any_of(*ATTACHMENT_PATTERNS)), ATTACHMENT_RECEIVED)
            .when(hinted(text, CHASE_HINTS, any_of(*CHASE_PATTERNS)), DID_YOU_RECEIVE)
            .when(text.rlike(any_of(*REQUEST_PATTERNS)), SEND_DATA)
            .when(question & text.rlike(any_of(*BOOLEAN_PATTERNS)), BOOLEAN_RESPONSE)
            .otherwise(UNCLASSIFIED)
        )

    return let(F.lower(as_col(c)), by_wording)


def type_counts(types: Column | str) -> Column:
    """Types array to ``array<struct<type, n>>``, types that occur only, by priority."""
    types = as_col(types)
    counted = [
        F.struct(
            F.lit(t).alias("type"), F.size(F.filter(types, lambda x: x == t)).cast("bigint").alias("n")
        )
        for t in TYPE_PRIORITY
    ]
    return F.filter(F.array(*counted), lambda x: x["n"] > 0)


def dominant_type(types: Column | str) -> Column:
    """Most frequent type; a tie goes to the higher priority."""
    best = F.aggregate(
        let(as_col(types), type_counts),
        F.struct(F.lit(UNCLASSIFIED).alias("type"), F.lit(0).cast("bigint").alias("n")),
        lambda acc, x: F.when(x["n"] > acc["n"], x).otherwise(acc),
    )
    return best["type"]


def _first(bodies: Column, test) -> Column:
    return F.get(F.filter(bodies, test), F.lit(0))


def best_segment(bodies: Column | str, prefer: str = "latest") -> Column:
    """First body with a date range (last one for ``prefer='earliest'``), else first with text."""


    def best(bodies: Column) -> Column:
        ordered = F.reverse(bodies) if prefer == "earliest" else bodies
        return F.coalesce(_first(ordered, has_date_range), _first(bodies, has_text))

    return let(as_col(bodies), best)


def narrow_to_dominant(bodies: Column | str, types: Column | str, dominant: Column | str) -> Column:
    """Bodies of the dominant type joined by a blank line; all non-empty ones if none has text."""
    pairs = F.arrays_zip(as_col(bodies).alias("body"), as_col(types).alias("type"))

    def joined(chosen: Column) -> Column:
        return F.when(F.size(chosen) > 0, F.array_join(F.transform(chosen, lambda p: p["body"]), "\n\n"))

    def narrowed(filled: Column) -> Column:
        chosen = F.filter(filled, lambda p: p["type"] == as_col(dominant))
        return F.coalesce(let(chosen, joined), joined(filled))

    return let(F.filter(pairs, lambda p: has_text(p["body"])), narrowed)


def narrow_by_task(bodies: Column | str, pattern: str | None, narrow_by: str = "date-range") -> Column:
    """Lowest-index segment for a task, or null when there is none.

    ``date-range`` and ``file-name:x`` search the segments that contain ``pattern``; ``raw-data``
    searches those that do not. An empty pool falls back to all segments.
    """
    kind = (narrow_by or "date-range").lower().strip()

    def own(b: Column) -> Column:
        return F.contains(F.lower(b), F.lit(pattern.lower())) if pattern else F.lit(True)

    def wanted(b: Column) -> Column:
        if kind.startswith("file-name:"):
            return F.contains(F.lower(b), F.lit(kind.removeprefix("file-name:").strip()))
        return has_date_range(b)

    def pool_or(pool: Column, otherwise: Column) -> Column:
        return let(pool, lambda p: F.when(F.size(p) > 0, p).otherwise(otherwise))

    def from_responder(bodies: Column) -> Column:
        pool = pool_or(F.filter(bodies, lambda b: ~own(b) & has_text(b)), F.filter(bodies, has_text))
        return let(
            pool,
            lambda p: F.coalesce(
                _first(p, lambda b: classify(b) == ATTACHMENT_RECEIVED), F.get(p, F.lit(0))
            ),
        )

    def from_requester(bodies: Column) -> Column:
        return let(
            pool_or(F.filter(bodies, own), bodies),
            lambda p: F.coalesce(_first(p, wanted), best_segment(p), best_segment(bodies)),
        )

    return let(as_col(bodies), from_responder if kind.startswith("raw-data") else from_requester)


def message_content(c: Column | str) -> Column:
    """Text before the signature: a name line with a phone or address in its next four lines."""
    return trim_ws(remove_cid_lines(F.regexp_replace(_unix_lines(as_col(c)), _SIGNATURE, "")))


def is_thank_you(c: Column | str) -> Column:
    """Short thanks without a further request, at most three sentences."""
    c = as_col(c)

    def short_thanks(content: Column) -> Column:
        sentences = F.regexp_count(content, F.lit(java_regex(r"[^.!?\s][^.!?]*")))
        return (
            content.rlike(any_of(*THANKS_PATTERNS, ignore_case=True))
            & ~content.rlike(any_of(*FOLLOW_UP_PATTERNS, ignore_case=True))
            & (sentences <= 3)
        )

    # Every phrase contains one of these, and the content is part of the text.
    lowered = F.lower(c)
    worth_a_look = F.contains(lowered, F.lit("thank")) | F.contains(lowered, F.lit("appreciate"))
    one_line = F.regexp_replace(message_content(c), rf"\n(?:{_W}*\n)*", " ")
    return F.coalesce(worth_a_look & let(one_line, short_thanks), F.lit(False))


def newest_text_segment(bodies: Column | str) -> Column:
    """The first of the two newest segments that has text besides image references."""
    return _first(F.slice(as_col(bodies), 1, 2), lambda b: has_text(remove_cid_lines(b)))
