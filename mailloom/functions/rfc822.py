"""Raw messages as column expressions: header blocks, parameters, transfer encodings, charsets, dates and the part tree.

A raw message is bytes. All work is done on its Latin-1 reading, in which every character is one byte, so texts of any
charset and binary parts pass through string functions unharmed and become bytes again at the end.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import CUT, let

LATIN = "ISO-8859-1"
#: Length of a substring that goes to the end.
BIG = 2**31 - 1
_WRONG_CUT = "\ufffe"
# Zones that dates may name, in minutes from UTC; any other name counts as UTC.
ZONES = {"est": -300, "edt": -240, "cst": -360, "cdt": -300, "mst": -420, "mdt": -360, "pst": -480, "pdt": -420}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: Charsets of one byte a character; their upper halves are read from the codecs of Python on the driver.
ONE_BYTE = (
    *(f"iso-8859-{n}" for n in (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 13, 14, 15, 16)),
    *(f"windows-125{n}" for n in range(9)), "koi8-r", "koi8-u",
)
_UTF8 = ("", "utf-8", "utf8", "us-ascii", "ascii", "unknown-8bit")
_DATE = (
    r"^\s*(?:[A-Za-z]{3,9}\s*,?\s*)?(\d{1,2})[ -]+([A-Za-z]{3})[a-z]*[ -]+(\d{4}|\d{2})\s+"
    r"(\d{1,2}):(\d{2})(?::(\d{2}))?\s*([+-]\d{4}|[A-Za-z]{1,5})?"
)


def latin(raw: Column, is_binary: bool) -> Column:
    """Bytes (or a text in UTF-8) as characters of one byte each."""
    return F.decode(raw if is_binary else F.encode(raw, "UTF-8"), LATIN)


def to_bytes(c: Column) -> Column:
    return F.encode(c, LATIN)


def head_and_body(entity: Column) -> Column:
    """``struct(head, body)`` cut at the first blank line; folded header lines are joined, their blanks kept.

    Plain searches only: a pattern would step through the text.
    """

    def cut(text: Column) -> Column:
        short, long = F.substring_index(text, "\n\n", 1), F.substring_index(text, "\n\r\n", 1)
        return let(F.struct(F.length(short).alias("s"), F.length(long).alias("l"), short.alias("short"), long.alias("long")), lambda x: F.struct(
            _unfolded(F.when(x["s"] <= x["l"], x["short"]).otherwise(x["long"])).alias("head"),
            F.when(x["s"] < x["l"], F.substring(text, x["s"] + 3, BIG)).when(x["s"] > x["l"], F.substring(text, x["l"] + 4, BIG)).otherwise("").alias("body")))

    return let(F.concat(F.lit("\n"), entity), cut)


def _unfolded(head: Column) -> Column:
    lines = F.rtrim(F.replace(head, F.lit("\r\n"), F.lit("\n")), F.lit("\r"))
    return F.replace(F.replace(lines, F.lit("\n "), F.lit(" ")), F.lit("\n\t"), F.lit("\t"))


def header_lines(head: Column) -> Column:
    """``array<struct<name, value>>`` of a joined header block, names in lower case."""
    lines = F.filter(F.split(head, "\n"), lambda x: F.locate(":", x) > 1)
    return F.transform(lines, lambda x: F.struct(
        F.lower(F.rtrim(F.substring_index(x, ":", 1), F.lit(" \t"))).alias("name"),
        F.btrim(F.substring(x, F.locate(":", x) + 1, BIG), F.lit(" \t\r")).alias("value")))


def field(head: Column, name: str) -> Column:
    """First value of a header in a joined block; empty without it."""
    return F.regexp_extract(head, rf"(?im)^{re.escape(name)}[ \t]*:[ \t]*([^\n]*)", 1)


def parameter(value: Column, name: str) -> Column:
    """A parameter of a header value, quoted or not; empty without it."""
    both = F.regexp_extract(value, rf'(?i)[; \t]{name}[ \t]*=[ \t]*("[^"]*"|[^; \t"]*)', 1)
    return F.when(F.contains(value, F.lit(";")), F.btrim(both, F.lit('"'))).otherwise("")


def long_parameter(value: Column, name: str) -> Column:
    """A parameter, also in its extended forms: in numbered pieces, and with percent signs and a charset (read as UTF-8)."""
    pieces = F.regexp_extract_all(value, F.lit(rf'(?i)[; \t]{name}\*(?:\d+\*?)?[ \t]*=[ \t]*("[^"]*"|[^; \t"]*)'), F.lit(1))
    joined = F.array_join(F.transform(pieces, lambda x: F.btrim(x, F.lit('"'))), "")
    text = F.regexp_replace(joined, r"^[A-Za-z0-9_-]*'[A-Za-z-]*'", "")
    extended = F.when(F.contains(value, F.lit("*")), F.nullif(percent_decoded(text), F.lit("")))
    return F.coalesce(extended, F.nullif(parameter(value, name), F.lit("")))


def _hex_decoded(text: Column, sign: str) -> Column:
    """The characters that ``sign`` and two hex digits stand for; a sign without digits stays."""

    def piece(x: Column, i: Column) -> Column:
        code = F.char(F.conv(F.substring(x, 1, 2), 16, 10).cast("int"))
        decoded = F.concat(code, F.substring(x, 3, BIG))
        return F.when(i == 0, x).when(x.rlike("^[0-9A-Fa-f]{2}"), decoded).otherwise(F.concat(F.lit(sign), x))

    return F.when(F.contains(text, F.lit(sign)), F.array_join(F.transform(F.split(text, sign), piece), "")).otherwise(text)


def percent_decoded(text: Column) -> Column:
    return _hex_decoded(text, "%")


def quoted_printable(text: Column) -> Column:
    return _hex_decoded(F.regexp_replace(text, r"=[ \t]*\r?\n", ""), "=")


def base64_bytes(text: Column) -> Column:
    """What base64 letters stand for; other signs are skipped, and so is a last letter that makes no byte."""
    letters = F.regexp_replace(text, "[^A-Za-z0-9+/]", "")
    return let(letters, lambda x: F.unbase64(F.substring(x, F.lit(1), F.length(x) - F.when(F.length(x) % 4 == 1, 1).otherwise(0))))


def content_bytes(body: Column, encoding: Column) -> Column:
    """A part's bytes without its transfer encoding; an unknown encoding leaves them as they are."""
    return (
        F.when(encoding == "base64", base64_bytes(body))
        .when(encoding == "quoted-printable", to_bytes(quoted_printable(body)))
        .otherwise(to_bytes(body))
    )


def utf8_text(content: Column) -> Column:
    """Bytes read as UTF-8, wrong ones as U+FFFD."""
    return F.make_valid_utf8(content.cast("string"))


def is_plain_charset(charset: Column) -> Column:
    """True if :func:`charset_text` reads it."""
    return charset.isin(*_UTF8, "iso-8859-1", "latin1", *ONE_BYTE)


def charset_text(content: Column, charset: Column) -> Column:
    """Bytes in UTF-8 or in a charset of one byte a character as text; unknown charsets are read as UTF-8."""
    upper = "".join(map(chr, range(128, 256)))
    out = F.when(charset.isin("iso-8859-1", "latin1"), F.decode(content, LATIN))
    for name in ONE_BYTE:
        own = bytes(range(128, 256)).decode(name, "replace")
        out = out.when(charset == name, F.translate(F.decode(content, LATIN), upper, own))
    return out.otherwise(utf8_text(content))


def sent_at(date: Column) -> Column:
    """A ``Date`` header in UTC, without zone; null if it names no time. A date without a zone is taken as UTC."""
    fields = F.split(F.regexp_replace(date, f"{_DATE}.*", "$1/$2/$3/$4/$5/$6/$7"), "/")
    return let(F.when(date.rlike(_DATE), fields), _at)


def _at(fields: Column) -> Column:
    day, month, year, hour, minute, second, zone = (F.get(fields, F.lit(i)) for i in range(7))
    number = year.try_cast("int")
    full = F.when(F.length(year) == 4, number).when(number <= 68, number + 2000).otherwise(number + 1900)
    at = F.array_position(F.array(*map(F.lit, MONTHS)), F.lower(month)).cast("int")
    seconds = F.coalesce(second.try_cast("int"), F.lit(0)).cast("decimal(8,6)")
    local = F.try_make_timestamp_ntz(full, at, day.try_cast("int"), hour.try_cast("int"), minute.try_cast("int"), seconds)
    sign = F.when(F.startswith(zone, F.lit("-")), -1).otherwise(1)
    offset = F.when(zone.rlike("^[+-]"), sign * (F.substring(zone, 2, 2).try_cast("int") * 60 + F.substring(zone, 4, 2).try_cast("int")))
    for name, minutes in ZONES.items():
        offset = offset.when(F.lower(zone) == name, F.lit(minutes))
    return local - F.make_dt_interval(F.lit(0), F.lit(0), offset.otherwise(F.lit(0)), F.lit(0))


def _entity(text: Column) -> Column:
    def typed(e: Column) -> Column:
        return let(field(e["head"], "content-type"), lambda t: F.struct(
            e["head"].alias("head"), e["body"].alias("body"),
            F.when(F.startswith(F.lower(t), F.lit("multipart/")), parameter(t, "boundary")).otherwise("").alias("boundary")))

    return let(head_and_body(text), typed)


def _children(entity: Column) -> Column:
    """The entities of a multipart one. Text after the closing line is left out, and so is text before the first line, unless
    no line is a delimiter: then all of it is one plain part."""
    line = F.concat(F.lit("\n--"), entity["boundary"])

    def entities(pieces: Column) -> Column:
        close = F.array_position(F.transform(pieces, lambda p: F.startswith(p, F.lit("--"))), F.lit(True))
        inner = F.slice(pieces, F.lit(2), F.when(close > 0, close - 2).otherwise(F.size(pieces) - 1).cast("int"))
        texts = F.transform(inner, lambda p: F.when(F.contains(p, F.lit("\n")), F.substring(
            p, F.locate("\n", p) + 1, F.length(p) - F.locate("\n", p) - F.endswith(p, F.lit("\r")).cast("int"))).otherwise(""))
        return F.when(F.size(pieces) == 1, F.array(F.concat(F.lit("\n"), entity["body"]))).otherwise(texts)

    marked = F.replace(F.concat(F.lit("\n"), entity["body"]), line, F.lit(CUT))
    # A longer line that only begins like this boundary is put back.
    wrong = F.regexp_replace(marked, rf"{CUT}(?!(?:--)?[ \t]*(?:\r?\n|\r?\z))", _WRONG_CUT)
    return F.transform(let(F.split(F.replace(wrong, F.lit(_WRONG_CUT), line), CUT), entities), _entity)


def leaves(message: Column) -> Column:
    """``array<struct<head, body, boundary>>`` of a message's parts that hold no others, in order.

    Every step opens the multipart entities one level deeper; a message has no more levels than boundaries.
    """
    word = "boundary"
    steps = F.length(message) - F.length(F.replace(F.lower(message), F.lit(word), F.lit(word[1:])))
    levels = let(steps, lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")))

    def opened(parts: Column, _: Column) -> Column:
        deeper = F.flatten(F.transform(parts, lambda e: F.when(e["boundary"] != "", _children(e)).otherwise(F.array(e))))
        return F.when(F.exists(parts, lambda e: e["boundary"] != ""), deeper).otherwise(parts)

    return F.when(message.isNotNull(), F.aggregate(levels, F.array(_entity(message)), opened))


def part(leaf: Column) -> Column:
    """What a leaf's header block says, and its bytes."""

    def described(h: Column) -> Column:
        named = F.btrim(F.substring_index(h["type"], ";", 1), F.lit(" \t\r"))
        kind = F.when(F.contains(named, F.lit("/")), named).otherwise("text/plain")
        name = F.coalesce(long_parameter(h["shown"], "filename"), long_parameter(h["kind"], "name"))
        return F.struct(
            F.substring_index(kind, "/", 1).alias("type"), F.substring_index(kind, "/", -1).alias("subtype"),
            F.nullif(F.lower(F.btrim(F.substring_index(h["shown"], ";", 1), F.lit(" \t\r"))), F.lit("")).alias("disposition"),
            utf8_text(to_bytes(name)).alias("name"), F.lower(parameter(h["kind"], "charset")).alias("charset"),
            content_bytes(leaf["body"], h["encoding"]).alias("content"),
        )

    kind = field(leaf["head"], "content-type")
    return let(F.struct(
        kind.alias("kind"), F.lower(kind).alias("type"), field(leaf["head"], "content-disposition").alias("shown"),
        F.lower(F.btrim(field(leaf["head"], "content-transfer-encoding"), F.lit(" \t\r"))).alias("encoding")), described)
