"""HTML to text, tables and elements as built-in string and array expressions.

Everything stays inside the row: a page is read once, no explode and no shuffle is needed unless
the caller asks for one row per cell or element.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions.text import as_col, let, split_at, trim_ws

# Entities decoded in the cells of columnar tables, one after the other.
CELL_ENTITIES = {"&nbsp;": " ", "&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'"}
# Elements whose content is never text, elements without content, and block elements.
HIDDEN_TAGS = ("script", "style", "head", "noscript")
VOID_TAGS = (
    "img", "br", "hr", "input", "wbr", "col", "area", "base", "embed", "source", "track", "meta", "link",
)
BLOCK_TAGS = ("p", "div", "section", "article", "header", "footer", "main", "nav", "aside", "form")
WIDE_BLOCK_TAGS = ("h1", "h2", "ul", "ol", "blockquote", "pre", "h4", "h5", "h6")
# The line of a rule, elements in capitals, and the digits of Roman numbers.
RULE_LINE = "-" * 40
CAPITAL_TAGS = ("h4", "h5", "h6")
ROMAN = (
    ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"),
    ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"),
    ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"),
)

_HIDDEN = r"(?is)<(?:!--.*?-->|(" + "|".join(HIDDEN_TAGS) + r")(?:\s[^>]*)?>.*?</\1\s*>)"
_VOID = r"(?i)<(?:" + "|".join(VOID_TAGS) + r")(?:\s[^>]*)?/?>"
_SPACES = r"[ \t\r\f\x{200b}]+"
# Control characters that stand for one line break, a blank line, and a forced line break.
_BREAK, _GAP, _FORCED = "\x01", "\x02", "\x03"
# A space that stays, the ends of an item's label, and the ends of text in capitals.
_PAD, _LABEL, _LABELLED, _UPPER, _LOWER = "\x05", "\x0e", "\x0f", "\x06", "\x07"

# Tags that need a look of their own only where a page has one of them.
_LISTS = r"(?i)</?(?:ol|ul|li)[\s/>]"
_RARE = r"(?i)<(?:[bh]r|/?h[3-6])[\s/>]"
# Regular tables. Every "<" opens a tag that closes ahead of the next one, and there are no control characters of ours and no
# white space beyond Java's \s; once other tags are out, rows hold cells that close by their own tag, and nothing else.
# Long character classes are slow in Java, so only a character in the right range is looked up in one.
_ODD = r"[\x01-\x0f\u1680-\uffff](?<=[\x01-\x07\x0e\x0f\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff])"
_TAGGED = r"\A[^<]*+(?:<[^<>]++>[^<]*+)*+\z"
_OTHER_TAGS = r"<(?i)(?!t[rhd]|/t[rhd]>)[^>]++>"
_BLANKS = r"[ \t\n\x0B\f\r\xa0]++"
_OUTSIDE = r"[^<]*+(?:<thead[^>]*+>[^<]*+)*+"
_CELLS = r"(?:<t(?:d[^>]*+>[^<]*+</td>|h[^>]*+>[^<]*+</th>)[^<]*+)++"
_GRID = rf"(?i)\A{_OUTSIDE}(?:<tr[^>]*+>[^<]*+{_CELLS}</tr>{_OUTSIDE})++\z"


def _tags(names: tuple[str, ...], close: str = "/?") -> str:
    return f"(?i)<{close}(?:" + "|".join(names) + r")(?:\s[^>]*)?/?>"


def _replace(c: Column, pairs: list[tuple[str, str]]) -> Column:
    for pattern, value in pairs:
        c = F.regexp_replace(c, pattern, value)
    return c


def decode_cell_entities(c: Column) -> Column:
    for entity, char in CELL_ENTITIES.items():
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


def decode_entities(c: Column) -> Column:
    """Decode named (HTML 4) and numeric entities in one pass; unknown ones stay as they are."""
    named = F.create_map(*[F.lit(x) for name, code in name2codepoint.items() for x in (name, chr(code))])

    def decode(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^&(#?\w+);", 1)
        digits = F.regexp_extract(name, r"^#0*(\d+)$", 1)
        hexed = F.regexp_extract(name, r"^#[xX]0*([0-9a-fA-F]+)$", 1)
        number = F.when(digits != "", digits.try_cast("bigint"))
        number = F.coalesce(number, F.when((hexed != "") & (F.length(hexed) <= 8), F.conv(hexed, 16, 10).try_cast("bigint")))
        whole = number.between(1, 0x10FFFF) & ~number.between(0xD800, 0xDFFF)  # else no character: the text stays
        char = F.when(whole, F.decode(F.unhex(F.lpad(F.hex(F.when(whole, number)), 8, "0")), "UTF-32"))
        value = F.coalesce(F.try_element_at(named, name), char)
        rest = F.substring(piece, F.length(name) + 3, F.length(piece))
        return F.when((name != "") & value.isNotNull(), F.concat(value, rest)).otherwise(piece)

    pieces = split_at(c, r"(?=&#?\w+;)")
    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(pieces, decode), "")).otherwise(c)


def visible_html(c: Column | str) -> Column:
    """Markup without comments, scripts, styles and the head."""
    return F.regexp_replace(as_col(c), _HIDDEN, "")


def _counter(kind: Column, n: Column) -> Column:
    """``n`` as the list's type writes it: digits, letters or Roman digits; other types and numbers below 1 as digits."""

    def letter(i: Column) -> Column:
        return F.char((F.lit(97) + i % 26).cast("bigint"))

    letters = F.concat(F.when(n > 702, letter(F.floor((n - 703) / 676))).otherwise(""), F.when(n > 26, letter(F.floor((n - 27) / 26))).otherwise(""), letter(n - 1))
    digits = [F.get(F.array(*map(F.lit, row)), F.floor(n / 10**k).cast("int") % 10) for k, row in enumerate(ROMAN)]
    roman = F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), *digits[::-1])
    low = F.when(F.lower(kind) == "a", letters).when(F.lower(kind) == "i", roman)
    return F.coalesce(F.when((n > 0) & (n <= 18278), F.when(kind == F.upper(kind), F.upper(low)).otherwise(low)), n.cast("string"))


_LIST_STATE = (
    "struct<stack: array<struct<id: int, kind: string, next: bigint>>, n: int, "
    "out: array<struct<text: string, step: string, above: array<int>, label: string>>>"
)


def _list_step(state: Column, piece: Column) -> Column:
    """One list tag: ``stack`` holds the open lists, ``out`` what was read with the lists around it and an item's label."""
    stack, tag = state["stack"], piece["tag"]
    top, depth = F.get(stack, F.size(stack) - 1), F.size(stack)
    opened = F.array_append(stack, F.struct(state["n"].alias("id"), piece["kind"].alias("kind"), piece["start"].alias("next")))
    counted = F.concat(F.slice(stack, F.lit(1), depth - 1), F.array(F.struct(top["id"].alias("id"), top["kind"].alias("kind"), (top["next"] + 1).alias("next"))))
    opens, item, closes = tag.isin("ol", "ul"), tag == "li", tag.isin("/ol", "/ul") & (depth > 0)
    lead = F.when(depth > 1, "").otherwise(" ")
    label = F.when(item, F.when((depth == 0) | (top["kind"] == ""), F.concat(lead, F.lit("* "))).otherwise(F.concat(lead, _counter(top["kind"], top["next"]), F.lit(". "))))
    step = F.when(opens, F.when(depth > 0, _BREAK).otherwise(_GAP)).when(tag.isin("/ol", "/ul"), F.when(depth > 1, _BREAK).otherwise(_GAP))
    read = F.struct(piece["rest"].alias("text"), step.when(tag != "", _BREAK).otherwise("").alias("step"), F.transform(stack, lambda x: x["id"]).alias("above"), label.alias("label"))
    left = F.when(opens, opened).when(item & (depth > 0), counted).when(closes, F.slice(stack, F.lit(1), depth - 1)).otherwise(stack)
    return F.struct(left.alias("stack"), (state["n"] + opens.cast("int")).alias("n"), F.array_append(state["out"], read).alias("out")).cast(_LIST_STATE)


def _with_labels(c: Column) -> Column:
    """List tags to break marks and labels: bullets, or numbers by ``start`` and ``type``.

    A list inside another starts on the next line, indented by the labels around it; the labels of a list are as wide as its widest.
    Later lines of one item are not indented.
    """
    pieces = split_at(c, r"(?i)(?=</?(?:ol|ul|li)(?:\s[^>]*)?/?>)")

    def parse(p: Column) -> Column:
        tag = F.lower(F.regexp_extract(p, r"(?i)^<(/?(?:ol|ul|li))(?:\s[^>]*)?/?>", 1))
        whole = F.when(tag == "", "").otherwise(F.regexp_extract(p, r"^<[^>]*>", 0))
        start = F.regexp_extract(whole, r"(?i)\sstart\s*=\s*[\"']?(-?\d+)", 1).try_cast("bigint")
        kind = F.regexp_extract(whole, r"(?i)\stype\s*=\s*[\"']?([1ai])(?![^\s\"'>])", 1)
        return F.struct(
            tag.alias("tag"), F.substring(p, F.length(whole) + 1, F.length(p)).alias("rest"), F.coalesce(start, F.lit(1)).alias("start"),
            F.when(tag == "ol", F.when(kind == "", "1").otherwise(kind)).otherwise("").alias("kind"),
        )

    def laid_out(out: Column) -> Column:
        labelled = F.filter(out, lambda o: o["label"].isNotNull())

        def width(list_id: Column) -> Column:
            own = F.filter(labelled, lambda o: F.get(o["above"], F.size(o["above"]) - 1) == list_id)
            return F.coalesce(F.array_max(F.transform(own, lambda o: F.length(o["label"]))), F.lit(0))

        def text(o: Column) -> Column:
            depth = F.size(o["above"])
            outer = F.aggregate(F.slice(o["above"], F.lit(1), F.greatest(depth - 1, F.lit(0))), F.lit(0), lambda n, i: n + width(i))
            own = F.when(depth > 0, width(F.get(o["above"], depth - 1))).otherwise(3)
            padded = F.concat(F.repeat(F.lit(_PAD), outer), F.translate(F.rpad(o["label"], F.greatest(own, F.length(o["label"])), " "), " ", _PAD))
            marked = F.coalesce(F.concat(F.lit(_LABEL), padded, F.lit(_LABELLED)), F.lit(""))
            return F.concat(o["step"], marked, o["text"])

        return F.array_join(F.transform(out, text), "")

    start = F.expr("struct(array(), 0, array())").cast(_LIST_STATE)
    scanned = F.aggregate(F.transform(pieces, parse), start, _list_step, lambda state: state["out"])
    flat = _replace(
        c,
        [
            (_tags(("ul", "ol")), _GAP),
            (_tags(("li",), close=""), f"{_BREAK}{_LABEL}{_PAD}*{_PAD}{_LABELLED}"),
            (_tags(("li",), close="/"), _BREAK),
        ],
    )
    # Bullets on one level need no state; only numbers and nested lists are worth the scan. Many pages have no list.
    nested = r"(?i)<ol[\s/>]|<ul[\s/>][^<]*+(?:<(?!/?ul[\s/>])[^<]*+)*+<ul[\s/>]"
    return F.when(~c.rlike(_LISTS), c).when(c.rlike(nested), let(scanned, laid_out)).otherwise(flat)


def _fragment_text(c: Column) -> Column:
    """Tags to break marks; the marks are resolved once the fragments are joined again."""
    rare = [
        (r"(?i)<br(?:\s[^>]*)?/?>", _FORCED),
        (r"(?i)<hr(?:\s[^>]*)?/?>", f"{_GAP}{RULE_LINE}{_GAP}"),
        (_tags(CAPITAL_TAGS, close=""), f"{_GAP}{_UPPER}"),
        (_tags(CAPITAL_TAGS, close="/"), f"{_LOWER}{_GAP}"),
        (_tags(("h3",), close=""), _GAP),
    ]
    common = [(_tags(("h3", *BLOCK_TAGS)), _BREAK), (_tags(WIDE_BLOCK_TAGS), _GAP), (r"(?s)<[^>]*>", "")]
    single = F.regexp_replace(c, _SPACES, " ")
    return _replace(let(single, lambda t: F.when(t.rlike(_RARE), _replace(t, rare)).otherwise(t)), common)


def _regular(table: Column) -> Column:
    """A regular table with the tags of rows and cells only and single blanks; null for any other table.

    Cells of such a table need no cleaning one by one. White space and tags inside a cell go as :func:`row_cells` takes them.
    """
    bare = _replace(table, [(_OTHER_TAGS, ""), ("&nbsp;", " "), (_BLANKS, " ")])
    return let(F.when(table.rlike(_TAGGED) & ~table.rlike(_ODD), bare), lambda t: F.when(t.rlike(_GRID), t))


def _row_lines(table: Column) -> Column:
    """``| a | b |`` lines of one table; rows without cells are dropped. Spaces around the bars may be marks of kept spaces."""
    rows = F.filter(
        F.transform(
            table_rows(F.regexp_replace(table, f"{_LABEL}[^{_LABELLED}]*{_LABELLED}|[{_BREAK}{_GAP}]", "")),
            lambda row: row_cells(row, decode=False),
        ),
        lambda cells: F.size(cells) > 0,
    )
    any_table = F.array_join(
        F.transform(rows, lambda cells: F.concat(F.lit("| "), F.array_join(cells, " | "), F.lit(" |"))), "\n"
    )

    def lines(t: Column) -> Column:
        return _replace(
            t,
            [
                (r"(?i) ?</t[hd]>[^<]*+<t[hd][^>]*+> ?", f"{_PAD}|{_PAD}"),
                (rf"(?i) ?</t[hd]>[^<]*+</tr>{_OUTSIDE}", f"{_PAD}|"),
                (r"(?i)<tr[^>]*+>[^<]*+<t[hd][^>]*+> ?", f"\n|{_PAD}"),
                (r"\A[^\n]*+", ""),
            ],
        )

    return let(_regular(table), lambda t: F.coalesce(lines(t), any_table))


def _in_capitals(c: Column) -> Column:
    """Upper-case what stands between the marks; the text in front of the first mark stays."""
    cut = F.split(c, _UPPER)
    upper = F.transform(
        cut,
        lambda piece, i: F.when(i == 0, piece).otherwise(
            F.concat(F.upper(F.substring_index(piece, _LOWER, 1)), F.substring(piece, F.length(F.substring_index(piece, _LOWER, 1)) + 1, F.length(piece)))
        ),
    )
    return F.regexp_replace(F.when(F.contains(c, F.lit(_UPPER)), F.array_join(upper, "")).otherwise(c), _LOWER, "")


def html_to_text(c: Column | str) -> Column:
    """Readable text: line breaks for blocks, link text only, lists with labels, rules, tables as piped lines, no wrapping."""
    listed = let(F.regexp_replace(visible_html(c), f"[{_PAD}{_LABEL}{_LABELLED}{_UPPER}{_LOWER}]+", ""), _with_labels)
    marked = F.regexp_replace(listed, r"</(?i)table\s*>", "\x04")
    fragments = split_at(marked, r"<(?i)table(?:\s[^>]*)?>")

    def fragment(part: Column, i: Column) -> Column:
        def in_table(inside: Column) -> Column:
            after = F.substring(part, F.length(inside) + 2, F.length(part))
            return F.concat(F.lit(_BREAK), _row_lines(inside), F.lit(_BREAK), _fragment_text(after))

        return F.when(i == 0, _fragment_text(part)).otherwise(let(F.substring_index(part, "\x04", 1), in_table))

    joined = F.array_join(F.transform(fragments, fragment), "")
    laid_out = _replace(
        joined,
        [
            (r" *([\x01\x02\x03\x04\x0f\n]) *", "$1"),
            (r"[\x01\n]*\x02[\x01\x02\n]*", "\n\n"),
            (r"\n*\x01[\x01\n]*", "\n"),
            (r"\n*\x03", "\n"),
        ],
    )
    spaced = _replace(laid_out, [(f"[\x04{_LABEL}{_LABELLED}]+", ""), (_PAD, " ")])
    return let(let(F.btrim(spaced, F.lit(" \n")), decode_entities), _in_capitals)


def tables(c: Column | str) -> Column:
    """Inner markup of every table; a nested table ends at the first closing tag."""
    return F.regexp_extract_all(as_col(c), F.lit(r"(?is)<table[^>]*>(.*?)</table>"), 1)


def table_rows(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"(?is)<tr[^>]*>(.*?)</tr>"), 1)


def row_cells(c: Column, decode: bool = True) -> Column:
    """Clean cell texts of one row: tags out, entities decoded, white space collapsed."""
    cells = F.regexp_extract_all(c, F.lit(r"(?is)<(th|td)[^>]*>(.*?)</\1>"), 2)

    def clean(cell: Column) -> Column:
        text = F.regexp_replace(cell, r"<[^>]+>", "")
        text = decode_cell_entities(text) if decode else F.replace(text, F.lit("&nbsp;"), F.lit(" "))
        return trim_ws(F.regexp_replace(text, r"[\s\x{a0}]+", " "))

    return F.transform(cells, clean)


def table_grid(c: Column | str) -> Column:
    """``array<array<array<string>>>``: tables, their rows, their cells."""
    return F.transform(tables(c), lambda t: F.transform(table_rows(t), lambda row: row_cells(row)))


def grid_columns(grid: Column | str) -> Column:
    """Table grid to ``array<struct<header, values>>`` in first-seen order.

    The first row of each table names its columns, columns of the same name merge across tables,
    and short rows are padded with the empty string.
    """
    first = F.lit(0)

    def table_cells(t: Column) -> Column:
        data = F.slice(t, F.lit(2), F.greatest(F.size(t) - 1, F.lit(0)))
        named = F.transform(
            data,
            lambda row: F.transform(
                F.get(t, first),
                lambda h, i: F.struct(h.alias("header"), F.coalesce(F.get(row, i), F.lit("")).alias("value")),
            ),
        )
        return F.flatten(named)

    def columns(grid: Column) -> Column:
        headers = F.array_distinct(F.flatten(F.transform(grid, lambda t: F.get(t, first))))
        return let(
            F.flatten(F.transform(grid, table_cells)),
            lambda cells: F.transform(
                headers,
                lambda h: F.struct(
                    h.alias("header"),
                    F.transform(F.filter(cells, lambda x: x["header"] == h), lambda x: x["value"]).alias("values"),
                ),
            ),
        )

    return let(F.filter(as_col(grid), lambda t: F.size(F.get(t, first)) > 0), columns)


def columns_map(columns: Column | str) -> Column:
    """``map<header, values>`` of :func:`grid_columns`; the headers are distinct already."""
    return F.map_from_entries(as_col(columns))


def leaf_elements(c: Column | str) -> Column:
    """``array<struct<ordinal, tag, text>>`` of elements that hold text only, in page order."""
    body = F.regexp_replace(visible_html(c), _VOID, "")
    pattern = r"(?i)<([a-z][a-z0-9]*)(?:\s[^>]*)?>([^<]*)</"
    pairs = F.arrays_zip(
        F.regexp_extract_all(body, F.lit(pattern), 1).alias("tag"),
        F.regexp_extract_all(body, F.lit(pattern), 2).alias("text"),
    )
    elements = F.transform(
        pairs,
        lambda e, i: F.struct(
            (i + 1).cast("bigint").alias("ordinal"),
            F.lower(e["tag"]).alias("tag"),
            trim_ws(F.replace(decode_entities(e["text"]), F.lit("\u00a0"), F.lit(" "))).alias("text"),
        ),
    )
    return F.filter(elements, lambda e: e["text"] != "")


def by_tag(elements: Column | str) -> Column:
    """Leaf elements grouped as ``array<struct<tag, texts>>`` in first-seen order."""
    return let(
        as_col(elements),
        lambda found: F.transform(
            F.array_distinct(F.transform(found, lambda e: e["tag"])),
            lambda tag: F.struct(
                tag.alias("tag"),
                F.transform(F.filter(found, lambda e: e["tag"] == tag), lambda e: e["text"]).alias("texts"),
            ),
        ),
    )
