"""Free-text request functions: document type, date range, recipient, invoice data."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from mailloom.functions import dates
from mailloom.functions.text import any_of, as_col, find, let, split_at, words_regex

# Number words, common misspellings included.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15,
    "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30,
    "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90,
    "tow": 2, "tre": 3, "fore": 4, "foor": 4, "fiv": 5, "sic": 6, "nein": 9, "elevin": 11,
    "twelv": 12, "tweleve": 12,
}
# Words that combine, as in "twenty four".
TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "ninety")
UNITS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine",
    "tow", "tre", "fore", "foor", "fiv", "sic",
)

# Document types and the wording that names them, in dictionary order.
DOCUMENT_TYPES = (
    ("invoice", ("invoice", "invoices", "inv", "invioce", "invoce")),
    ("receipt", ("receipt", "receipts", "reciept", "recipt")),
    ("balance sheet", ("balance sheet", "balance sheets", "balancesheet")),
    ("income statement", ("income statement", "profit and loss", "p&l", "pnl")),
    ("expense report", ("expense report", "expense reports", "expenses")),
    ("budget report", ("budget report", "budget", "budgets", "budgit")),
    ("financial report", ("financial report", "financial reports", "finance report", "financials")),
    ("payroll report", ("payroll", "payroll report", "payrol", "pay roll")),
    ("tax report", ("tax report", "tax returns", "tax filing", "taxes")),
    ("report", ("report", "reports", "log", "logs", "fule report", "feul report", "usage", "consumption",
                "petrol report", "diesel report")),
    ("maintenance report", ("maintenance report", "maintenance reports", "service report", "repair report",
                            "maintenence report")),
    ("production report", ("production report", "production reports", "output report", "yield report")),
    ("inventory report", ("inventory report", "inventory", "stock report", "invetory", "inventoy")),
    ("safety report", ("safety report", "incident report", "hazard report", "safty report")),
    ("equipment report", ("equipment report", "equipment log", "asset report", "equipement report")),
    ("harvest report", ("harvest report", "crop report", "yield report", "harvist report")),
    ("field report", ("field report", "field reports", "feild report")),
    ("livestock report", ("livestock report", "animal report", "herd report", "livstock report")),
    ("sales report", ("sales report", "sales reports", "sales data", "revenue report", "slaes report")),
    ("marketing report", ("marketing report", "campaign report", "marketing data", "markting report")),
    ("performance report", ("performance report", "kpi report", "metrics report", "preformance report")),
    ("audit report", ("audit report", "audit", "auidt report", "compliance report")),
    ("quarterly report", ("quarterly report", "quarterly reports", "q1", "q2", "q3", "q4", "quarter report")),
    ("annual report", ("annual report", "yearly report", "year end report", "anual report")),
    ("media report", ("media report", "press report", "coverage report")),
    ("analytics report", ("analytics report", "analytics", "web report", "traffic report", "analytic report")),
    ("report", ("report", "reports", "reprot", "reort", "document", "documents", "doc", "docs", "summary",
                "summaries", "data", "file", "files", "records", "record", "log", "logs")),
    ("statement", ("statement", "statements", "statment")),
    ("contract", ("contract", "contracts", "agreement", "agreements")),
    ("proposal", ("proposal", "proposals", "proposel")),
    ("spreadsheet", ("spreadsheet", "spreadsheets", "excel", "sheet", "sheets")),
)

# The word that most of them end in.
_COMMON = "report"

# Month names, short and long.
MONTHS = (
    ("jan", "january"), ("feb", "february"), ("mar", "march"), ("apr", "april"), ("may", "may"),
    ("jun", "june"), ("jul", "july"), ("aug", "august"), ("sep", "september"), ("oct", "october"),
    ("nov", "november"), ("dec", "december"),
)

# Date wording of a request, in the order in which it is looked for.
RELATIVE = (
    r"\b(?:last|past|previous|prior|prev|lsat|passt)\s+(\d+)\s*"
    r"(month|months|mnth|mnths|week|weeks|wk|wks|day|days|dy|dys|year|years|yr|yrs)\b"
)
THIS_PERIOD = r"\bthis\s+(month|week|year)\b"
YEAR_TO_DATE = r"\b(year[\s-]?to[\s-]?date|ytd)\b"
QUARTER_TO_DATE = r"\b(quarter[\s-]?to[\s-]?date|qtd)\b"
_FULL = r"(\d{1,2}[\/\-]\d{1,2}[\/\-]\d{2,4})"
_PART = r"(\d{1,2}[\/\-]\d{1,2}(?:[\/\-]\d{2,4})?)"
FROM_TO = rf"(?:from|between)\s+{_FULL}\s+(?:to|and|-)\s+{_FULL}"
BARE_TO = rf"{_FULL}\s+to\s+{_FULL}"
COMPACT = r"(\d{1,2}\/\d{1,2})-(\d{1,2}\/\d{1,2})(?![\d\/])"
MONTH_OF_YEAR = (
    r"\bfor\s+(january|february|march|april|may|june|july|august|september|october|november|december|"
    r"jan|feb|mar|apr|jun|jul|aug|sep|oct|nov|dec)\s+(\d{4})\b"
)
AFTER = rf"\b(?:after|since)\s+{_PART}"
BEFORE = rf"\bbefore\s+{_PART}"

# Date wording of the second range reader, which also knows month names.
_NUMERIC_DATE = r"\d{1,2}\/\d{1,2}(?:\/\d{2,4})?"
_MONTH_NAME = (
    r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|"
    r"Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
)
_NAMED_DATE = rf"{_MONTH_NAME}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s*\d{{4}})?"
_DATE = rf"((?:{_NUMERIC_DATE}|{_NAMED_DATE}))"
TEXT_FROM_TO = rf"\bfrom\s+{_DATE}\s+to\s+{_DATE}"
TEXT_BETWEEN = rf"\bbetween\s+{_DATE}\s+and\s+{_DATE}"
TEXT_AFTER = rf"\b(?:after|since)\s+{_DATE}"
TEXT_BEFORE = rf"\bbefore\s+{_DATE}"

# Recipient wording.
SELF_PATTERNS = (
    r"\bsend\s+(?:it\s+)?(?:back\s+)?to\s+me\b",
    r"\bforward\s+(?:it\s+)?to\s+me\b",
    r"\bback\s+to\s+me\b",
    r"\bsend\s+me\b",
    r"\bplease\s+send\s+me\b",
    r"\bcan\s+you\s+(?:please\s+)?send\s+me\b",
    r"\bi\s+(?:would|'d)\s+like\s+(?:to\s+receive|it\s+sent\s+to\s+me)\b",
    r"\bmy\s+way\b",
    r"\bto\s+my\s+(?:email|inbox|address)\b",
)
DEPARTMENTS = (
    "accounting", "finance", "hr", "management", "team", "department", "board", "sales", "marketing",
)
_DEPARTMENT = "(" + "|".join(DEPARTMENTS) + ")"
_FULL_NAME = r"([A-Z][a-z]+(?:\s+(?:[A-Z]\.?\s*)?[A-Z][a-z]+)*)"
SEND_DEPARTMENT = rf"\bsend\s+{_DEPARTMENT}\s+(?:the|a|an|some)\b"
SEND_NAME = rf"\bsend\s+{_FULL_NAME}\s+(?:the|a|an|some)\b"
DELIVER_TO_NAME = r"\b(?:send|forward|email|mail|deliver)(?:\s+it)?\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
EMAIL_ADDRESS = r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"
TO_NAME = rf"\bto\s+{_FULL_NAME}\b"
TO_DEPARTMENT = rf"\bto\s+(?:the\s+)?{_DEPARTMENT}\b"
SELF_DISPLAY = "Back to sender (requestor)"
UNKNOWN_DISPLAY = "Recipient not identified"

# Invoice data.
INVOICE_NUMBER = r"Invoice\s*#?\s*(\d+)"
AMOUNT = r"\$[\d,]+\.\d{2}"


def words_to_digits(c: Column | str) -> Column:
    """Lower-case the text and replace number words; "twenty four" becomes 24.

    The text is cut in front of every number word and each piece swaps its first word. A tens
    word before a unit is marked first: it gives only its first digit, the unit gives the second.
    """
    tens, units, words = ("|".join(w) for w in (TENS, UNITS, NUMBER_WORDS))
    mark = "\x01"
    marked = F.regexp_replace(
        F.lower(as_col(c)), words_regex(rf"\b({tens})\s+(?=(?:{units})\b)"), "$1" + mark
    )
    values = {w: str(v) for w, v in NUMBER_WORDS.items()}
    values |= {w + mark: str(NUMBER_WORDS[w] // 10) for w in TENS}
    digits = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    def swap(piece: Column, i: Column) -> Column:
        word = F.regexp_extract(piece, rf"^(?:{words})(?:{mark}|(?!\w))", 0)
        rest = F.substring(piece, F.length(word) + 1, F.length(piece))
        return F.when(word == "", piece).otherwise(F.concat(F.try_element_at(digits, word), rest))

    first = "".join(sorted({w[0] for w in NUMBER_WORDS}))
    pieces = split_at(marked, words_regex(rf"\b(?=[{first}])(?=(?:{words})\b)"))
    return F.array_join(F.transform(pieces, swap), "")


def document_type(c: Column | str) -> Column:
    """Canonical type of the longest-named entry with an alias anywhere in the text, or null.

    Most aliases end in one common word. They are looked for only in front of its places, which one pass over the text cuts out;
    the whole text is searched for the others alone.
    """
    entries = sorted(DOCUMENT_TYPES, key=lambda d: -len(d[0]))
    ahead = max(len(alias) for _, aliases in entries for alias in _shortest(aliases) if alias.endswith(_COMMON)) - len(_COMMON)
    places = rf"(?s)(?<=(^.{{0,{ahead - 1}}}|.{{{ahead}}})){_COMMON}"

    def first_named(t: Column) -> Column:
        def hit(alias: str) -> Column:
            return F.contains(t["near"] if alias.endswith(_COMMON) else t["text"], F.lit(alias))

        chain = F
        for canonical, aliases in entries:
            chain = chain.when(reduce(Column.__or__, (hit(alias) for alias in _shortest(aliases))), canonical)
        return chain

    def near(text: Column) -> Column:
        found = F.transform(F.regexp_extract_all(text, F.lit(places), 1), lambda before: F.concat(before, F.lit(_COMMON)))
        cut = F.when(F.contains(text, F.lit(_COMMON)), F.array_join(found, "\n")).otherwise("")
        return F.struct(text.alias("text"), cut.alias("near"))

    return let(F.lower(as_col(c)), lambda text: let(near(text), first_named))


def _shortest(aliases: tuple[str, ...]) -> list[str]:
    """Aliases that contain another alias can never change the answer."""
    return [a for a in dict.fromkeys(aliases) if not any(b != a and b in a for b in aliases)]


def _range(start: Column | None, end: Column, description: Column | str) -> Column:
    text = F.lit(description) if isinstance(description, str) else description
    first = F.lit(None).cast("string") if start is None else start
    return F.struct(first.alias("start"), end.alias("end"), text.alias("description"))


def _on_match(text: Column, pattern: str, groups: int, use: Callable[..., Column]) -> Column:
    """``use`` of the groups of the first match, each read once; null without a match."""
    rx = words_regex(pattern, ignore_case=True)
    if groups == 0:
        return F.when(text.rlike(rx), use())
    names = [f"g{i}" for i in range(1, groups + 1)]
    found = F.struct(*[F.regexp_extract(text, rx, i).alias(n) for i, n in enumerate(names, start=1)])
    return F.when(text.rlike(rx), let(found, lambda m: use(*[m[n] for n in names])))


def _date_parts(c: Column) -> Column:
    return F.split(F.translate(c, "-", "/"), "/")


def _full_date(p: Column) -> Column:
    year = F.get(p, F.lit(2))
    full = F.when(F.length(year) == 2, F.concat(F.lit("20"), year)).otherwise(year)
    return F.concat_ws("/", *[F.lpad(F.get(p, F.lit(i)), 2, "0") for i in (0, 1)], full)


def normalise_date(c: Column) -> Column:
    """``M/D/YY`` or ``M-D-YYYY`` to ``MM/DD/YYYY`` without checking that the day exists."""
    return let(_date_parts(c), lambda p: F.when(F.size(p) == 3, _full_date(p)).otherwise(c))


def short_date(c: Column, ref_date: dt.date) -> Column:
    """Like :func:`normalise_date`; without a year it is this year's, or last year's if later."""

    def inferred(md: Column) -> Column:
        later = dates.rolled_date(F.lit(ref_date.year), md["m"], md["d"]) > F.lit(ref_date)
        year = F.when(later, str(ref_date.year - 1)).otherwise(str(ref_date.year))
        return F.concat_ws("/", *(F.lpad(md[x].cast("string"), 2, "0") for x in "md"), year)

    def from_parts(p: Column) -> Column:
        md = F.struct(*[F.get(p, F.lit(i)).try_cast("int").alias(x) for i, x in enumerate("md")])
        return F.when(F.size(p) == 3, _full_date(p)).when(F.size(p) == 2, let(md, inferred))

    return let(_date_parts(c), from_parts)


def relative_range(text: Column, ref_date: dt.date) -> Column:
    """``last 3 months`` and its variants, ending at the reference date."""
    ref = F.lit(ref_date)

    def span(number: Column, unit: Column) -> Column:
        kind = (
            F.when(unit.startswith("m"), "month")
            .when(unit.startswith("w"), "week")
            .when(unit.startswith("d"), "day")
            .otherwise("year")
        )
        known = F.struct(number.try_cast("bigint").alias("n"), kind.alias("kind"))

        def back(k: Column) -> Column:
            shown = F.coalesce(k["n"].cast("string"), number)
            description = F.concat(F.lit("last "), shown, F.lit(" "), unit, F.lit("(s)"))
            return _range(dates.mdy(dates.minus_units(ref, k["n"], k["kind"])), dates.mdy(ref), description)

        return let(known, back)

    return _on_match(text, RELATIVE, 2, lambda number, unit: span(number, F.lower(unit)))


def this_period_range(text: Column, ref_date: dt.date) -> Column:
    """``this month``, ``this week`` (from Sunday) or ``this year``."""
    sunday = ref_date - dt.timedelta(days=ref_date.isoweekday() % 7)

    def span(unit: Column) -> Column:
        start = (
            F.when(unit == "month", F.lit(ref_date.replace(day=1)))
            .when(unit == "week", F.lit(sunday))
            .otherwise(F.lit(ref_date.replace(month=1, day=1)))
        )
        return _range(dates.mdy(start), dates.mdy(F.lit(ref_date)), F.concat(F.lit("this "), unit))

    return _on_match(text, THIS_PERIOD, 1, lambda unit: span(F.lower(unit)))


def _until_now(text: Column, pattern: str, first: dt.date, ref_date: dt.date, description: str) -> Column:
    span = _range(dates.mdy(F.lit(first)), dates.mdy(F.lit(ref_date)), description)
    return _on_match(text, pattern, 0, lambda: span)


def year_to_date_range(text: Column, ref_date: dt.date) -> Column:
    return _until_now(text, YEAR_TO_DATE, ref_date.replace(month=1, day=1), ref_date, "year to date")


def quarter_to_date_range(text: Column, ref_date: dt.date) -> Column:
    first = ref_date.replace(month=(ref_date.month - 1) // 3 * 3 + 1, day=1)
    return _until_now(text, QUARTER_TO_DATE, first, ref_date, "quarter to date")


def explicit_range(text: Column) -> Column:
    """``from D to D``, ``between D and D``."""
    return _on_match(
        text, FROM_TO, 2, lambda a, b: _range(normalise_date(a), normalise_date(b), "explicit range")
    )


def bare_range(text: Column) -> Column:
    """``D to D``."""
    return _on_match(
        text, BARE_TO, 2, lambda a, b: _range(normalise_date(a), normalise_date(b), "explicit range")
    )


def compact_range(text: Column, ref_date: dt.date) -> Column:
    """``M/D-M/D``."""
    return _on_match(
        text,
        COMPACT,
        2,
        lambda a, b: _range(short_date(a, ref_date), short_date(b, ref_date), "compact range"),
    )


def month_range(text: Column) -> Column:
    """``for March 2026``: that whole month."""

    def span(name: Column, year: Column) -> Column:
        short = F.lower(F.substring(name, 1, 3))
        month = F.array_position(F.array(*[F.lit(m[0]) for m in MONTHS]), short).cast("int")
        description = F.concat(name, F.lit(" "), year.try_cast("int").cast("string"))
        return let(
            F.make_date(year.try_cast("int"), month, F.lit(1)),
            lambda first: _range(dates.mdy(first), dates.mdy(F.last_day(first)), description),
        )

    return _on_match(text, MONTH_OF_YEAR, 2, span)


def after_range(text: Column, ref_date: dt.date) -> Column:
    """``after D``, ``since D``: until the reference date."""
    end = dates.mdy(F.lit(ref_date))
    return _on_match(
        text, AFTER, 1, lambda d: _range(short_date(d, ref_date), end, F.concat(F.lit("after "), d))
    )


def before_range(text: Column, ref_date: dt.date) -> Column:
    """``before D``: open start."""
    return _on_match(
        text, BEFORE, 1, lambda d: _range(None, short_date(d, ref_date), F.concat(F.lit("before "), d))
    )


def date_range_in_digits(text: Column, ref_date: dt.date) -> Column:
    """First date wording of a text that went through :func:`words_to_digits`."""
    # Every wording with a day in it has digits around a separator, which one pass can rule out.
    dated = text.rlike(r"\d[/\-]\d")
    return F.coalesce(
        relative_range(text, ref_date),
        this_period_range(text, ref_date),
        year_to_date_range(text, ref_date),
        quarter_to_date_range(text, ref_date),
        F.when(dated, F.coalesce(explicit_range(text), bare_range(text), compact_range(text, ref_date))),
        month_range(text),
        F.when(dated, F.coalesce(after_range(text, ref_date), before_range(text, ref_date))),
    )


def date_range_text(c: Column | str, ref_date: dt.date) -> Column:
    """First date wording found, as ``struct<start, end, description>`` of text, or null."""
    return let(words_to_digits(c), lambda text: date_range_in_digits(text, ref_date))


def as_dates(span: Column | str) -> Column:
    """Text range to ``struct<start date, end date, description>``; impossible days become null."""
    span = as_col(span)
    return F.when(
        span.isNotNull(),
        F.struct(
            dates.parse_mdy(span["start"]).alias("start"),
            dates.parse_mdy(span["end"]).alias("end"),
            span["description"].alias("description"),
        ),
    )


def date_range(c: Column | str, ref_date: dt.date) -> Column:
    return let(date_range_text(c, ref_date), as_dates)


def date_fragment(c: Column | str, ref_date: dt.date) -> Column:
    """``M/D/Y``, ``M/D`` or ``Month D[, YYYY]`` to a date; days and months roll over."""
    numeric = words_regex(r"^(\d{1,2})\/(\d{1,2})(?:\/(\d{2,4}))?$")
    named = words_regex(r"^([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s*(\d{4}))?$")
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for n in dict.fromkeys(m) for x in (n, i + 1)])

    def parts(text: Column, rx: str, month: Callable[[Column], Column]) -> Column:
        first, day, year = (F.regexp_extract(text, rx, i) for i in (1, 2, 3))
        return F.struct(
            month(first).alias("m"), day.try_cast("int").alias("d"), year.try_cast("int").alias("y")
        )

    def inferred(this_year: Column) -> Column:
        last_year = dates.rolled_date(F.lit(ref_date.year - 1), F.month(this_year), F.dayofmonth(this_year))
        return F.when(this_year > F.lit(ref_date), last_year).otherwise(this_year)

    def resolved(p: Column) -> Column:
        return F.when(p["y"].isNotNull(), dates.rolled_date(p["y"], p["m"], p["d"])).otherwise(
            let(dates.rolled_date(F.lit(ref_date.year), p["m"], p["d"]), inferred)
        )

    def read(text: Column) -> Column:
        short_year = let(
            parts(text, numeric, lambda m: m.try_cast("int")),
            lambda p: p.withField("y", F.when(p["y"] < 100, p["y"] + 2000).otherwise(p["y"])),
        )
        by_name = parts(text, named, lambda m: F.try_element_at(names, F.lower(m)))
        found = F.when(text.rlike(numeric), short_year).when(text.rlike(named), by_name)
        return let(found, resolved)

    return let(F.trim(as_col(c)), read)


def text_date_range(c: Column | str, ref_date: dt.date) -> Column:
    """Second range reader, ``struct<start, end, description>`` of dates, or null.

    ``from D to D``, ``between D and D``, ``after``/``since D``, ``before D``; the first wording
    whose dates can be read wins.
    """
    none = F.lit(None).cast("date")

    def both(a: Column, b: Column) -> Column:
        days = F.struct(date_fragment(a, ref_date).alias("a"), date_fragment(b, ref_date).alias("b"))
        description = F.concat(F.trim(a), F.lit(" to "), F.trim(b))
        return let(
            days,
            lambda d: F.when(
                d["a"].isNotNull() & d["b"].isNotNull(), _range(d["a"], d["b"], description)
            ),
        )

    def one(word: str, bounds: Callable[[Column], tuple[Column, Column]]) -> Callable[[Column], Column]:
        def span(found: Column) -> Column:
            description = F.concat(F.lit(word), F.trim(found))
            return let(
                date_fragment(found, ref_date),
                lambda d: F.when(d.isNotNull(), _range(*bounds(d), description)),
            )

        return span

    def spans(text: Column) -> Column:
        return F.coalesce(
            _on_match(text, TEXT_FROM_TO, 2, both),
            _on_match(text, TEXT_BETWEEN, 2, both),
            _on_match(text, TEXT_AFTER, 1, one("after ", lambda d: (d, F.lit(ref_date)))),
            _on_match(text, TEXT_BEFORE, 1, one("before ", lambda d: (none, d))),
        )

    return let(as_col(c), spans)


def recipient(c: Column | str) -> Column:
    """``struct<type, display>``; the first wording in this order wins."""
    text = as_col(c)

    def extract(pattern: str, group: int = 1, ignore_case: bool = False) -> tuple[Column, Column]:
        rx = words_regex(pattern, ignore_case)
        return F.coalesce(text.rlike(rx), F.lit(False)), F.regexp_extract(text, rx, group)

    def result(kind: str, display: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), display.alias("display"))

    def quoted(prefix: str, value: Column) -> Column:
        return F.concat(F.lit(prefix + ' "'), value, F.lit('"'))

    to_me = F.coalesce(text.rlike(any_of(*SELF_PATTERNS, ignore_case=True)), F.lit(False))
    is_send_dept, send_dept = extract(SEND_DEPARTMENT, ignore_case=True)
    is_send_name, send_name = extract(SEND_NAME)
    is_deliver, deliver_name = extract(DELIVER_TO_NAME)
    is_email, email = extract(EMAIL_ADDRESS, 0)
    is_to_name, to_name = extract(TO_NAME)
    is_to_dept, to_dept = extract(TO_DEPARTMENT, ignore_case=True)
    return (
        F.when(to_me, result("sender", F.lit(SELF_DISPLAY)))
        .when(is_send_dept, result("department", quoted("by department", send_dept)))
        .when(is_send_name, result("named", quoted("by name", send_name)))
        .when(is_deliver, result("named", quoted("by name", deliver_name)))
        .when(is_email, result("email", email))
        .when(is_to_name & ~F.lower(to_name).isin(*DEPARTMENTS), result("named", quoted("by name", to_name)))
        .when(is_to_dept, result("department", quoted("by department", to_dept)))
        .otherwise(result("unknown", F.lit(UNKNOWN_DISPLAY)))
    )


def invoice_number(subject: Column | str) -> Column:
    return F.coalesce(find(subject, words_regex(INVOICE_NUMBER, ignore_case=True), 1), F.lit("Unknown"))


def invoice_amount(body: Column | str) -> Column:
    return F.coalesce(find(body, words_regex(AMOUNT)), F.lit("Not found"))
