"""Requests in free text, their files, and checks on extraction results."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import quality as Q
from mailloom.functions import request as R
from mailloom.functions.filenames import FilePattern
from mailloom.operators import mapping as M
from mailloom.plans.requests import gated_requests, read_requests, resolve_requests
from mailloom.sources.request_map import DocumentRule, RecipientRule, RequestMap, map_rules
from workload.registry import query
from workload.views import REF, REF_DATE, Views, duck

RULES = RequestMap(
    documents=(
        DocumentRule("invoice", "Bills", "Billing_{% date(<yyyy>-<mm>-<dd>) %}.pdf"),
        DocumentRule("report", "Summaries"),
        DocumentRule("*"),
    ),
    recipients=(
        RecipientRule("accounting", "ledger@example.net"),
        RecipientRule("Priya Raman", "priya.raman@example.net", "Extracts_Priya_.*"),
        RecipientRule("%requestor%"),
    ),
)
PATTERN = "Billing_{% date(<yyyy>-<mm>-<dd>) %}.pdf"

# Fixed values, stated again so that the checks do not read them from what they check: number words, words that combine,
# document types and their wording in dictionary order.
_NUMBERS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9, "ten": 10,
    "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18,
    "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "ninety": 90, "tow": 2, "tre": 3,
    "fore": 4, "foor": 4, "fiv": 5, "sic": 6, "nein": 9, "elevin": 11, "twelv": 12, "tweleve": 12,
}
_TENS = ("twenty", "thirty", "forty", "fifty", "sixty", "ninety")
_UNITS = (
    "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "tow", "tre", "fore", "foor", "fiv", "sic",
)
_TYPES = (
    ("invoice", "invoice|invoices|inv|invioce|invoce"),
    ("receipt", "receipt|receipts|reciept|recipt"),
    ("balance sheet", "balance sheet|balance sheets|balancesheet"),
    ("income statement", "income statement|profit and loss|p&l|pnl"),
    ("expense report", "expense report|expense reports|expenses"),
    ("budget report", "budget report|budget|budgets|budgit"),
    ("financial report", "financial report|financial reports|finance report|financials"),
    ("payroll report", "payroll|payroll report|payrol|pay roll"),
    ("tax report", "tax report|tax returns|tax filing|taxes"),
    ("report", "report|reports|log|logs|fule report|feul report|usage|consumption|petrol report|diesel report"),
    ("maintenance report", "maintenance report|maintenance reports|service report|repair report|maintenence report"),
    ("production report", "production report|production reports|output report|yield report"),
    ("inventory report", "inventory report|inventory|stock report|invetory|inventoy"),
    ("safety report", "safety report|incident report|hazard report|safty report"),
    ("equipment report", "equipment report|equipment log|asset report|equipement report"),
    ("harvest report", "harvest report|crop report|yield report|harvist report"),
    ("field report", "field report|field reports|feild report"),
    ("livestock report", "livestock report|animal report|herd report|livstock report"),
    ("sales report", "sales report|sales reports|sales data|revenue report|slaes report"),
    ("marketing report", "marketing report|campaign report|marketing data|markting report"),
    ("performance report", "performance report|kpi report|metrics report|preformance report"),
    ("audit report", "audit report|audit|auidt report|compliance report"),
    ("quarterly report", "quarterly report|quarterly reports|q1|q2|q3|q4|quarter report"),
    ("annual report", "annual report|yearly report|year end report|anual report"),
    ("media report", "media report|press report|coverage report"),
    ("analytics report", "analytics report|analytics|web report|traffic report|analytic report"),
    ("report", "report|reports|reprot|reort|document|documents|doc|docs|summary|summaries|data|file|files|records|record|log|logs"),
    ("statement", "statement|statements|statment"),
    ("contract", "contract|contracts|agreement|agreements"),
    ("proposal", "proposal|proposals|proposel"),
    ("spreadsheet", "spreadsheet|spreadsheets|excel|sheet|sheets"),
)

# --- SQL pieces ----------------------------------------------------------------------------------


def digits(c: str) -> str:
    units = "|".join(_UNITS)
    s = f"lower({c})"
    for word in _TENS:
        s = rf"regexp_replace({s}, '\b{word}\s+({units})\b', '{_NUMBERS[word] // 10}' || chr(1) || '\1', 'g')"
    for word, value in _NUMBERS.items():
        s = rf"regexp_replace({s}, '\b{word}\b', '{value}', 'g')"
    return f"replace({s}, chr(1), '')"


def norm(c: str) -> str:
    """``M/D/YY`` to ``MM/DD/YYYY``; other text as it is."""
    p = f"regexp_split_to_array({c}, '[/\\-]')"
    return f"""case when len({p}) = 3 then lpad({p}[1], 2, '0') || '/' || lpad({p}[2], 2, '0') || '/'
      || case when length({p}[3]) = 2 then '20' || {p}[3] else {p}[3] end else {c} end"""


def short(c: str, ref: str = REF) -> str:
    p = f"regexp_split_to_array({c}, '[/\\-]')"
    day = f"cast(make_date(year({ref}), 1, 1) + to_months(cast({p}[1] as int) - 1) + to_days(cast({p}[2] as int) - 1) as date)"
    return f"""case when len({p}) = 3 then {norm(c)} else lpad({p}[1], 2, '0') || '/' || lpad({p}[2], 2, '0') || '/'
      || (year({ref}) - case when {day} > {ref} then 1 else 0 end) end"""


def mdy(c: str) -> str:
    return f"strftime({c}, '%m/%d/%Y')"


_D = r"(\d{1,2}[/\-]\d{1,2}[/\-]\d{2,4})"
_P = r"(\d{1,2}[/\-]\d{1,2}(?:[/\-]\d{2,4})?)"
_REL = (r"\b(?:last|past|previous|prior|prev|lsat|passt)\s+(\d+)\s*(month|months|mnth|mnths|week|weeks|wk|wks|day|days|dy|dys|"
        r"year|years|yr|yrs)\b")
_MONTH = (r"\bfor\s+(january|february|march|april|may|june|july|august|september|october|november|december|jan|feb|mar|apr|jun|"
          r"jul|aug|sep|oct|nov|dec)\s+(\d{4})\b")


def g(pattern: str, group: int, t: str = "t") -> str:
    return f"regexp_extract({t}, '{pattern}', {group}, 'i')"


def _month_start() -> str:
    return f"strptime(substr({g(_MONTH, 1)}, 1, 3) || ' ' || {g(_MONTH, 2)}, '%b %Y')"


# rule -> (condition, start, end, description) over the digit text t, in order
_UNIT, _N = g(_REL, 2), f"cast({g(_REL, 1)} as int)"
_FROM, _BARE = rf"(?:from|between)\s+{_D}\s+(?:to|and|-)\s+{_D}", rf"{_D}\s+to\s+{_D}"
_COMPACT = r"(\d{1,2}/\d{1,2})-(\d{1,2}/\d{1,2})([^0-9/]|$)"
_AFTER, _BEFORE = rf"\b(?:after|since)\s+{_P}", rf"\bbefore\s+{_P}"
SPANS = {
    "r03_relative": (
        f"regexp_matches(t, '{_REL}', 'i')",
        mdy(f"{REF} - case substr({_UNIT}, 1, 1) when 'm' then to_months({_N}) when 'w' then to_days(7 * {_N}) "
            f"when 'd' then to_days({_N}) else to_years({_N}) end"),
        mdy(REF), f"'last ' || {_N} || ' ' || {_UNIT} || '(s)'"),
    "r04_this_period": (
        r"regexp_matches(t, '\bthis\s+(month|week|year)\b', 'i')",
        mdy(rf"case {g(r'\bthis\s+(month|week|year)\b', 1)} when 'month' then DATE '2026-03-01' when 'week' then DATE '2026-03-08' "
            "else DATE '2026-01-01' end"),
        mdy(REF), rf"'this ' || {g(r'\bthis\s+(month|week|year)\b', 1)}"),
    "r05_year_to_date": (
        r"regexp_matches(t, '\b(year[\s-]?to[\s-]?date|ytd)\b', 'i')", "'01/01/2026'", mdy(REF), "'year to date'"),
    "r06_quarter_to_date": (
        r"regexp_matches(t, '\b(quarter[\s-]?to[\s-]?date|qtd)\b', 'i')", "'01/01/2026'", mdy(REF), "'quarter to date'"),
    "r07_from_to": (f"regexp_matches(t, '{_FROM}', 'i')", norm(g(_FROM, 1)), norm(g(_FROM, 2)), "'explicit range'"),
    "r08_bare_to": (f"regexp_matches(t, '{_BARE}', 'i')", norm(g(_BARE, 1)), norm(g(_BARE, 2)), "'explicit range'"),
    "r09_compact": (f"regexp_matches(t, '{_COMPACT}')", short(g(_COMPACT, 1)), short(g(_COMPACT, 2)), "'compact range'"),
    "r10_month_of_year": (
        f"regexp_matches(t, '{_MONTH}', 'i')", mdy(_month_start()), mdy(f"last_day({_month_start()})"),
        f"{g(_MONTH, 1)} || ' ' || cast({g(_MONTH, 2)} as int)"),
    "r11_after": (f"regexp_matches(t, '{_AFTER}', 'i')", short(g(_AFTER, 1)), mdy(REF), f"'after ' || {g(_AFTER, 1)}"),
    "r11_before": (f"regexp_matches(t, '{_BEFORE}', 'i')", "cast(null as varchar)", short(g(_BEFORE, 1)), f"'before ' || {g(_BEFORE, 1)}"),
}
_TEXTS = {"d": f"select *, {digits('body')} as t from fx_messages"}


def span_sql(rule: str) -> str:
    cond, start, end, description = SPANS[rule]
    return duck(f"""select uid, {start} as start, {end} as "end", {description} as description from d where {cond}""",
                "fx_messages", **_TEXTS)


def _spans_sql() -> str:
    cases = {part: " ".join(f"when {s[0]} then {s[i]}" for s in SPANS.values()) for i, part in ((1, "start"), (2, "end"), (3, "description"))}
    return f"""select d.*, case {cases['start']} end as start, case {cases['end']} end as "end", case {cases['description']} end as description
      from d"""


def _spans(v: Views, rule) -> DataFrame:
    rows = v.messages.select("uid", R.words_to_digits("body").alias("t")).select("uid", rule(F.col("t")).alias("s"))
    return rows.filter("s is not null").select("uid", "s.start", "s.end", "s.description")


# --- text to request -----------------------------------------------------------------------------


@query("r01_number_words", duck(f"select uid, {digits('body')} as text from fx_messages", "fx_messages"))
def r01(v: Views) -> DataFrame:
    return v.messages.select("uid", R.words_to_digits("body").alias("text"))


_ALIASES = ", ".join(
    f"({rank}, '{canonical}', '{alias}')"
    for rank, (canonical, aliases) in enumerate(sorted(_TYPES, key=lambda d: -len(d[0])))
    for alias in aliases.split("|")
)
_TYPES_SQL = f"""select uid, arg_min(canonical, rank) as doc_type from fx_messages left join (values {_ALIASES}) a(rank, canonical, alias)
  on contains(lower(body), alias) group by uid"""


@query("r02_document_type", duck("select * from ty", "fx_messages", ty=_TYPES_SQL))
def r02(v: Views) -> DataFrame:
    return v.messages.select("uid", R.document_type("body").alias("doc_type"))


@query("r02_document_type_prose", f"""
    with texts as (select doc_id as uid, text as body from documents)
    select uid, arg_min(canonical, rank) as doc_type from texts left join (values {_ALIASES}) a(rank, canonical, alias)
      on contains(lower(body), alias) group by uid""")
def r02_prose(v: Views) -> DataFrame:
    return v.table("documents").select(F.col("doc_id").alias("uid"), R.document_type("text").alias("doc_type"))


@query("r03_relative", span_sql("r03_relative"))
def r03(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.relative_range(t, REF_DATE))


@query("r04_this_period", span_sql("r04_this_period"))
def r04(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.this_period_range(t, REF_DATE))


@query("r05_year_to_date", span_sql("r05_year_to_date"))
def r05(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.year_to_date_range(t, REF_DATE))


@query("r06_quarter_to_date", span_sql("r06_quarter_to_date"))
def r06(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.quarter_to_date_range(t, REF_DATE))


@query("r07_from_to", span_sql("r07_from_to"))
def r07(v: Views) -> DataFrame:
    return _spans(v, R.explicit_range)


@query("r08_bare_to", span_sql("r08_bare_to"))
def r08(v: Views) -> DataFrame:
    return _spans(v, R.bare_range)


@query("r09_compact", span_sql("r09_compact"))
def r09(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.compact_range(t, REF_DATE))


@query("r10_month_of_year", span_sql("r10_month_of_year"))
def r10(v: Views) -> DataFrame:
    return _spans(v, R.month_range)


@query("r11_after", span_sql("r11_after"))
def r11_after(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.after_range(t, REF_DATE))


@query("r11_before", span_sql("r11_before"))
def r11_before(v: Views) -> DataFrame:
    return _spans(v, lambda t: R.before_range(t, REF_DATE))


_WRITTEN = """select o_orderkey, case o_orderkey % 4 when 0 then month(o_orderdate) || '/' || day(o_orderdate) || '/' || strftime(o_orderdate, '%y')
    when 1 then strftime(o_orderdate, '%m-%d-%Y') when 2 then month(o_orderdate) || '/' || day(o_orderdate)
    else strftime(o_orderdate, '%m-%d') end as written from orders"""


def _written(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "M/d/yy"))
        .when(k == 1, F.date_format(d, "MM-dd-yyyy"))
        .when(k == 2, F.date_format(d, "M/d"))
        .otherwise(F.date_format(d, "MM-dd"))
    )
    return v.table("orders").select("o_orderkey", text.alias("written"))


@query("r12_normalise_date", duck(f"select o_orderkey, {norm('written')} as date from w", w=_WRITTEN))
def r12(v: Views) -> DataFrame:
    return _written(v).select("o_orderkey", R.normalise_date(F.col("written")).alias("date"))


@query("r13_short_date", duck(f"select o_orderkey, {short('written')} as date from w", w=_WRITTEN))
def r13(v: Views) -> DataFrame:
    return _written(v).select("o_orderkey", R.short_date(F.col("written"), REF_DATE).alias("date"))


@query("r14_date_range", duck('select uid, start, "end", description from s', "fx_messages", **_TEXTS, s=_spans_sql()))
def r14(v: Views) -> DataFrame:
    digits = v.messages.select("uid", R.words_to_digits("body").alias("t"))
    rows = digits.select("uid", R.date_range_in_digits(F.col("t"), REF_DATE).alias("s"))
    return rows.select("uid", "s.start", "s.end", "s.description")


_NAMED = r"(?:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|Jun(?:e)?|Jul(?:y)?|Aug(?:ust)?|Sep(?:tember)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
_FRAG = rf"((?:\d{{1,2}}/\d{{1,2}}(?:/\d{{2,4}})?|{_NAMED}\s+\d{{1,2}}(?:st|nd|rd|th)?(?:,?\s*\d{{4}})?))"


def frag(c: str, ref: str = REF) -> str:
    """Date of a fragment, as DuckDB SQL."""
    named = r"^([A-Za-z]+)\s+(\d{1,2})(?:st|nd|rd|th)?(?:,?\s*(\d{4}))?$"
    month = f"month(strptime(substr({c}, 1, 3), '%b'))"
    p = f"string_split({c}, '/')"
    y = f"case when regexp_matches({c}, '^[0-9]') then try_cast({p}[3] as int) else try_cast(regexp_extract({c}, '{named}', 3) as int) end"
    full = f"case when {y} < 100 then {y} + 2000 else {y} end"
    m = f"case when regexp_matches({c}, '^[0-9]') then cast({p}[1] as int) else {month} end"
    d = f"case when regexp_matches({c}, '^[0-9]') then cast({p}[2] as int) else cast(regexp_extract({c}, '{named}', 2) as int) end"

    def date(year: str) -> str:
        return f"cast(make_date({year}, 1, 1) + to_months(cast({m} - 1 as int)) + to_days(cast({d} - 1 as int)) as date)"

    return f"""case when {full} is not null then {date(full)} when {date(f'year({ref})')} > {ref} then {date(f'year({ref}) - 1')}
      else {date(f'year({ref})')} end"""


_TFROM, _TBETW = rf"\bfrom\s+{_FRAG}\s+to\s+{_FRAG}", rf"\bbetween\s+{_FRAG}\s+and\s+{_FRAG}"
_TAFTER, _TBEFORE = rf"\b(?:after|since)\s+{_FRAG}", rf"\bbefore\s+{_FRAG}"
_TEXT_SPANS = f"""select uid, case when regexp_matches(t, '{_TFROM}', 'i') then 1 when regexp_matches(t, '{_TBETW}', 'i') then 2
    when regexp_matches(t, '{_TAFTER}', 'i') then 3 when regexp_matches(t, '{_TBEFORE}', 'i') then 4 end as k,
  case k when 1 then {g(_TFROM, 1)} when 2 then {g(_TBETW, 1)} when 3 then {g(_TAFTER, 1)} when 4 then {g(_TBEFORE, 1)} end as a,
  case k when 1 then {g(_TFROM, 2)} when 2 then {g(_TBETW, 2)} end as b from (select uid, body as t from fx_messages)"""


@query("r15_text_date_range", duck(
    f"""select uid, case when k < 4 then strftime({frag('a')}, '%Y-%m-%d') end as start,
          strftime(case k when 3 then {REF} when 4 then {frag('a')} else {frag('b')} end, '%Y-%m-%d') as "end",
          case k when 3 then 'after ' || a when 4 then 'before ' || a else a || ' to ' || b end as description
        from s where k is not null""", "fx_messages", s=_TEXT_SPANS))
def r15(v: Views) -> DataFrame:
    rows = v.messages.select("uid", R.text_date_range("body", REF_DATE).alias("s")).filter("s is not null")
    return rows.select(
        "uid",
        F.date_format("s.start", "yyyy-MM-dd").alias("start"),
        F.date_format("s.end", "yyyy-MM-dd").alias("end"),
        "s.description",
    )


_FRAGMENTS = """select o_orderkey, case o_orderkey % 5 when 0 then month(o_orderdate) || '/' || day(o_orderdate)
    when 1 then month(o_orderdate) || '/' || day(o_orderdate) || '/' || strftime(o_orderdate, '%y')
    when 2 then strftime(o_orderdate, '%B') || ' ' || day(o_orderdate) || 'th, ' || year(o_orderdate)
    when 3 then lower(strftime(o_orderdate, '%b')) || ' ' || day(o_orderdate) else strftime(o_orderdate, '%m/%d/%Y') end as f from orders"""


@query("r16_date_fragment", duck(f"select o_orderkey, f, strftime({frag('f')}, '%Y-%m-%d') as date from x", x=_FRAGMENTS))
def r16(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(d, "M/d"))
        .when(k == 1, F.date_format(d, "M/d/yy"))
        .when(k == 2, F.concat(F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy")))
        .when(k == 3, F.lower(F.date_format(d, "MMM d")))
        .otherwise(F.date_format(d, "MM/dd/yyyy"))
    )
    rows = v.table("orders").select("o_orderkey", text.alias("f"))
    return rows.withColumn("date", F.date_format(R.date_fragment("f", REF_DATE), "yyyy-MM-dd"))


_DEPT = "accounting|finance|hr|management|team|department|board|sales|marketing"
_NAME = r"([A-Z][a-z]+(?:\s+(?:[A-Z]\.?\s*)?[A-Z][a-z]+)*)"


def who(c: str, part: str) -> str:
    """``type`` or ``display`` of the recipient, as DuckDB SQL."""
    def x(pattern: str, group: int = 1, flags: str = "") -> str:
        return f"regexp_extract({c}, '{pattern}', {group}{flags and f', {flags!r}'})"

    send, deliver = rf"\bsend\s+{_NAME}\s+(?:the|a|an|some)\b", r"\b(?:send|forward|email|mail|deliver)(?:\s+it)?\s+to\s+([A-Z][a-z]+(?:\s+[A-Z][a-z]+)?)\b"
    dept, to = rf"\bsend\s+({_DEPT})\s+(?:the|a|an|some)\b", rf"\bto\s+{_NAME}\b"
    to_dept, mail = rf"\bto\s+(?:the\s+)?({_DEPT})\b", r"[\w.+-]+@[\w-]+\.[a-zA-Z]{2,}"
    me = (r"\bsend\s+(it\s+)?(back\s+)?to\s+me\b|\bforward\s+(it\s+)?to\s+me\b|\bback\s+to\s+me\b|\bsend\s+me\b|"
          r"\bi\s+(would|''d)\s+like\s+(to\s+receive|it\s+sent\s+to\s+me)\b|\bmy\s+way\b|\bto\s+my\s+(email|inbox|address)\b")
    values = {
        "type": ("'sender'", "'department'", "'named'", "'named'", "'email'", "'named'", "'department'", "'unknown'"),
        "display": (
            "'Back to sender (requestor)'", f"""'by department "' || {x(dept, 1, 'i')} || '"'""", f"""'by name "' || {x(send)} || '"'""",
            f"""'by name "' || {x(deliver)} || '"'""", x(mail, 0), f"""'by name "' || {x(to)} || '"'""",
            f"""'by department "' || {x(to_dept, 1, 'i')} || '"'""", "'Recipient not identified'"),
    }[part]
    tests = (
        f"regexp_matches({c}, '{me}', 'i')", f"regexp_matches({c}, '{dept}', 'i')", f"regexp_matches({c}, '{send}')",
        f"regexp_matches({c}, '{deliver}')", f"regexp_matches({c}, '{mail}')",
        f"regexp_matches({c}, '{to}') and not regexp_full_match(lower({x(to)}), '{_DEPT}')", f"regexp_matches({c}, '{to_dept}', 'i')")
    return "case " + " ".join(f"when {t} then {r}" for t, r in zip(tests, values)) + f" else {values[-1]} end"


@query("r17_recipient", duck(f"select uid, {who('body', 'type')} as type, {who('body', 'display')} as display from fx_messages", "fx_messages"))
def r17(v: Views) -> DataFrame:
    return v.messages.select("uid", R.recipient("body").alias("r")).select("uid", "r.type", "r.display")


PATTERNS = {
    "p1": "File-{% date(<mm>-<dd>-<yy>) %}.pdf",
    "p2": r"^Report.{% date(<yyyy>) %}\.pdf$",
    "p3": "Statement-{% date(<MONTH>-<yyyy>) %}.pdf",
    "p4": "Log {% date(<d> <MM>) %}",
}
_FILE_NAMES = """select o_orderkey, case o_orderkey % 5 when 0 then 'File-' || strftime(o_orderdate, '%m-%d-%y') || '.pdf'
    when 1 then 'Report-' || year(o_orderdate) || '.pdf' when 2 then 'Statement-' || strftime(o_orderdate, '%B-%Y') || '.pdf'
    when 3 then 'Log ' || day(o_orderdate) || ' ' || strftime(o_orderdate, '%b') || '.txt'
    else 'Report-' || year(o_orderdate) || '.pdf.bak' end as n from orders"""


def _file_names(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 5, F.col("o_orderdate")

    def dated(prefix: str, fmt: str, suffix: str):
        return F.concat(F.lit(prefix), F.date_format(d, fmt), F.lit(suffix))

    name = (
        F.when(k == 0, dated("File-", "MM-dd-yy", ".pdf"))
        .when(k == 1, dated("Report-", "yyyy", ".pdf"))
        .when(k == 2, dated("Statement-", "MMMM-yyyy", ".pdf"))
        .when(k == 3, dated("Log ", "d MMM", ".txt"))
        .otherwise(dated("Report-", "yyyy", ".pdf.bak"))
    )
    return v.table("orders").select("o_orderkey", name.alias("n"))


@query("r18_file_patterns", duck(
    r"""select o_orderkey, n, regexp_matches(n, 'File-\d{2}-\d{2}-\d{2}.pdf') as p1, regexp_matches(n, '^Report.\d{4}\.pdf$') as p2,
          regexp_matches(n, 'Statement-(January|February|March|April|May|June|July|August|September|October|November|December)-\d{4}.pdf') as p3,
          regexp_matches(n, 'Log \d{1,2} (Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)') as p4 from f""", f=_FILE_NAMES))
def r18(v: Views) -> DataFrame:
    return _file_names(v).select("o_orderkey", "n", *[FilePattern.parse(p).matches("n").alias(k) for k, p in PATTERNS.items()])


@query("r19_file_dates", duck(
    r"""select o_orderkey, n, strftime(case o_orderkey % 5 when 0 then make_date(2000 + cast(substr(n, 12, 2) as int), cast(substr(n, 6, 2) as int),
            cast(substr(n, 9, 2) as int)) when 2 then strptime(substr(n, 11), '%B-%Y.pdf') when 3 then DATE '2026-01-01' + to_months(cast(month(strptime(split_part(n, ' ', 3), '%b.txt')) - 1 as int))
              + to_days(cast(split_part(n, ' ', 2) as int) - 1)
            else make_date(cast(substr(n, 8, 4) as int), 1, 1) end, '%Y-%m-%d') as date
        from f""", f=_FILE_NAMES))
def r19(v: Views) -> DataFrame:
    k = F.col("o_orderkey") % 5
    dates = {i: FilePattern.parse(p).date_of("n", REF_DATE) for i, p in enumerate(PATTERNS.values())}
    chosen = F.when(k == 0, dates[0]).when(k == 2, dates[2]).when(k == 3, dates[3]).otherwise(dates[1])
    return _file_names(v).select("o_orderkey", "n", F.date_format(chosen, "yyyy-MM-dd").alias("date"))


@query("r21_invoice_data", duck(
    r"""select uid, case when n = '' then 'Unknown' else n end as number, case when a = '' then 'Not found' else a end as amount
        from (select uid, regexp_extract(subject, 'Invoice\s*#?\s*(\d+)', 1, 'i') as n, regexp_extract(body, '\$[\d,]+\.\d{2}') as a
              from fx_messages)""", "fx_messages"))
def r21(v: Views) -> DataFrame:
    return v.messages.select("uid", R.invoice_number("subject").alias("number"), R.invoice_amount("body").alias("amount"))


# --- rules and files -----------------------------------------------------------------------------

_DOC = """case when contains(doc_type, 'invoice') then 'Bills' when contains(doc_type, 'report') then 'Summaries' end"""
_EMAIL = """case when contains(lower(display), 'accounting') or contains('accounting', lower(display)) then 'ledger@example.net'
  when contains(lower(display), 'priya raman') or contains('priya raman', lower(display)) then 'priya.raman@example.net' end"""
_REQUESTS = f"""select s.uid, ty.doc_type, s.start, s."end", s.description, {who('s.body', 'type')} as type, {who('s.body', 'display')} as display,
    {_DOC} as folder, {_EMAIL} as email, case when email like 'priya%' then 'Extracts_Priya_.*'
      when contains(doc_type, 'invoice') then '{PATTERN}' end as pattern
  from s join ty on s.uid = ty.uid"""
_REQ = {**_TEXTS, "s": _spans_sql(), "ty": _TYPES_SQL, "q": _REQUESTS}
_PAIRS = f"""select q.uid, f.folder, f.file_name, strptime(substr(f.file_name, 9, 10), '%Y-%m-%d') as file_date
  from q join fx_files f on q.folder = f.folder and q.pattern = '{PATTERN}'
    and strptime(substr(f.file_name, 9, 10), '%Y-%m-%d') between coalesce(try_strptime(q.start, '%m/%d/%Y'), DATE '1970-01-01')
      and coalesce(try_strptime(q."end", '%m/%d/%Y'), DATE '9999-12-31') where q.description is not null"""


def request_sql(sql: str, **ctes: str) -> str:
    return duck(sql, "fx_messages", "fx_files", **_REQ, **ctes)


def _requests(v: Views) -> DataFrame:
    """Parsed requests without their texts."""
    parsed = read_requests(v.messages.select("uid", "body"), "body", RULES, REF_DATE).drop("body")
    return parsed.select("uid", "folder", "pattern", "range")


@query("j03_document_rule", request_sql(
    """select uid, doc_type, case when contains(doc_type, 'invoice') then 'invoice' when contains(doc_type, 'report') then 'report' else '*' end as rule,
         folder from q"""))
def j03(v: Views) -> DataFrame:
    typed = v.messages.select("uid", R.document_type("body").alias("doc_type"))
    found = typed.withColumn("d", M.resolve_document("doc_type", RULES))
    return found.select("uid", "doc_type", F.col("d.name").alias("rule"), "d.folder")


@query("j04_recipient_rule", request_sql("select uid, display, email, case when email like 'priya%' then 'Extracts_Priya_.*' end as file from q"))
def j04(v: Views) -> DataFrame:
    asked = v.messages.select("uid", R.recipient("body").alias("who"))
    found = asked.withColumn("c", M.resolve_recipient("who", RULES))
    return found.select("uid", "who.display", "c.email", "c.file")


_MAPS = """select 'acct0' as account, [{'n': 'invoice', 't': 'Bills'}, {'n': 'report', 't': 'Summaries'}, {'n': '*', 't': null}] as docs,
    [{'n': 'accounting', 't': 'ledger@example.net'}, {'n': 'Priya Raman', 't': 'priya.raman@example.net'}] as people
  union all select 'acct1', [{'n': 'REPORT', 't': 'Mixed'}, {'n': 'invoice', 't': 'Bills'}], [{'n': '%requestor%', 't': 'desk@example.net'}]"""


def _rule_rows(v: Views) -> DataFrame:
    """One map per account, as rows; the third account has none."""
    maps = [
        ("acct0", '{"documents": [{"name": "invoice", "folder": "Bills"}, {"name": "report", "folder": "Summaries"}, {"name": "*"}], "recipients": '
                  '[{"name": "accounting", "email": "ledger@example.net"}, {"name": "Priya Raman", "email": "priya.raman@example.net"}]}'),
        ("acct1", '{"documents": [{"name": "REPORT", "folder": "Mixed"}, {"name": "invoice", "folder": "Bills"}], '
                  '"recipients": [{"name": "%requestor%", "email": "desk@example.net"}]}'),
    ]
    return map_rules(v.spark.createDataFrame(maps, "account string, doc string"), "doc", "account")


@query("j03_document_rule_rows", duck(
    f"""select m.account, m.uid, (list_filter(docs, lambda x: x.n = '*' or contains(doc_type, lower(x.n)))[1]).n as rule,
          (list_filter(docs, lambda x: x.n = '*' or contains(doc_type, lower(x.n)))[1]).t as folder
        from fx_messages m join ty on ty.uid = m.uid left join ({_MAPS}) r on r.account = m.account""", "fx_messages", ty=_TYPES_SQL))
def j03_rows(v: Views) -> DataFrame:
    typed = v.messages.select("account", "uid", R.document_type("body").alias("doc_type"))
    found = M.resolve_documents(typed, "doc_type", _rule_rows(v), "account")
    return found.select("account", "uid", F.col("document.name").alias("rule"), "document.folder")


@query("j04_recipient_rule_rows", duck(
    f"""select account, uid, (fits[1]).t as email, len(fits) > 0 as resolved from (
          select m.account, m.uid, list_filter(coalesce(people, []), lambda x: x.n = '%requestor%' or contains(d, lower(x.n)) or contains(lower(x.n), d)) as fits
          from (select *, lower({who('body', 'display')}) as d from fx_messages) m left join ({_MAPS}) r on r.account = m.account)""", "fx_messages"))
def j04_rows(v: Views) -> DataFrame:
    asked = v.messages.select("account", "uid", R.recipient("body").alias("who"))
    found = M.resolve_recipients(asked, "who", _rule_rows(v), "account")
    return found.select("account", "uid", "contact.email", "contact.resolved")


@query("j05_request_files", request_sql("select uid, file_name, strftime(file_date, '%Y-%m-%d') as file_date from p", p=_PAIRS))
def j05(v: Views) -> DataFrame:
    pairs = M.request_files(_requests(v), v.files, RULES.file_patterns(), REF_DATE, "uid")
    return pairs.select("uid", "file_name", F.date_format("file_date", "yyyy-MM-dd").alias("file_date"))


@query("a09_match_counts", request_sql(
    "select q.uid, count(p.file_name) as n_files from q left join p on q.uid = p.uid group by q.uid", p=_PAIRS))
def a09(v: Views) -> DataFrame:
    return M.file_counts(_requests(v), v.files, RULES.file_patterns(), REF_DATE).select("uid", "n_files")


@query("a09_match_lists", request_sql(
    """select distinct strftime(coalesce(try_strptime(q.start, '%m/%d/%Y'), DATE '1970-01-01'), '%Y-%m-%d') as start,
         strftime(try_strptime(q."end", '%m/%d/%Y'), '%Y-%m-%d') as "end", p.file_name from q join p on q.uid = p.uid""", p=_PAIRS))
def a09_lists(v: Views) -> DataFrame:
    """File list of each distinct range; requests with the same range share it."""
    found = M.matching_files(v.files, M.wanted_ranges(_requests(v)), RULES.file_patterns(), REF_DATE)
    return found.select(
        F.date_format("start", "yyyy-MM-dd").alias("start"), F.date_format("end", "yyyy-MM-dd").alias("end"), "file_name"
    )


# What a request's summary says: its files by date and name, or that the listing lacks its folder.
_SUMMARY = """select z.uid, n_files, missing,
    'Document: ' || coalesce('"' || folder || '"', doc_type, 'could not be determined')
      || chr(10) || 'Date Range: ' || coalesce(coalesce(start, 'null') || ' to ' || "end" || '  (' || description || ')', 'none')
      || chr(10) || 'Recipient: ' || coalesce('"' || email || '"', display)
      || coalesce(chr(10) || 'Files matching:' || chr(10) || '   ' || names, '')
      || case when missing then chr(10) || 'Error: Folder not found: ' || folder else '' end as summary
  from (select *, folder is not null and pattern is not null and description is not null
      and folder not in (select folder from fx_files) as missing from z) z
    left join (select uid, string_agg(file_name, chr(10) || '   ' order by file_date, file_name) as names from p group by uid) l on l.uid = z.uid"""
_RESOLVED = """select q.*, n.n_files, case when description is null then 'NO_DATE_RANGE' when n_files = 0 then 'NO_FILES_MATCHED' else '' end as code
  from q join (select q.uid, count(p.file_name) as n_files from q left join p on q.uid = p.uid group by q.uid) n on q.uid = n.uid"""


@query("r20_request_resolution", request_sql(
    """select uid, doc_type, strftime(try_strptime(start, '%m/%d/%Y'), '%Y-%m-%d') as start, strftime(try_strptime("end", '%m/%d/%Y'), '%Y-%m-%d') as "end",
         description, type, display, folder, email, pattern, n_files, code from z""", p=_PAIRS, z=_RESOLVED))
def r20(v: Views) -> DataFrame:
    found = resolve_requests(v.messages, "body", v.files, RULES, REF_DATE, "uid")
    return found.select(
        "uid", "doc_type",
        F.date_format("range.start", "yyyy-MM-dd").alias("start"),
        F.date_format("range.end", "yyyy-MM-dd").alias("end"),
        "range.description", "who.type", "who.display", "folder", "contact.email", "pattern", "n_files", "verdict.code",
    )


@query("r20_request_summary", request_sql(
    "select uid, n_files, missing, length(summary) as n_chars, md5(summary) as summary_md5 from t", p=_PAIRS, z=_RESOLVED, t=_SUMMARY))
def r20_summary(v: Views) -> DataFrame:
    """The whole summary with its file list, by length and digest."""
    found = resolve_requests(v.messages, "body", v.files, RULES, REF_DATE, "uid")
    missing = F.coalesce(~F.col("folder_found"), F.lit(False)).alias("missing")
    return found.select("uid", "n_files", missing, F.length("summary").cast("bigint").alias("n_chars"), F.md5("summary").alias("summary_md5"))


@query("q03_request_gate", request_sql(
    "select folder, code, code = '' as valid, count(*) as n from z group by folder, code", p=_PAIRS, z=_RESOLVED))
def q03(v: Views) -> DataFrame:
    gated = gated_requests(v.messages.select("uid", "body"), "body", v.files, RULES, REF_DATE, "uid")
    return (
        gated.select("folder", F.col("verdict").alias("g"))
        .groupBy("folder", F.col("g.code").alias("code"), F.col("g.valid").alias("valid"))
        .agg(F.count("*").alias("n"))
    )


# --- results and blocks --------------------------------------------------------------------------

_CHECKS = (
    ("n_attachments = 0", "attachments", "EMPTY_ATTACHMENTS", "No attachments found or matched for the extracted date range"),
    ("trim(coalesce(date_range, '')) = ''", "dateRange", "NO_DATE_RANGE", "No date range could be extracted from the email"),
    ("trim(coalesce(recipient, '')) = ''", "recipient", "NO_RECIPIENT", "No recipient was resolved from the email"),
    ("trim(coalesce(cardholder, '')) = ''", "cardholder", "NO_CARDHOLDER", "No cardholder / account name was provided"),
)


def _failed(what: int) -> str:
    return "list_filter([" + ", ".join(f"case when {c[0]} then '{c[what]}' end" for c in _CHECKS) + "], lambda x: x is not null)"


_FIELDS = ("n_attachments", "date_range", "recipient", "cardholder")


@query("q01_result_errors", duck(
    f"select request_id, array_to_string({_failed(1)}, ',') as fields, array_to_string({_failed(2)}, ',') as codes from fx_results", "fx_results"))
def q01(v: Views) -> DataFrame:
    errors = v.results.select("request_id", Q.result_errors(*_FIELDS).alias("e"))
    return errors.select("request_id", F.array_join("e.field", ",").alias("fields"), F.array_join("e.code", ",").alias("codes"))


@query("q01_null_result", duck(
    f"""select request_id, case when request_id % 4 = 0 then 'result' else array_to_string({_failed(1)}, ',') end as fields,
          case when request_id % 4 = 0 then 'INVALID_RESULT' else array_to_string({_failed(2)}, ',') end as codes,
          case when request_id % 4 = 0 then 'Result is null or not an object' else array_to_string({_failed(3)}, ',') end as reasons
        from fx_results""", "fx_results"))
def q01_null(v: Views) -> DataFrame:
    whole = F.when(F.col("request_id") % 4 != 0, F.struct(*_FIELDS))
    errors = v.results.select("request_id", Q.result_errors(*_FIELDS, result=whole).alias("e"))
    return errors.select("request_id", *[F.array_join(f"e.{x}", ",").alias(f"{x}s") for x in ("field", "code", "reason")])


@query("q02_error_block", duck(
    f"""select request_id, case when len(f) > 0 then '-??EXTRACTION_ERROR' || chr(10) || 'CODE: ' || c[1] || chr(10) || 'REASON: ' || r[1]
          || case when len(f) > 1 then chr(10) || 'DETAIL: Additional failures: ' || array_to_string(f[2:], ', ') else '' end
          || chr(10) || '??EXTRACTION_ERROR-' end as block
        from (select request_id, {_failed(1)} as f, {_failed(2)} as c, {_failed(3)} as r from fx_results)""", "fx_results"))
def q02(v: Views) -> DataFrame:
    errors = v.results.select("request_id", Q.result_errors(*_FIELDS).alias("e"))
    return errors.select("request_id", Q.result_error("e").alias("block"))


def _block(name: str) -> str:
    return rf"nullif(regexp_extract(txt, '(?s)-\?\?{name}\n(.*?)\n\?\?{name}-', 1), '')"


@query("q04_parse_blocks", duck(
    f"""select request_id, {_block('DATE_RANGE')} as date_range, {_block('RECIPIENT')} as recipient, {_block('EXTRACTION_ERROR')} as error
        from fx_blocks""", "fx_blocks"))
def q04(v: Views) -> DataFrame:
    parsed = v.blocks.select("request_id", Q.parse_blocks("txt").alias("m"))
    return parsed.select(
        "request_id",
        F.col("m")["DATE_RANGE"].alias("date_range"),
        F.col("m")["RECIPIENT"].alias("recipient"),
        F.col("m")["EXTRACTION_ERROR"].alias("error"),
    )


@query("q05_blocks", duck(
    """select request_id, contains(txt, '-??EXTRACTION_ERROR') as is_error,
         '-??CARDHOLDER' || chr(10) || 'id ' || request_id || chr(10) || '??CARDHOLDER-' as block from fx_blocks""", "fx_blocks"))
def q05(v: Views) -> DataFrame:
    return v.blocks.select(
        "request_id",
        Q.is_extraction_error("txt").alias("is_error"),
        Q.wrap_block("CARDHOLDER", F.concat(F.lit("id "), "request_id")).alias("block"),
    )
