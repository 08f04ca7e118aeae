"""Sources, projections, filters, order and counts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import patterns as P
from mailloom.functions.dates import placeholders, within
from mailloom.functions.text import has_text, preview, trim_ws
from mailloom.operators import counts, filters, numbering
from mailloom.operators.bodies import body_with_fallback, parts_of, refetched, render, shown_body
from mailloom.operators.filters import all_of, criteria
from mailloom.operators.folders import move_messages, moved_messages
from mailloom.plans.search import matching_positions, search
from mailloom.sources import messages as src
from mailloom.sources import sinks
from workload.registry import query
from workload.views import REF_DATE, Views, duck

FOLDER = ("account", "folder")


def ymd(c: str = "internal_date"):
    return F.date_format(c, "yyyy-MM-dd")


YMD = "strftime(internal_date, '%Y-%m-%d')"

# --- sources -------------------------------------------------------------------------------------


@query("s01_header_scan", duck(
    f"select account, folder, uid, {YMD} as day, from_addr, return_path, to_addrs, subject from fx_messages", "fx_messages"))
def s01(v: Views) -> DataFrame:
    return src.headers(v.messages).withColumn("day", ymd()).drop("internal_date", "flags")


@query("s02_folder_selection", duck("select account, folder, uid, subject from fx_messages where folder = 'Archive'", "fx_messages"))
def s02(v: Views) -> DataFrame:
    return src.select_mailbox(v.messages, folder="Archive").select(*FOLDER, "uid", "subject")


@query("s03_account_selection", duck(
    "select account, folder, uid, subject from fx_messages where account = 'acct1' and folder = 'INBOX'", "fx_messages"))
def s03(v: Views) -> DataFrame:
    return src.select_mailbox(v.messages, "acct1", "INBOX").select(*FOLDER, "uid", "subject")


@query("s04_part_lookup", duck(
    """select m.account, m.folder, m.uid, cast(p.path as bigint) as path, p.type, p.subtype
       from fx_messages m join fx_parts p on m.uid = p.uid""", "fx_messages", "fx_parts"))
def s04(v: Views) -> DataFrame:
    found = parts_of(v.messages.select(*FOLDER, "uid"), v.parts, ("uid",))
    return found.withColumn("path", F.col("path").cast("bigint"))


@query("s05_refetch", duck(
    """select uid, coalesce(case when uid % 6 = 1 then null when uid % 6 = 2 then null else body end,
         'raw ' || subject) as body from fx_messages""", "fx_messages"))
def s05(v: Views) -> DataFrame:
    blank = F.when(F.col("uid") % 6 == 1, F.lit(" \n")).when(F.col("uid") % 6 == 2, F.lit(None)).otherwise(F.col("body"))
    fetched = v.messages.select("uid", blank.alias("body"))
    # Every third raw row comes twice, once blank.
    raw = v.messages.select("uid", F.concat(F.lit("raw "), "subject").alias("raw_text"))
    raw = raw.unionByName(raw.filter("uid % 3 = 1").withColumn("raw_text", F.lit(" ")))
    return refetched(fetched, raw, keys=("uid",))


_RECORD_SQL = """select email_no, from_addr, to_addrs, {ymd} as day, subject, body,
  case when uid % 2 = 0 then 'a.pdf' else 'false' end as attachment, uid from numbered"""


def _records(v: Views) -> DataFrame:
    return numbering.with_numbers(filters.not_sent(v.messages)).select(
        "email_no",
        "uid",
        F.col("from_addr").alias("from"),
        F.col("to_addrs").alias("to"),
        ymd().alias("date"),
        "subject",
        F.when(F.col("uid") % 2 == 0, "a.pdf").otherwise("false").alias("attachment"),
        "body",
    )


@query("s09_text_blocks", duck(
    """select uid, '=== Email #' || email_no || ' ===' || chr(10) || 'From: ' || from_addr || chr(10) || 'To: ' || to_addrs
         || chr(10) || 'Date: ' || day || chr(10) || 'Subject: ' || subject || chr(10) || 'Attachment: ' || attachment
         || chr(10) || 'Body: ' || body as value from r""", "numbered", r=_RECORD_SQL.format(ymd=YMD)))
def s09(v: Views) -> DataFrame:
    return _records(v).select("uid", sinks.text_block(F.col("email_no")).alias("value"))


@query("s10_json_records", duck(
    """select uid, cast(json_object('Email', email_no, 'From', from_addr, 'To', list_transform(string_split(to_addrs, ','),
         lambda x: trim(x)), 'Date', day, 'Subject', subject, 'Attachment', attachment, 'Body', body) as varchar) as value
       from r""", "numbered", r=_RECORD_SQL.format(ymd=YMD)))
def s10(v: Views) -> DataFrame:
    return _records(v).select("uid", sinks.json_record().alias("value"))


_MOVED_SQL = """select account, folder as from_folder, uid as from_uid,
  coalesce((select max(t.uid) from fx_messages t where t.account = m.account and t.folder = 'Archive'), 0)
    + row_number() over (partition by account order by folder, uid) as uid
  from fx_messages m where folder <> 'Archive' and contains(lower(subject), 'invoice')"""


@query("s12_move_messages", duck(
    """select account, folder, uid, subject from fx_messages where folder = 'Archive' or not contains(lower(subject), 'invoice')
       union all select moved.account, 'Archive', moved.uid, m.subject
       from moved join fx_messages m on m.account = moved.account and m.folder = from_folder and m.uid = from_uid""",
    "fx_messages", moved=_MOVED_SQL))
def s12(v: Views) -> DataFrame:
    listed = v.spark.createDataFrame([("INBOX", "INBOX", [], 0), ("Archive", "Archive", ["\\Archive"], 1)],
                                     "name string, full_path string, attribs array<string>, ord int")
    return move_messages(v.messages, "archive", filters.subject_contains("invoice"), listed).select(*FOLDER, "uid", "subject")


@query("s12_moved_numbers", duck("select account, from_folder, from_uid, uid from moved", "fx_messages", moved=_MOVED_SQL))
def s12_numbers(v: Views) -> DataFrame:
    moved = moved_messages(v.messages, "Archive", filters.subject_contains("invoice"))
    return moved.select("account", "from_folder", "from_uid", "uid")


# --- projections ---------------------------------------------------------------------------------


def _fields(v: Views) -> DataFrame:
    return v.messages.select(
        "uid",
        F.col("from_addr").alias("from"),
        F.col("to_addrs").alias("to"),
        ymd().alias("date"),
        "subject",
        F.lit("false").alias("attachment"),
        shown_body("body").alias("body"),
    )


@query("p01_one_field", duck("select uid, subject from fx_messages", "fx_messages"))
def p01(v: Views) -> DataFrame:
    return sinks.project(_fields(v), "subject", "uid")


@query("p01_all_fields", duck(
    f"""select uid, from_addr as "from", to_addrs as "to", {YMD} as "date", subject, 'false' as attachment, body
        from fx_messages""", "fx_messages"))
def p01_all(v: Views) -> DataFrame:
    return sinks.project(_fields(v), "anything", "uid")


@query("p02_header_values", duck(
    "select uid, from_addr || ' ' || to_addrs as joined, from_addr as first from fx_messages", "fx_messages"))
def p02(v: Views) -> DataFrame:
    values = F.array("from_addr", "to_addrs")
    return v.messages.select("uid", src.joined_header(values).alias("joined"), src.first_header(values).alias("first"))


@query("p03_split_recipients", duck(
    """select uid, trim(unnest(string_split(to_addrs, ','))) as recipient from fx_messages""", "fx_messages"))
def p03(v: Views) -> DataFrame:
    return v.messages.select("uid", F.explode(src.split_recipients(F.col("to_addrs"))).alias("recipient"))


@query("p04_body_preview",
       "select doc_id, case when length(text) > 200 then substr(text, 1, 200) || '...' else text end as preview from documents")
def p04(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", shown_body("text").alias("preview"))


@query("p05_log_preview", "select doc_id, substr(text, 1, 100) || '...' as preview from documents")
def p05(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", preview("text", 100, always=True).alias("preview"))


_FX_TEXT = """'Order ' || uid || chr(10) || '| Part | Qty |' || chr(10) || (select string_agg('| ' || l_partkey || ' | '
  || cast(l_quantity as int) || ' |', chr(10) order by l_linenumber, l_partkey, l_quantity)
  from lineitem where l_orderkey = h.uid)"""


@query("p06_body_modes", duck(
    f"""select uid, html as as_html, {_FX_TEXT} as as_text,
          (select string_agg(cast(l_partkey as varchar), ',' order by l_linenumber, l_partkey, l_quantity)
           from lineitem where l_orderkey = h.uid) as part_column, html as plain from fx_html h""", "fx_html"))
def p06(v: Views) -> DataFrame:
    table = render("html", True, "json:table")
    return v.html.select(
        "uid",
        render("html", True, "html").alias("as_html"),
        render("html", True).alias("as_text"),
        F.array_join(table["Part"], ",").alias("part_column"),
        render("html", False).alias("plain"),
    )


_BODY_SOURCES = f"""select m.uid, case when m.uid % 2 = 0 then h.html end as html, {_FX_TEXT.replace('uid', 'm.uid').replace('h.m.uid', 'm.uid')} as html_text,
  case when m.uid % 3 <> 0 then m.body when m.uid % 4 <> 3 then ' ' end as txt,
  case when m.uid % 5 <> 0 then 'raw ' || m.subject end as raw
  from fx_messages m left join fx_html h on m.uid = h.uid"""


def _body_sources(v: Views) -> DataFrame:
    uid = F.col("uid")
    joined = v.messages.join(v.html, "uid", "left")
    return joined.select(
        "uid",
        F.when(uid % 2 == 0, F.col("html")).alias("html"),
        F.when(uid % 3 != 0, F.col("body")).when(uid % 4 != 3, " ").alias("text"),
        F.when(uid % 5 != 0, F.concat(F.lit("raw "), "subject")).alias("raw"),
    )


@query("p07_body_fallback", duck(
    """select uid, coalesce(case when html is not null then html_text end, case when trim(txt) <> '' then txt end, raw, '') as body
       from b""", "fx_messages", "fx_html", b=_BODY_SOURCES))
def p07(v: Views) -> DataFrame:
    return _body_sources(v).select("uid", body_with_fallback("html", "text", "raw").alias("body"))


@query("p08_filter_body", duck(
    """select uid from b where contains(lower(coalesce(case when html is not null then html_text end,
         case when trim(txt) <> '' then txt end, '')), 'order 1')""", "fx_messages", "fx_html", b=_BODY_SOURCES))
def p08(v: Views) -> DataFrame:
    body = body_with_fallback("html", "text")
    return _body_sources(v).filter(filters.body_contains("ORDER 1", body)).select("uid")


@query("p09_non_blank", r"""select doc_id, n, regexp_matches(t, '[^\s]') as has_text from (select doc_id, length(text) as n,
    case when doc_id % 7 = 0 then '  ' || chr(10) || chr(9) else text end as t from documents)""")
def p09(v: Views) -> DataFrame:
    text = F.when(F.col("doc_id") % 7 == 0, "  \n\t").otherwise(F.col("text"))
    return v.table("documents").select("doc_id", F.length("text").cast("bigint").alias("n"), has_text(text).alias("has_text"))


# --- filters -------------------------------------------------------------------------------------


def _uids(v: Views, predicate) -> DataFrame:
    return v.messages.filter(predicate).select("uid")


def _uid_sql(where: str) -> str:
    return duck(f"select uid from fx_messages where {where}", "fx_messages")


@query("f01_from_contains", _uid_sql("contains(lower(from_addr), 'machinery.example')"))
def f01(v: Views) -> DataFrame:
    return _uids(v, filters.from_contains("Machinery.example"))


@query("f02_subject_contains", _uid_sql("contains(lower(subject), 'invoice')"))
def f02(v: Views) -> DataFrame:
    return _uids(v, filters.subject_contains("INVOICE"))


@query("f03_body_contains", _uid_sql("contains(lower(body), 'report')"))
def f03(v: Views) -> DataFrame:
    return _uids(v, filters.body_contains("Report"))


@query("f04_sender_contains", _uid_sql("contains(lower(coalesce(return_path, '')), 'building')"))
def f04(v: Views) -> DataFrame:
    return _uids(v, filters.sender_contains("building"))


@query("f05_has_attachment", duck(
    "select uid from fx_messages m where exists (select 1 from fx_attachments a where a.uid = m.uid)", "fx_messages", "fx_attachments"))
def f05(v: Views) -> DataFrame:
    return filters.with_attachment(v.messages, v.attachments, ("uid",)).select("uid")


@query("f06_conjunction", duck(
    """select uid from fx_messages m where contains(lower(from_addr), 'furniture') and contains(lower(subject), 'invoice')
         and contains(lower(coalesce(return_path, '')), 'bounce') and contains(lower(body), 'send')
         and exists (select 1 from fx_attachments a where a.uid = m.uid)""", "fx_messages", "fx_attachments"))
def f06(v: Views) -> DataFrame:
    hit = v.messages.filter(criteria(from_="furniture", subject="invoice", body="send", sender="bounce"))
    return filters.with_attachment(hit, v.attachments, ("uid",)).select("uid")


@query("f07_not_sent", _uid_sql("flag <> '$Sent'"))
def f07(v: Views) -> DataFrame:
    return filters.not_sent(v.messages).select("uid")


@query("f08_template_pattern", _uid_sql(r"""regexp_matches(subject, 'Invoice #[0-9]*7$', 'i')
    or regexp_matches(subject, 'report - 1997', 'i') or contains(lower(subject), 'urgent')"""))
def f08(v: Views) -> DataFrame:
    sources = ("invoice {{ #[0-9]*7$ }}", "Report - {{ dates.lastYear }}", "URGENT")
    found = [P.matches("subject", P.template_pattern(s, dt.date(1998, 3, 12))) for s in sources]
    return _uids(v, found[0] | found[1] | found[2])


@query("f09_pattern_test", duck(
    r"""select uid, regexp_matches(body, 'march [0-9]{4}', 'i') as by_regex, contains(lower(body), 'thanks') as by_text,
          true as by_none, contains(lower(body), '[0-9') as by_broken from fx_messages""", "fx_messages"))
def f09(v: Views) -> DataFrame:
    def found(source: str | None):
        return P.matches("body", P.template_pattern(source, REF_DATE))

    return v.messages.select(
        "uid",
        found("{{ dates.month }} {{ [0-9]{4} }}").alias("by_regex"),
        found("thanks").alias("by_text"),
        found(None).alias("by_none"),
        found("{{ [0-9 }}").alias("by_broken"),
    )


@query("f10_date_placeholders", """
    select o_orderkey, strftime(o_orderdate, '%Y') || '|' || (year(o_orderdate) - 1) || '|' || (year(o_orderdate) + 1) || '|'
      || strftime(o_orderdate, '%B') || '|' || strftime(o_orderdate - interval 1 month, '%B') || '|'
      || strftime(o_orderdate, '%b') || '|' || strftime(o_orderdate - interval 1 month, '%b') || '|'
      || strftime(o_orderdate, '%d') || '|' || quarter(o_orderdate) || '|'
      || quarter(o_orderdate - interval 3 month) || '|' || strftime(o_orderdate, '%y') as placeholders
    from orders""")
def f10(v: Views) -> DataFrame:
    values = placeholders("o_orderdate").values()
    return v.table("orders").select("o_orderkey", F.concat_ws("|", *values).alias("placeholders"))


@query("f11_glob_pattern", duck(
    "select uid, part_no, disp_filename from fx_attachments where regexp_matches(lower(disp_filename), '^invoice-199.-.*\\.pdf$')",
    "fx_attachments"))
def f11(v: Views) -> DataFrame:
    hit = P.matches("disp_filename", P.glob_pattern("invoice-199?-*.PDF"))
    return v.attachments.filter(hit).select("uid", "part_no", "disp_filename")


@query("f12_ignore_messages", _uid_sql(
    r"""not (contains(lower(from_addr), 'machinery') or regexp_matches(from_addr, '^customer\.0000000.9@.*$', 'i')
          or regexp_matches(subject, '^stop$', 'i') or contains(lower(body), 'payroll'))"""))
def f12(v: Views) -> DataFrame:
    text = "[from=[machinery, customer.0000000?9@*], subject={{^stop$}}, body=\"payroll\"]"
    return filters.not_ignored(v.messages, P.ignore_rules(text, REF_DATE)).select("uid")


@query("f14_stop_requests", duck("select uid, from_addr from fx_messages where lower(subject) = 'stop'", "fx_messages"))
def f14(v: Views) -> DataFrame:
    return v.messages.filter(filters.is_stop_request()).select("uid", "from_addr")


@query("f15_unsubscribe_hint", duck("select uid, contains(lower(subject), 'stop') as hint from fx_messages", "fx_messages"))
def f15(v: Views) -> DataFrame:
    return v.messages.select("uid", filters.hints_unsubscribe().alias("hint"))


@query("f16_date_range", """
    select o_orderkey, d >= DATE '1996-02-01' and d <= DATE '1997-03-31' as closed, d >= DATE '1999-01-01' as open_end,
      d <= DATE '1995-12-31' as open_start from (select o_orderkey, cast(o_orderdate as date) as d from orders)""")
def f16(v: Views) -> DataFrame:
    d = F.to_date("o_orderdate")

    def day(*ymd: int):
        return F.lit(dt.date(*ymd))

    return v.table("orders").select(
        "o_orderkey",
        within(d, day(1996, 2, 1), day(1997, 3, 31)).alias("closed"),
        within(d, day(1999, 1, 1), None).alias("open_end"),
        within(d, None, day(1995, 12, 31)).alias("open_start"),
    )


@query("f17_urgent", _uid_sql("regexp_matches(lower(subject), 'urgent|asap|critical|emergency')"))
def f17(v: Views) -> DataFrame:
    return _uids(v, filters.is_urgent())


@query("f18_older_than", _uid_sql("internal_date < TIMESTAMP '1999-05-16 00:00:00'"))
def f18(v: Views) -> DataFrame:
    return _uids(v, filters.older_than(30, dt.date(1999, 6, 15)))


# --- order and limits ----------------------------------------------------------------------------

KEEP = "account, folder, uid, email_no"
_NUM = ("account", "folder", "uid", "email_no")


def _inbox(v: Views) -> DataFrame:
    return filters.not_sent(v.messages)


def _numbered_sql(where: str) -> str:
    return duck(f"select {KEEP} from numbered where {where}", "numbered")


@query("w01_message_numbers", _numbered_sql("true"))
def w01(v: Views) -> DataFrame:
    return numbering.with_numbers(_inbox(v)).select(*_NUM)


@query("l01_newest_first", duck(f"select uid, {YMD} as day, subject from fx_messages order by internal_date desc, uid", "fx_messages"))
def l01(v: Views) -> DataFrame:
    return numbering.newest_first(v.messages.select("uid", "internal_date", "subject")).select("uid", ymd().alias("day"), "subject")


@query("l02_first_n", _numbered_sql("email_no <= 25"))
def l02(v: Views) -> DataFrame:
    return numbering.newest(_inbox(v), numbering.default_count("json:table")).select(*_NUM)


@query("l03_nth", _numbered_sql("email_no = 42"))
def l03(v: Views) -> DataFrame:
    return numbering.nth(_inbox(v), 42).select(*_NUM)


@query("l04_range", _numbered_sql("email_no between 5 and 60 and contains(lower(subject), 'report')"))
def l04(v: Views) -> DataFrame:
    return numbering.number_range(_inbox(v), "5-60").filter(filters.subject_contains("report")).select(*_NUM)


@query("l04_open_range", _numbered_sql("email_no >= 100"))
def l04_open(v: Views) -> DataFrame:
    return numbering.number_range(_inbox(v), "100-last").select(*_NUM)


@query("l05_stop_processed", duck(
    """select account, folder, uid, subject from (select *, row_number() over (partition by account, folder
         order by internal_date desc, uid) as n from fx_messages where flag <> '$Sent' and not contains(lower(subject), 'stop'))
       where n <= 10""", "fx_messages"))
def l05(v: Views) -> DataFrame:
    kept = ~filters.hints_unsubscribe()
    return numbering.first_processed(_inbox(v), 10, kept).select("account", "folder", "uid", "subject")


_MATCHES = """select account, folder, uid, email_no from (select *, row_number() over (partition by account, folder
  order by email_no) as n from numbered where contains(lower(subject), 'invoice') {pool}) where n <= {n}"""


@query("l06_stop_matches", duck(_MATCHES.format(pool="", n=3), "numbered"))
def l06(v: Views) -> DataFrame:
    return search(v.messages, filters.subject_contains("invoice"), stop_after=3).select(*_NUM)


@query("l07_match_in_pool", duck(_MATCHES.format(pool="and email_no <= 20", n=2), "numbered"))
def l07(v: Views) -> DataFrame:
    return search(v.messages, filters.subject_contains("invoice"), pool=20, stop_after=2).select(*_NUM)


@query("l08_first_with_attachment", duck(
    """select account, folder, uid, email_no from (select *, row_number() over (partition by account, folder order by email_no) as n
         from numbered m where exists (select 1 from fx_attachments a where a.uid = m.uid)) where n = 1""",
    "numbered", "fx_attachments"))
def l08(v: Views) -> DataFrame:
    with_parts = _inbox(v).join(v.attachments.select("uid").distinct(), "uid", "left_semi")
    return numbering.first_matches(_inbox(v), F.lit(True), 1, matches=with_parts).select(*_NUM)


# --- counts --------------------------------------------------------------------------------------


@query("a01_count", duck("select count(*) as n from fx_messages where contains(lower(from_addr), 'building')", "fx_messages"))
def a01(v: Views) -> DataFrame:
    return counts.count_messages(v.messages, filters.from_contains("building"))


@query("a01_count_in_range", duck(
    """select account, folder, count(*) filter (where email_no between 50 and 900 and contains(lower(subject), 'report')) as n
       from numbered group by all""", "numbered"))
def a01_range(v: Views) -> DataFrame:
    return counts.count_by_folder(_inbox(v), filters.subject_contains("report"), "50-900")


@query("a02_positions", duck(
    """select account, folder, email_no from numbered where contains(lower(from_addr), 'household')
         and contains(lower(subject), 'invoice')""", "numbered"))
def a02(v: Views) -> DataFrame:
    return matching_positions(v.messages, criteria(from_="household", subject="invoice"))


@query("a02_position_list", duck(
    """select account, folder, coalesce(string_agg(email_no, ',' order by email_no) filter (where contains(lower(subject), 'invoice')), '')
         as positions from numbered where email_no <= 100 group by all""", "numbered"))
def a02_list(v: Views) -> DataFrame:
    return counts.position_list(_inbox(v), filters.subject_contains("invoice"), 100)


@query("a02_position_pieces", duck(
    """select account, folder, cast((email_no - 1) // 500 + 1 as bigint) as piece, string_agg(email_no, ',' order by email_no) as positions
       from numbered where contains(lower(subject), 'invoice') group by all
       union all select account, folder, 1, '' from numbered group by all having not bool_or(contains(lower(subject), 'invoice'))""", "numbered"))
def a02_pieces(v: Views) -> DataFrame:
    return counts.position_pieces(_inbox(v), filters.subject_contains("invoice"), 500)


@query("a03_any_match", duck("select bool_or(contains(lower(subject), 'ticket #77')) as found from fx_messages", "fx_messages"))
def a03(v: Views) -> DataFrame:
    return counts.any_match(v.messages, filters.subject_contains("ticket #77"))


@query("a03_any_match_by_folder", duck(
    "select account, folder, bool_or(contains(lower(body), 'march 1995')) as found from fx_messages group by all", "fx_messages"))
def a03_folder(v: Views) -> DataFrame:
    return counts.any_match_by_folder(v.messages, filters.body_contains("march 1995"))
