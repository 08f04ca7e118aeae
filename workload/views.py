"""The driver tables seen as mail: Spark DataFrames and the same views as DuckDB CTEs."""

from __future__ import annotations

import datetime as dt
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


REF_DATE = dt.date(2026, 3, 12)
REF = "DATE '2026-03-12'"

_SUBJECT = """case o_orderkey % 6
    when 0 then 'Invoice #' || cast(o_orderkey as string)
    when 1 then 'Monthly Report - ' || cast(year(o_orderdate) as string)
    when 2 then 'STOP'
    when 3 then 'Urgent: berth plan'
    when 4 then 'Re: mooring ticket #' || cast(o_orderkey % 1000 as string)
    else 'Please stop sending' end"""
_BODY = """case o_orderkey % 12
    when 0 then 'Please send me the invoice from ' || mdy || ' to 12/31/' || yy || ' total $1,204.50'
    when 1 then 'please send Priya Raman the reports for the last three months'
    when 2 then 'Forward the payroll data year to date to accounting'
    when 3 then 'I need the budget summary after ' || md
    when 4 then 'Could you send the safety records before ' || mdy
    when 5 then 'The harvest report ' || mdy || ' to 12/31/' || yy
    when 6 then 'Contract for March ' || yy || ' to Tomas Lindqvist'
    when 7 then 'usage ' || md || '-12/31 for ops@example.org'
    when 8 then 'Thanks, have a great day!'
    when 9 then 'Audit quarter to date, or this month'
    when 10 then 'Statement for the past twenty four weeks back to me'
    else case when o_orderkey % 24 = 11 then 'between Feb 1 and March 3rd, 2025' else 'hello' end end"""
_YMD = """cast(year({0}) as string) || '-' || lpad(cast(month({0}) as string), 2, '0') || '-'
    || lpad(cast(day({0}) as string), 2, '0')"""
_DATED = """(select *, cast(year(o_orderdate) as string) as yy,
    lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || lpad(cast(day(o_orderdate) as string), 2, '0') as md,
    lpad(cast(month(o_orderdate) as string), 2, '0') || '/' || lpad(cast(day(o_orderdate) as string), 2, '0')
      || '/' || cast(year(o_orderdate) as string) as mdy from orders)"""

MESSAGES = f"""
select 'acct' || cast(o_custkey % 3 as string) as account,
  case when o_orderkey % 7 = 0 then 'Archive' else 'INBOX' end as folder,
  o_orderkey as uid, o_orderdate as internal_date,
  case when o_orderkey % 11 = 0 then '$Sent' else '$Seen' end as flag,
  lower(replace(c_name, '#', '.')) || '@' || lower(c_mktsegment) || '.example.com' as from_addr,
  case when o_orderkey % 4 = 0 then '<bounce@' || lower(c_mktsegment) || '.example.net>' end as return_path,
  'desk' || cast(o_orderkey % 5 as string) || '@example.org, audit@example.org' as to_addrs,
  {_SUBJECT} as subject, {_BODY} as body
from {_DATED} o join customer c on o_custkey = c_custkey"""

ATTACHMENTS = f"""
select uid, part_no,
  case k when 0 then null when 1 then 'Invoice-' || ymd || '.pdf' when 2 then 'photo.jpg' else 'notes: draft.txt' end
    as disp_filename,
  case when k = 0 then 'pdf' else 'octet-stream' end as subtype,
  case when part_no % 5 = 4 or uid % 2 = 1 then 'inline' else 'attachment' end as disposition
from (select l_orderkey as uid, l_partkey % 4 as k,
        cast(row_number() over (partition by l_orderkey
          order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as bigint) as part_no,
        {_YMD.format('l_shipdate')} as ymd
      from lineitem) t"""

PARTS = """
select uid, 1 as path, 'text' as type, 'plain' as subtype from fx_messages where uid % 3 <> 0
union all select uid, 2 as path, 'text' as type, 'html' as subtype from fx_messages where uid % 2 = 0
union all select uid, 2 + part_no as path, 'application' as type, subtype from fx_attachments"""

TURNS = """
select conv_id, turn, role, trim(text) || chr(10) || case turn % 6
  when 0 then 'Any update?'
  when 1 then 'Please find the attached statement from 04/07/2025 to 05/19/2025'
  when 2 then 'Could you provide the numbers'
  when 3 then 'Are you able to join? yes'
  when 4 then '[cid:img' || cast(turn as string) || ']' || chr(10) || 'Thank you!'
  else 'Noted' end as body
from conversations"""

CHAINS_SPARK = """
select conv_id, array_join(transform(sort_array(collect_list(struct(turn, case when turn = 0 then body else
  concat(repeat('-', 40), chr(10), 'From: ', role, chr(10), 'Subject: c', conv_id, chr(10), chr(10), body) end as b))),
  x -> x.b), chr(10)) as raw_body
from fx_turns group by conv_id"""
CHAINS_DUCK = """
select conv_id, string_agg(case when turn = 0 then body else repeat('-', 40) || chr(10) || 'From: ' || role || chr(10)
  || 'Subject: c' || cast(conv_id as string) || chr(10) || chr(10) || body end, chr(10) order by turn) as raw_body
from fx_turns group by conv_id"""

SHORT = """
select uid, case uid % 5
  when 0 then 'Thank you, that settles it!' || chr(10) || 'Ilse Brandt' || chr(10) || '7 Quarry Street' || chr(10)
    || '(555) 010-7788 desk'
  when 1 then 'Thanks. Could you send the tide tables of May too.'
  when 2 then 'Thanks for it. First. Second. Third. Fourth.'
  when 3 then 'Got it, thanks a lot!' else 'See you at noon' end as body
from fx_messages"""

HTML_SPARK = """
select l_orderkey as uid, concat('<div><p>Order ', l_orderkey, '</p><table><tr><th>Part</th><th>Qty</th></tr>',
  array_join(transform(sort_array(collect_list(struct(l_linenumber, l_partkey, l_quantity,
    concat('<tr><td>', l_partkey, '</td><td>&nbsp;', cast(l_quantity as int), '</td></tr>') as h))), x -> x.h), ''),
  '</table></div>') as html
from lineitem group by l_orderkey"""
HTML_DUCK = """
select l_orderkey as uid, '<div><p>Order ' || cast(l_orderkey as string)
  || '</p><table><tr><th>Part</th><th>Qty</th></tr>' || string_agg('<tr><td>' || cast(l_partkey as string)
  || '</td><td>&nbsp;' || cast(cast(l_quantity as int) as string) || '</td></tr>', ''
  order by l_linenumber, l_partkey, l_quantity) || '</table></div>' as html
from lineitem group by l_orderkey"""

FOLDERS = """
select r_name as parent, n_name as name, r_name || '/' || n_name as full_path, n_nationkey as ord,
  case when n_nationkey % 5 = 0 then '$Sent' when n_nationkey % 5 = 1 then '$Archive' else '$HasNoChildren' end as attrib
from nation n join region r on n_regionkey = r_regionkey"""

FILES = f"""
select distinct case o_orderkey % 3 when 0 then 'Bills' when 1 then 'Tables' else 'Scans' end as folder,
  'Billing_' || {_YMD.format('o_orderdate')} || '.pdf' as file_name
from orders"""

RESULTS = """
select o_orderkey as request_id, case when o_orderkey % 3 = 0 then 0 else 2 end as n_attachments,
  case when o_orderkey % 5 <> 0 then '04/07/2025 to 05/19/2025' end as date_range,
  case when o_orderkey % 7 <> 0 then 'ops@example.org' else '  ' end as recipient,
  case when o_orderkey % 2 = 0 then 'Maple Freight' end as cardholder
from orders"""

BLOCKS = """
select request_id, '-??DATE_RANGE' || chr(10) || coalesce(date_range, 'none') || chr(10) || '??DATE_RANGE-' || chr(10)
  || '-??RECIPIENT' || chr(10) || recipient || chr(10) || '??RECIPIENT-'
  || case when request_id % 9 = 0 then chr(10) || '-??EXTRACTION_ERROR' || chr(10) || 'CODE: NO_FILES_MATCHED'
     || chr(10) || '??EXTRACTION_ERROR-' else '' end as txt
from fx_results"""

NUMBERED = """
select *, row_number() over (partition by account, folder order by internal_date desc, uid) as email_no
from fx_messages where flag <> '$Sent'"""

# view -> (views it reads, DuckDB text, Spark text)
_VIEWS = {
    "fx_messages": ((), MESSAGES, MESSAGES),
    "fx_attachments": ((), ATTACHMENTS, ATTACHMENTS),
    "fx_parts": (("fx_messages", "fx_attachments"), PARTS, PARTS),
    "fx_turns": ((), TURNS, TURNS),
    "fx_chains": (("fx_turns",), CHAINS_DUCK, CHAINS_SPARK),
    "fx_short": (("fx_messages",), SHORT, SHORT),
    "fx_html": ((), HTML_DUCK, HTML_SPARK),
    "fx_folders": ((), FOLDERS, FOLDERS),
    "fx_files": ((), FILES, FILES),
    "fx_results": ((), RESULTS, RESULTS),
    "fx_blocks": (("fx_results",), BLOCKS, BLOCKS),
    "numbered": (("fx_messages",), NUMBERED, NUMBERED),
}


def duck(sql: str, *views: str, **ctes: str) -> str:
    """DuckDB text with the views (and what they read) in front; ``ctes`` follow in order."""
    ordered: dict[str, str] = {}

    def add(name: str) -> None:
        needs, text, _ = _VIEWS[name]
        for n in needs:
            add(n)
        ordered.setdefault(name, text)

    for view in views:
        add(view)
    parts = [f"{n} as ({t})" for n, t in {**ordered, **ctes}.items()]
    return f"with {', '.join(parts)} {sql}" if parts else sql


class Views:
    """Spark side of the views for one table directory."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _sql(self, view: str, *tables: str) -> DataFrame:
        for t in tables:
            self.table(t).createOrReplaceTempView(t)
        for need in _VIEWS[view][0]:
            getattr(self, need.removeprefix("fx_")).createOrReplaceTempView(need)
        return self.spark.sql(_VIEWS[view][2])

    @cached_property
    def messages(self) -> DataFrame:
        return self._sql("fx_messages", "orders", "customer").withColumn("flags", F.array("flag"))

    @cached_property
    def attachments(self) -> DataFrame:
        return self._sql("fx_attachments", "lineitem")

    @cached_property
    def parts(self) -> DataFrame:
        return self._sql("fx_parts")

    @cached_property
    def turns(self) -> DataFrame:
        return self._sql("fx_turns", "conversations")

    @cached_property
    def chains(self) -> DataFrame:
        return self._sql("fx_chains")

    @cached_property
    def short(self) -> DataFrame:
        return self._sql("fx_short")

    @cached_property
    def html(self) -> DataFrame:
        return self._sql("fx_html", "lineitem")

    @cached_property
    def folders(self) -> DataFrame:
        return self._sql("fx_folders", "nation", "region").withColumn("attribs", F.array("attrib"))

    @cached_property
    def files(self) -> DataFrame:
        return self._sql("fx_files", "orders")

    @cached_property
    def results(self) -> DataFrame:
        return self._sql("fx_results", "orders")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._sql("fx_blocks")
