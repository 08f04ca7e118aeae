"""Attachments, parts, folders, ingestion, HTML and tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import patterns as P
from mailloom.functions.html import html_to_text
from mailloom.functions.mime import attachment_name, is_attachment, safe_name
from mailloom.functions.text import preview
from mailloom.operators import attachments as A
from mailloom.operators import bodies, filters, folders, tasks
from mailloom.operators.mapping import list_files
from mailloom.sources import mime_archive
from mailloom.sources.request_map import map_rules
from workload.registry import query
from workload.views import REF_DATE, Views, duck

MSG = ("account", "folder", "uid")

# Attachment rows with every name source, so that all naming rules occur.
_PARTS_SQL = """select uid, part_no, case part_no % 4 when 0 then 'application' when 1 then 'image' when 2 then 'APPLICATION'
    else 'text' end as type, case when part_no % 6 = 5 then null else upper(subtype) end as subtype,
  case when part_no % 3 = 0 then null else disposition end as disposition,
  case when part_no % 2 = 0 then disp_filename when part_no % 7 = 0 then '' end as disp_filename,
  case when part_no % 5 = 0 then 'named ' || part_no end as param_name,
  case when part_no % 5 = 1 and uid % 8 = 0 then 'file/' || uid end as param_filename from fx_attachments"""
_KEPT_SQL = """select *, coalesce(nullif(disp_filename, ''), nullif(param_name, ''), nullif(param_filename, ''),
    'attachment.' || lower(nullif(subtype, '')), 'attachment') as name from p
  where coalesce(lower(disposition), '') = 'attachment' or coalesce(disp_filename, '') <> '' or coalesce(param_name, '') <> ''
    or coalesce(param_filename, '') <> '' or (lower(type) = 'application'
      and (coalesce(lower(disposition), '') = 'inline' or coalesce(subtype, '') <> ''))"""


def _parts(v: Views) -> DataFrame:
    n, uid = F.col("part_no"), F.col("uid")
    kinds = F.array(F.lit("application"), F.lit("image"), F.lit("APPLICATION"), F.lit("text"))
    return v.attachments.select(
        "uid",
        "part_no",
        F.get(kinds, (n % 4).cast("int")).alias("type"),
        F.when(n % 6 != 5, F.upper("subtype")).alias("subtype"),
        F.when(n % 3 != 0, F.col("disposition")).alias("disposition"),
        F.when(n % 2 == 0, F.col("disp_filename")).when(n % 7 == 0, "").alias("disp_filename"),
        F.when(n % 5 == 0, F.concat(F.lit("named "), n.cast("string"))).alias("param_name"),
        F.when((n % 5 == 1) & (uid % 8 == 0), F.concat(F.lit("file/"), uid.cast("string"))).alias("param_filename"),
    )


_NAMES = ("disp_filename", "param_name", "param_filename")

# Attachments as the fixture names them, with their message.
_NAMED_SQL = """select m.account, m.folder, m.internal_date, a.uid, a.part_no, coalesce(disp_filename, 'attachment.' || subtype) as name
  from fx_attachments a join fx_messages m on a.uid = m.uid"""


def _named(v: Views) -> DataFrame:
    own = v.attachments.withColumn("type", F.lit("application"))
    rows = A.attachment_parts(own).select("uid", "part_no", "name")
    return v.messages.select(*MSG, "internal_date").join(rows, "uid")


# --- parts ---------------------------------------------------------------------------------------


def _first_sql(subtype: str) -> str:
    return duck(
        f"""select uid, cast(min(path) as bigint) as path, arg_min(type, path) as type from fx_parts
            where lower(type) = 'text' and lower(subtype) = '{subtype}' group by uid""", "fx_parts")


def _first(v: Views, subtype: str) -> DataFrame:
    found = bodies.first_part(v.parts, subtype, ("uid",))
    return found.select("uid", F.col("path").cast("bigint").alias("path"), "type")


@query("m01_first_text_part", _first_sql("plain"))
def m01(v: Views) -> DataFrame:
    return _first(v, "plain")


@query("m02_first_html_part", _first_sql("html"))
def m02(v: Views) -> DataFrame:
    return _first(v, "html")


@query("m03_is_attachment", duck(
    "select uid, part_no, (uid, part_no) in (select (uid, part_no) from k) as is_attachment from p", "fx_attachments",
    p=_PARTS_SQL, k=_KEPT_SQL))
def m03(v: Views) -> DataFrame:
    found = is_attachment("disposition", "type", "subtype", *_NAMES)
    return _parts(v).select("uid", "part_no", found.alias("is_attachment"))


@query("m04_attachment_name", duck("select uid, part_no, name from k", "fx_attachments", p=_PARTS_SQL, k=_KEPT_SQL))
def m04(v: Views) -> DataFrame:
    return A.attachment_parts(_parts(v)).select("uid", "part_no", "name")


@query("m05_safe_name", duck(
    r"""select uid, part_no, regexp_replace(n, '[/\\:*?"<>|]', '_', 'g') as name
        from (select uid, part_no, coalesce(disp_filename, 'a*b?/c"d<e>f|g\h') as n from fx_attachments)""", "fx_attachments"))
def m05(v: Views) -> DataFrame:
    raw = F.coalesce("disp_filename", F.lit('a*b?/c"d<e>f|g\\h'))
    return v.attachments.select("uid", "part_no", safe_name(raw).alias("name"))


@query("m06_summary_with_raw", duck(
    """select m.uid, coalesce(string_agg(case when a.part_no % 2 = m.uid % 4 / 2 then a.name end, ', ' order by a.part_no),
         string_agg(case when m.uid % 3 = 0 then a.name end, ', ' order by a.part_no), 'false') as summary
       from fx_messages m left join n a on m.uid = a.uid group by m.uid""", "fx_messages", "fx_attachments",
    n=_NAMED_SQL).replace("m.uid % 4 / 2", "(m.uid % 4) // 2"))
def m06(v: Views) -> DataFrame:
    named = _named(v).select("uid", "part_no", "name")
    structure = named.filter(F.col("part_no") % 2 == F.floor(F.col("uid") % 4 / 2))
    raw = named.filter(F.col("uid") % 3 == 0)
    return A.with_summary_or_raw(v.messages.select("uid"), structure, raw, ("uid",)).select("uid", "summary")


@query("a04_attachment_summary", duck(
    """select m.uid, coalesce(string_agg(a.name, ', ' order by a.part_no), 'false') as summary, count(a.name) > 0 as has_attachment
       from fx_messages m left join n a on m.uid = a.uid group by m.uid""", "fx_messages", "fx_attachments", n=_NAMED_SQL))
def a04(v: Views) -> DataFrame:
    named = _named(v).select("uid", "part_no", "name")
    return A.with_summary(v.messages.select("uid"), named, ("uid",))


@query("f13_ignore_attachments", duck(
    """select m.uid, coalesce(string_agg(a.name, ', ' order by a.part_no), 'false') as summary, count(a.name) > 0 as has_attachment
       from fx_messages m left join (select * from n where not regexp_matches(name, '^.*\\.jpg$', 'i')
         and not contains(lower(name), 'draft')) a on m.uid = a.uid group by m.uid""",
    "fx_messages", "fx_attachments", n=_NAMED_SQL))
def f13(v: Views) -> DataFrame:
    rule = P.ignore_rule("att", "*.jpg", "Draft", ref_date=REF_DATE)
    kept = filters.not_ignored_attachments(_named(v).select("uid", "part_no", "name"), [rule])
    return A.with_summary(v.messages.select("uid"), kept, ("uid",))


_EXPORT_SQL = """select account, folder, uid, part_no, name, internal_date, count(*) over (partition by uid) as c,
    row_number() over (partition by uid order by part_no) as i from n"""
_TARGETS_SQL = """select account, folder, uid, part_no, i || case when k > 1 then chr(cast(95 + k as int)) else '' end || '_' || name as target
    from (select *, row_number() over (partition by account, folder, i || '_' || name order by internal_date desc, uid) as k
          from e where c > 1) where k <= 27
  union all
  select account, folder, uid, part_no, name as target from (select *, row_number() over (partition by account, folder, name
    order by internal_date, uid desc) as k from e where c = 1) where k = 1"""


@query("w02_export_names", duck("select * from t", "fx_messages", "fx_attachments", n=_NAMED_SQL, e=_EXPORT_SQL, t=_TARGETS_SQL))
def w02(v: Views) -> DataFrame:
    return A.export_names(_named(v)).select(*MSG, "part_no", "target")


@query("s11_export_manifest", duck(
    """select uid, part_no, target, cast(length('file ' || uid || '-' || part_no) as bigint) as n_bytes from t
       where not (target like '1\\_%' escape '\\' and folder = 'Archive')""", "fx_messages", "fx_attachments", n=_NAMED_SQL,
    e=_EXPORT_SQL, t=_TARGETS_SQL))
def s11(v: Views) -> DataFrame:
    named = _named(v)
    manifest = A.export_names(named)
    existing = manifest.filter(F.col("target").startswith("1_") & (F.col("folder") == "Archive"))
    content = F.encode(F.concat(F.lit("file "), "uid", F.lit("-"), "part_no"), "UTF-8")
    stored = named.select(*MSG, "part_no", content.alias("content"))
    exported = A.with_content(A.without_existing(manifest, existing), stored)
    return exported.select("uid", "part_no", "target", F.length("content").cast("bigint").alias("n_bytes"))


_FILE_MODE = """select uid, part_no, {extra} case when c > 1 then i || '_' else '' end || 'export.PDF'
    || case when ext = '.pdf' then '' else ext end as target
  from (select *, count(*) over (partition by uid) as c, row_number() over (partition by uid order by lower(name), part_no) as i,
          lower(regexp_extract(name, '^.+(\\.[^.]*)$', 1)) as ext from {source})"""


@query("w03_file_mode_names", duck(_FILE_MODE.format(extra="", source="n"), "fx_messages", "fx_attachments", n=_NAMED_SQL))
def w03(v: Views) -> DataFrame:
    return A.file_mode_names(_named(v), "export.PDF").select("uid", "part_no", "target")


@query("x04_filtered_export", duck(
    _FILE_MODE.format(extra="from_addr,", source="""(select a.uid, a.part_no, m.from_addr, replace(a.name, ':', '_') as name
      from n a join fx_messages m on a.uid = m.uid where regexp_matches(m.subject, 'ticket #[0-9]*[46]$', 'i')
      and contains(lower(m.from_addr), 'example.com') and a.name <> 'photo.jpg')"""),
    "fx_messages", "fx_attachments", n=_NAMED_SQL))
def x04(v: Views) -> DataFrame:
    parts = v.attachments.join(v.messages.select(*MSG), "uid").withColumn("type", F.lit("application"))
    manifest = A.filtered_manifest(
        v.messages,
        parts,
        "export.PDF",
        from_=P.template_pattern("Example.com", REF_DATE),
        subject=P.template_pattern("Ticket {{ #[0-9]*[46]$ }}", REF_DATE),
        ignore=[P.ignore_rule("attachments", "PHOTO.*", ref_date=REF_DATE)],
    )
    return manifest.select("uid", "part_no", "from_addr", "target")


# --- folders -------------------------------------------------------------------------------------


@query("j01_resolve_folders", duck(
    """select target, arg_min(full_path, rank * 1000 + ord) as full_path, cast(arg_min(rank, rank * 1000 + ord) as int) as rank
       from (select t.target, f.full_path, f.ord, case when lower(f.name) = lower(t.target) then 1
               when f.attrib = case lower(t.target) when 'sent' then '$Sent' when 'archive' then '$Archive' end then 2
               when contains(lower(f.name), lower(t.target)) then 3 end as rank
             from fx_folders f, (values ('Sent'), ('archive'), ('NATION_13'), ('ion_2'), ('trash'), ('n_1')) t(target))
       where rank is not null group by target""", "fx_folders"))
def j01(v: Views) -> DataFrame:
    return folders.resolve_folders(v.folders, ["Sent", "archive", "NATION_13", "ion_2", "trash", "n_1"])


@query("j02_special_use", duck(
    """select uid, name, case lower(name) when 'sent' then 'Sent' when 'drafts' then 'Drafts' when 'spam' then 'Junk'
         when 'allmail' then 'All' when 'starred' then 'Flagged' when 'archive' then 'Archive' end as special_use
       from (select uid, case uid % 6 when 0 then 'Sent' when 1 then 'DRAFTS' when 2 then 'Spam' when 3 then 'allMail'
               when 4 then 'starred' else folder end as name from fx_messages)""", "fx_messages"))
def j02(v: Views) -> DataFrame:
    names = F.array(*[F.lit(n) for n in ("Sent", "DRAFTS", "Spam", "allMail", "starred")])
    named = v.messages.select("uid", F.coalesce(F.get(names, (F.col("uid") % 6).cast("int")), "folder").alias("name"))
    return named.withColumn("special_use", folders.special_use_of(F.col("name")))


@query("u01_folder_tree", """
    with nodes as (select 'r' || r_regionkey as node, null as parent, r_name as name, null as delimiter, r_regionkey as ord from region
      union all select 'n' || n_nationkey, 'r' || n_regionkey, n_name, case when n_nationkey % 2 = 0 then '.' end, n_nationkey from nation
      union all select 's' || s_suppkey, 'n' || s_nationkey, s_name, case when s_suppkey % 5 = 0 then '|' end, s_suppkey from supplier)
    select r.name, r.name as full_path, 1::bigint as depth from nodes r where parent is null
    union all select n.name, r.name || coalesce(n.delimiter, '/') || n.name, 2 from nodes n join nodes r on n.parent = r.node and r.parent is null
    union all select s.name, r.name || coalesce(n.delimiter, '/') || n.name || coalesce(s.delimiter, n.delimiter, '/') || s.name, 3
      from nodes s join nodes n on s.parent = n.node join nodes r on n.parent = r.node""")
def u01(v: Views) -> DataFrame:
    def nodes(table: str, prefix: str, key: str, parent, name: str, delimiter):
        return v.table(table).select(
            F.concat(F.lit(prefix), key).alias("node"),
            parent.alias("parent"),
            F.col(name).alias("name"),
            delimiter.cast("string").alias("delimiter"),
            F.col(key).cast("bigint").alias("ord"),
            F.array().cast("array<string>").alias("attribs"),
        )

    none = F.lit(None).cast("string")
    tree = (
        nodes("region", "r", "r_regionkey", none, "r_name", none)
        .unionByName(nodes("nation", "n", "n_nationkey", F.concat(F.lit("r"), "n_regionkey"), "n_name",
                           F.when(F.col("n_nationkey") % 2 == 0, ".")))
        .unionByName(nodes("supplier", "s", "s_suppkey", F.concat(F.lit("n"), "s_nationkey"), "s_name",
                           F.when(F.col("s_suppkey") % 5 == 0, "|")))
    )
    return folders.flatten_tree(tree).select("name", "full_path", "depth")


@query("s07_file_listing", duck(
    "select folder, file_name from fx_files union all select 'Summaries', 'r' || o_orderkey from orders where o_orderkey % 10 = 1",
    "fx_files"))
def s07(v: Views) -> DataFrame:
    extra = v.table("orders").select(
        F.lit("Summaries").alias("folder"),
        F.concat(F.lit("r"), "o_orderkey").alias("file_name"),
        (F.col("o_orderkey") % 10 != 1).alias("is_dir"),
    )
    return list_files(v.files.withColumn("is_dir", F.lit(False)).unionByName(extra)).drop("is_dir")


@query("s08_request_map", """
    select c_custkey, 'document' as kind, 0::bigint as pos, c_mktsegment as name, 'Docs/' || c_nationkey as target, null as file
      from customer where c_custkey % 10 <> 0
    union all select c_custkey, 'document', 1, '*', null, 'All-.*' from customer where c_custkey % 10 <> 0
    union all select c_custkey, 'recipient', 0, c_name, lower(c_name) || '@example.com', null from customer where c_custkey % 10 <> 0""")
def s08(v: Views) -> DataFrame:
    document = F.format_string(
        '{"description": "x", "documents": [{"name": "%s", "folder": "Docs/%d"}, {"name": "*", "file": "All-.*"}], '
        '"recipients": [{"name": "%s", "email": "%s@example.com"}]}',
        "c_mktsegment", "c_nationkey", "c_name", F.lower("c_name"),
    )
    broken = F.when(F.col("c_custkey") % 10 == 0, F.lit('{"documents": [')).otherwise(document)
    return map_rules(v.table("customer").withColumn("map", broken), "map", "c_custkey")


@query("s06_mime_ingest", duck(
    r"""select uid, from_addr, to_addrs, subject, body as body_text, case when uid % 2 = 0 then 1 else 0 end::bigint as n_attachments,
          case when uid % 2 = 0 then 'doc-' || uid || '.pdf' end as attachment, strftime(internal_date, '%Y-%m-%d') as day
        from fx_messages""", "fx_messages"))
def s06(v: Views) -> DataFrame:
    uid, end = F.col("uid"), "\r\n"
    attachment = F.concat(
        F.lit(f"--B{end}Content-Type: application/pdf{end}Content-Disposition: attachment; filename=\"doc-"), uid,
        F.lit(f".pdf\"{end}Content-Transfer-Encoding: base64{end}{end}JVBERi0xLjQK{end}"),
    )
    raw = F.concat(
        F.lit("From: "), "from_addr", F.lit(f"{end}To: "), "to_addrs", F.lit(f"{end}Subject: "), "subject",
        F.lit(f"{end}Date: "), F.date_format("internal_date", "EEE, dd MMM yyyy HH:mm:ss"),
        F.lit(f" +0000{end}MIME-Version: 1.0{end}Content-Type: multipart/mixed; boundary=\"B\"{end}{end}"
              f"--B{end}Content-Type: text/plain; charset=\"utf-8\"{end}{end}"),
        "body", F.lit(end), F.when(uid % 2 == 0, attachment).otherwise(""), F.lit(f"--B--{end}"),
    )
    parsed = mime_archive.parse_messages(v.messages.select("uid", raw.alias("raw")), "raw", "uid")
    rows = mime_archive.to_messages(parsed.withColumn("a", F.col("attachments")), "uid", "a")
    return rows.select(
        "uid", "from_addr", "to_addrs", "subject", "body_text",
        F.size("a").cast("bigint").alias("n_attachments"),
        F.get("a", F.lit(0))["name"].alias("attachment"),
        F.date_format("internal_date", "yyyy-MM-dd").alias("day"),
    )


# --- HTML ----------------------------------------------------------------------------------------

_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script(\s[^>]*)?>.*?</script\s*>|<style(\s[^>]*)?>.*?</style\s*>|<head(\s[^>]*)?>.*?</head\s*>|<noscript(\s[^>]*)?>.*?</noscript\s*>', '', 'g')"


def _chain(start: str, *pairs: tuple[str, str]) -> str:
    for pattern, value in pairs:
        start = f"regexp_replace({start}, '{pattern}', {value}, 'g')"
    return start


def _decoded(text: str, nbsp: str = "chr(160)") -> str:
    for entity, char in (("&nbsp;", nbsp), ("&copy;", "'©'"), ("&middot;", "'·'"), ("&lt;", "'<'"), ("&gt;", "'>'"),
                         ("&quot;", "'\"'"), ("&#39;", "chr(39)"), ("&amp;", "'&'")):
        text = f"replace({text}, '{entity}', {char})"
    return text


_PAGE_TEXT = _decoded("trim(" + _chain(
    _VISIBLE,
    (r"[ \t\r\f]+", "' '"),
    (r"(?i)<br(\s[^>]*)?/?>", "chr(3)"),
    (r"(?i)</?(p|div|section|article|header|footer|main|nav|aside|form)(\s[^>]*)?/?>", "chr(1)"),
    (r"(?i)</?(h1|h2|ul|ol|blockquote|pre)(\s[^>]*)?/?>", "chr(2)"),
    (r"(?i)<li(\s[^>]*)?/?>", "chr(1) || ' * '"),
    (r"(?i)</li(\s[^>]*)?>", "chr(1)"),
    (r"(?s)<[^>]*>", "''"),
    (r" +([\x01\x02\x03\n])", r"'\1'"),
    (r"([\x02\x03\n]) +", r"'\1'"),
    (r"([\x01]) +([^* ])", r"'\1\2'"),
    (r"[\x01\n]*\x02[\x01\x02\n]*", "chr(10) || chr(10)"),
    (r"\n*\x01[\x01\n]*", "chr(10)"),
    (r"\n*\x03", "chr(10)"),
) + ", ' ' || chr(10))")


@query("h01_page_text", f"select page_id, {_PAGE_TEXT} as text from pages")
def h01(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", html_to_text("html").alias("text"))


@query("h02_table_text", duck(
    """select uid, 'Order ' || uid || chr(10) || '| Part | Qty |' || chr(10) || (select string_agg('| ' || l_partkey || ' | '
         || cast(l_quantity as int) || ' |', chr(10) order by l_linenumber, l_partkey, l_quantity)
         from lineitem where l_orderkey = h.uid) as text from fx_html h""", "fx_html"))
def h02(v: Views) -> DataFrame:
    return v.html.select("uid", html_to_text("html").alias("text"))


_CELLS_SQL = """select l_orderkey as uid, 1 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_quantity) as row_no,
    cast(l_partkey as varchar) as a, cast(cast(l_quantity as int) as varchar) as b from lineitem
  union all select distinct l_orderkey, 1, 'Part', 'Qty' from lineitem"""


@query("h03_table_cells", duck(
    """select uid, 1::bigint as table_no, cast(row_no as bigint) as row_no, 1::bigint as col_no, a as text from c
       union all select uid, 1, row_no, 2, b from c""", c=_CELLS_SQL))
def h03(v: Views) -> DataFrame:
    return bodies.table_cells(v.html, "html", "uid")


@query("a08_table_columns", duck(
    """select uid, 'Part' as header, string_agg(a, '|' order by row_no) as vals from c where row_no > 1 group by uid
       union all select uid, 'Qty', string_agg(b, '|' order by row_no) from c where row_no > 1 group by uid""", c=_CELLS_SQL))
def a08(v: Views) -> DataFrame:
    found = bodies.table_columns(v.html, "html", "uid")
    return found.select("uid", "header", F.array_join("values", "|").alias("vals"))


_LEAVES = rf"""select page_id, generate_subscripts(t, 1) as ordinal, lower(unnest(t)) as tag, unnest(x) as raw
  from (select page_id, regexp_extract_all(h, '(?i)<([a-z][a-z0-9]*)(\s[^>]*)?>([^<]*)</', 1) as t,
          regexp_extract_all(h, '(?i)<([a-z][a-z0-9]*)(\s[^>]*)?>([^<]*)</', 3) as x
        from (select page_id, regexp_replace({_VISIBLE},
          '(?i)<(img|br|hr|input|wbr|col|area|base|embed|source|track|meta|link)(\s[^>]*)?/?>', '', 'g') as h from pages))"""
_ELEMENTS = rf"""select page_id, cast(ordinal as bigint) as ordinal, tag, trim(replace({_decoded("raw")}, chr(160), ' '), ' ' || chr(9) || chr(10) || chr(13)) as text
  from l where regexp_matches({_decoded("raw", "' '")}, '[^\s]')"""


@query("h05_leaf_elements", duck("select * from e", l=_LEAVES, e=_ELEMENTS))
def h05(v: Views) -> DataFrame:
    return bodies.elements(v.table("pages"), "html", "page_id")


@query("a10_elements_by_tag", duck(
    "select page_id, tag, string_agg(text, '|' order by ordinal) as texts from e group by page_id, tag", l=_LEAVES, e=_ELEMENTS))
def a10(v: Views) -> DataFrame:
    found = bodies.elements_by_tag(v.table("pages"), "html", "page_id")
    return found.select("page_id", "tag", F.array_join("texts", "|").alias("texts"))


# --- tasks ---------------------------------------------------------------------------------------

REGISTRY = tasks.TaskRegistry()


@REGISTRY.task("stop")
def _stop(df: DataFrame) -> DataFrame:
    return df.filter(filters.is_stop_request()).select("uid", F.col("from_addr").alias("output"))


@REGISTRY.task("urgent")
def _urgent(df: DataFrame) -> DataFrame:
    return df.filter(filters.is_urgent()).select("uid", F.col("subject").alias("output"))


@query("x01_user_tasks", duck(
    """select uid, 'stop' as task, from_addr as output from fx_messages where lower(subject) = 'stop'
       union all select uid, 'urgent', subject from fx_messages where contains(lower(subject), 'urgent')""", "fx_messages"))
def x01(v: Views) -> DataFrame:
    ran = [REGISTRY.run(name, v.messages).withColumn("task", F.lit(name)) for name in ("stop", "urgent")]
    return ran[0].unionByName(ran[1])


@query("x02_task_list", duck(
    """select uid, 1::bigint as step, 'log-email' as task, substr(body, 1, 100) || '...' as output from fx_messages
       union all select uid, 2, 'check-header-stop', case when contains(lower(subject), 'stop') then 'stop' else 'go' end from fx_messages
       union all select uid, 3, 'custom', from_addr from fx_messages where not contains(lower(subject), 'stop')""", "fx_messages"))
def x02(v: Views) -> DataFrame:
    stop = filters.hints_unsubscribe()
    steps = [
        tasks.Step("log-email", preview("body", 100, always=True)),
        tasks.Step("check-header-stop", F.when(stop, "stop").otherwise("go"), ~stop),
        tasks.Step("custom", F.col("from_addr")),
    ]
    return tasks.run_steps(v.messages, steps, "uid")


@query("x03_custom_handler", duck(
    "select uid, length(subject) > 15 and contains(from_addr, 'machinery') as go_on from fx_messages", "fx_messages"))
def x03(v: Views) -> DataFrame:
    handler = tasks.custom_handler(
        lambda subject, sender: (subject.str.len() > 15) & sender.str.contains("machinery", regex=False), "subject", "from_addr"
    )
    return v.messages.select("uid", handler.alias("go_on"))
