"""Reply chains: every query runs over the whole conversation texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailloom.functions import chain as C
from mailloom.operators import chains as O
from workload.registry import query
from workload.views import Views, duck

_HAS_RANGE = " or ".join(
    f"regexp_matches({{0}}, '{p}', 'i')"
    for p in (
        r"\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}\s+to\s+\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{2,4}}",
        r"(from|between)\s+\d{{1,2}}[/\-]\d{{1,2}}",
        r"\b(last|past|previous|prior)\s+\d+\s*(month|week|day|year)",
        r"\b(after|since|before)\s+\d{{1,2}}[/\-]\d{{1,2}}",
        r"\d{{1,2}}[/\-]\d{{1,2}}[/\-]\d{{4}}",
        r"\d{{1,2}}/\d{{1,2}}-\d{{1,2}}/\d{{1,2}}",
    )
)


def has_range(c: str) -> str:
    return "(" + _HAS_RANGE.format(c) + ")"


def kind(c: str) -> str:
    t = f"lower({c})"
    return rf"""case when not regexp_matches({c}, '[^\s]') then 'unclassified'
      when regexp_matches({t}, '\battach(ed|ment|ments)\b|\bstatements?\b|\bfiles?\s+(are\s+)?attached\b|\bplease\s+find\s+(the\s+)?attach|\b(enclosed|included|sending)\b.{{0,40}}\b(files?|docs?|documents?|statements?)\b')
        then 'attachment-received'
      when regexp_matches({t}, '\b(just\s+wondering|was\s+wondering)\b|\bdid\s+you\s+(get|receive|see)\b|\bhave\s+you\s+(received|gotten|seen)\b|\b(checking\s+in|following\s+up)\b|\bany\s+update\b')
        then 'did-you-receive'
      when regexp_matches({t}, '\b(would\s+you\s+be\s+able|could\s+you|can\s+you|please\s+send|i\s+need|looking\s+for|requesting)\b|\b(show\s+me|how\s+many|how\s+much|what\s+is|what\s+are)\b|\b(provide|supply|forward\s+me|email\s+me)\b.{{0,60}}\b(report|data|file|record|statement|document)\b')
        then 'send-data'
      when contains({t}, '?') and not regexp_matches({t}, '\battach') and regexp_matches({t}, '\bare\s+you\s+(going|able|planning|available|coming)\b|\b(yes|no|confirmed?|denied?|correct|incorrect|agree|disagree)\b|\bwill\s+you\b|\bdo\s+you\s+(plan|intend|want)\b')
        then 'boolean' else 'unclassified' end"""


_TRIM = r"regexp_replace(regexp_replace({0}, '^\s+', ''), '\s+$', '')"
_NO_CID = r"array_to_string(list_filter(string_split({0}, chr(10)), lambda l: not regexp_matches(l, '^\s*\[cid:[^\]]*\]\s*$')), chr(10))"

# Segments as they must come back, with everything the later steps need.
SEGS = f"""select *, count(*) over (partition by conv_id) as n_turns, {has_range('body')} as ranged, body <> '' as filled, {kind('body')} as kind
  from (select conv_id, turn as idx, role, {_TRIM.format('body')} as body from fx_turns)"""
_CHAIN = {"segs": SEGS}


def chain_sql(sql: str, **ctes: str) -> str:
    return duck(sql, "fx_turns", **_CHAIN, **ctes)


def per_chain(chosen: str) -> str:
    """Body per conversation: the expression for chains, the plain text otherwise; no image lines."""
    return chain_sql(
        f"""select s.conv_id, {_NO_CID.format("case when any_value(n_turns) > 1 then " + chosen + " else any_value(t.body) end")} as body
            from segs s join fx_turns t on s.conv_id = t.conv_id and s.idx = t.turn group by s.conv_id""")


@query("t01_is_chained", duck(
    """select conv_id, -1 as turn, count(*) > 1 as chained from fx_turns group by conv_id
       union all select conv_id, turn, false from fx_turns""", "fx_turns"))
def t01(v: Views) -> DataFrame:
    whole = v.chains.select("conv_id", F.lit(-1).cast("bigint").alias("turn"), F.col("raw_body").alias("body"))
    texts = whole.unionByName(v.turns.select("conv_id", "turn", "body"))
    return texts.select("conv_id", "turn", C.is_chained("body").alias("chained"))


@query("t02_split_chain", chain_sql(
    """select conv_id, cast(idx as int) as index, body, case when idx > 0 then role end as sender,
         case when idx > 0 then 'c' || conv_id end as subject from segs"""))
def t02(v: Views) -> DataFrame:
    found = O.segments(v.chains, "raw_body", "conv_id")
    return found.select(
        "conv_id", "index", "body", F.col("headers")["from"].alias("sender"), F.col("headers")["subject"].alias("subject")
    )


@query("t03_has_date_range", duck(f"select conv_id, turn, {has_range('body')} as has_range from fx_turns", "fx_turns"))
def t03(v: Views) -> DataFrame:
    return v.turns.select("conv_id", "turn", C.has_date_range("body").alias("has_range"))


def _best(order: str) -> str:
    return chain_sql(
        f"""select conv_id, coalesce(arg_min(body, {order}) filter (where ranged), arg_min(body, idx) filter (where filled)) as body
            from segs group by conv_id""")


@query("t04_best_segment", _best("idx"))
def t04(v: Views) -> DataFrame:
    return v.chains.select("conv_id", C.best_segment(C.segment_bodies("raw_body")).alias("body"))


@query("t04_best_segment_earliest", _best("-idx"))
def t04_earliest(v: Views) -> DataFrame:
    return v.chains.select("conv_id", C.best_segment(C.segment_bodies("raw_body"), "earliest").alias("body"))


@query("t05_best_body", per_chain(
    "coalesce(arg_min(s.body, idx) filter (where ranged), arg_min(s.body, idx) filter (where filled))"))
def t05(v: Views) -> DataFrame:
    return v.chains.select("conv_id", O.best_body("raw_body").alias("body"))


@query("t06_classify", duck(f"select conv_id, turn, {kind('body')} as type from fx_turns", "fx_turns"))
def t06(v: Views) -> DataFrame:
    return v.turns.select("conv_id", "turn", C.classify("body").alias("type"))


def _narrow(sql: str) -> str:
    return per_chain(f"coalesce({sql}, arg_min(s.body, idx) filter (where filled))")


@query("t07a_narrow_by_date", _narrow(
    """case when bool_or(contains(lower(s.body), 'noted'))
         then coalesce(arg_min(s.body, idx) filter (where contains(lower(s.body), 'noted') and ranged),
                       arg_min(s.body, idx) filter (where contains(lower(s.body), 'noted') and filled))
         else arg_min(s.body, idx) filter (where ranged) end"""))
def t07a(v: Views) -> DataFrame:
    return v.chains.select("conv_id", O.best_body_for_task("raw_body", "Noted").alias("body"))


@query("t07b_narrow_by_file", _narrow(
    """case when bool_or(contains(lower(s.body), 'you'))
         then coalesce(arg_min(s.body, idx) filter (where contains(lower(s.body), 'you') and contains(lower(s.body), 'numbers')),
                       arg_min(s.body, idx) filter (where contains(lower(s.body), 'you') and ranged),
                       arg_min(s.body, idx) filter (where contains(lower(s.body), 'you') and filled))
         else coalesce(arg_min(s.body, idx) filter (where contains(lower(s.body), 'numbers')), arg_min(s.body, idx) filter (where ranged)) end"""))
def t07b(v: Views) -> DataFrame:
    return v.chains.select("conv_id", O.best_body_for_task("raw_body", "YOU", "file-name:Numbers").alias("body"))


@query("t07c_narrow_raw_data", _narrow(
    """case when bool_or(not contains(lower(s.body), 'update') and filled)
         then coalesce(arg_min(s.body, idx) filter (where not contains(lower(s.body), 'update') and filled and kind = 'attachment-received'),
                       arg_min(s.body, idx) filter (where not contains(lower(s.body), 'update') and filled))
         else arg_min(s.body, idx) filter (where filled and kind = 'attachment-received') end"""))
def t07c(v: Views) -> DataFrame:
    return v.chains.select("conv_id", O.best_body_for_task("raw_body", "update", "raw-data:statement").alias("body"))


@query("t08_remove_cid_lines", duck(f"select conv_id, turn, {_NO_CID.format('body')} as body from fx_turns", "fx_turns"))
def t08(v: Views) -> DataFrame:
    return v.turns.select("conv_id", "turn", C.remove_cid_lines("body").alias("body"))


def content(c: str) -> str:
    cut = rf"""regexp_replace({c}, '(?s)(^|\n)[A-Z][a-zA-Z''.]+([ \t]+[A-Z][a-zA-Z''.]+){{0,4}}[ \t]*\n([^\n]*\n){{0,3}}?[^\n]*?(\d{{3}}[-. ]?\d{{3}}[-. ]?\d{{4}}|\b\d{{1,5}} +\w+ +(?i:st|street|ave|avenue|rd|road|blvd|hwy|dr|drive|ln|lane|way)\b|\b[A-Z][a-z]+,? +[A-Z]{{2}}\.? +\d{{5}}\b).*', '')"""
    return _TRIM.format(_NO_CID.format(cut))


def thanks(c: str) -> str:
    line = rf"regexp_replace({content(c)}, '\n(\s*\n)*', ' ', 'g')"
    return rf"""(regexp_matches({line}, '\bthank\s+you\b|\bthanks\b|\bthank\s+so\s+much\b|\bgreatly\s+appreciate\b|\bmuch\s+appreciated\b|\bappreciate\s+it\b', 'i')
      and not regexp_matches({line}, '\bcan\s+you\s+(also\s+)?(send|forward|provide|email)\b|\bcould\s+you\b|\bwould\s+you\b|\bplease\s+send\b|\bi\s+need\b|\balso\s+send\b|\bsend\s+(me|us|the)\b|\bforward\s+(me|us|the)\b|\bfrom\s+last\s+week\b|\bcan\s+you\s+also\b', 'i')
      and len(list_filter(regexp_split_to_array({line}, '[.!?]+'), lambda s: regexp_matches(s, '[^\s]'))) <= 3)"""


@query("t09_message_content", duck(f"select uid, {content('body')} as content from fx_short", "fx_short"))
def t09(v: Views) -> DataFrame:
    return v.short.select("uid", C.message_content("body").alias("content"))


@query("t10_thank_you_short", duck(f"select uid, {thanks('body')} as thanks from fx_short", "fx_short"))
def t10_short(v: Views) -> DataFrame:
    return v.short.select("uid", C.is_thank_you("body").alias("thanks"))


@query("t10_thank_you_turns", duck(f"select conv_id, turn, {thanks('body')} as thanks from fx_turns", "fx_turns"))
def t10_turns(v: Views) -> DataFrame:
    return v.turns.select("conv_id", "turn", C.is_thank_you("body").alias("thanks"))


# Chains of the short texts: the newest message is one of them, an older one follows.
_SHORT_CHAIN = """select uid, case when uid % 3 = 0 then ' ' else body end as b0, case when uid % 3 = 1 then 'hello' else body end as b1
  from fx_short"""


@query("t11_thank_you_chain", duck(
    f"""select uid, {thanks("case when trim(b0) = '' then b1 else b0 end")} as thanks from c
        union all select -1 - conv_id, {thanks('body')} from fx_turns where turn = 0""", "fx_short", "fx_turns", c=_SHORT_CHAIN))
def t11(v: Views) -> DataFrame:
    uid, divider = F.col("uid"), "\n" + "-" * 12 + "\nFrom: x\nDate: y\n\n"
    older = F.when(uid % 3 == 1, "hello").otherwise(F.col("body"))
    newest = F.when(uid % 3 == 0, " ").otherwise(F.col("body"))
    short = v.short.select("uid", F.concat(newest, F.lit(divider), older).alias("body"))
    talks = v.chains.select((-1 - F.col("conv_id")).alias("uid"), F.col("raw_body").alias("body"))
    return short.unionByName(talks).select("uid", O.is_thank_you_chain("body").alias("thanks"))


_COUNTS = "select conv_id, kind as type, count(*) as n from segs group by conv_id, kind"
_PRIORITY = "list_position(['attachment-received', 'send-data', 'did-you-receive', 'boolean', 'unclassified'], type)"


@query("a05_segment_type_counts", chain_sql("select * from c", c=_COUNTS))
def a05(v: Views) -> DataFrame:
    return O.segment_type_counts(v.chains, "raw_body", "conv_id")


@query("a06_dominant_type", chain_sql(
    f"select conv_id, arg_max(type, n * 10 - {_PRIORITY}) as dominant_type from c group by conv_id", c=_COUNTS))
def a06(v: Views) -> DataFrame:
    return O.dominant_types(v.chains, "raw_body", "conv_id")


@query("a07_narrowed_body", duck(
    f"""select s.conv_id, {_NO_CID.format('''case when any_value(n_turns) = 1 then any_value(t.body) else coalesce(
          string_agg(s.body, chr(10) || chr(10) order by idx) filter (where filled and kind = d.type),
          string_agg(s.body, chr(10) || chr(10) order by idx) filter (where filled)) end''')} as body
        from segs s join fx_turns t on s.conv_id = t.conv_id and s.idx = t.turn
        join (select conv_id, arg_max(type, n * 10 - {_PRIORITY}) as type from c group by conv_id) d on d.conv_id = s.conv_id
        group by s.conv_id""", "fx_turns", **_CHAIN, c=_COUNTS))
def a07(v: Views) -> DataFrame:
    return v.chains.select("conv_id", O.narrowed_body("raw_body").alias("body"))
