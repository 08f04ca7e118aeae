"""Request resolution: rules for documents and recipients, and the files a request asks for.

Rules come from one ordered configuration document (see :mod:`mailloom.sources.request_map`) and
become literal expressions, so resolving them moves no rows.

Files and requests meet by calendar. The listing is counted by folder, pattern and day first, and every folder and pattern
gets one row of arrays over its days: at any day, how many files and how many distinct days lie ahead of it. A request reads
both ends of its range from that row, which gives its number of files without a file or a range being moved, and the days
that have files for it, which then meet the files in an equi-join without false pairs. The arrays are bounded by the days
between the first and the last file, whatever the number of files.
"""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.filenames import FilePattern
from mailloom.functions.text import as_col, let
from mailloom.sources.request_map import REQUESTOR, RequestMap

# Day of files and requests whose pattern carries no date; days are counted from year 1.
UNDATED = 0


def resolve_document(doc_type: Column | str, rules: RequestMap) -> Column:
    """``struct<name, folder, file>`` of the first rule that is ``*`` or part of the type, or null."""
    text = F.lower(as_col(doc_type))
    chain = F.when(F.lit(False), F.lit(None))
    for r in rules.documents:
        hit = F.lit(True) if r.name == "*" else F.contains(text, F.lit(r.name.lower()))
        values = {"name": r.name, "folder": r.folder or None, "file": r.file or None}
        rule = F.struct(*[F.lit(v).cast("string").alias(k) for k, v in values.items()])
        chain = chain.when(hit, rule)
    return chain.cast("struct<name: string, folder: string, file: string>")


def resolve_recipient(
    who: Column | str, rules: RequestMap, task_email: Column | None = None, task_file: Column | None = None
) -> Column:
    """``struct<email, file, resolved>`` of the first rule that fits the ``struct<type, display>``.

    A requestor rule fits everyone, so its position decides; the task's own values come first in
    it. Any other rule fits when its name contains the display text or the other way round.
    """
    display = F.lower(as_col(who)["display"])
    none = F.lit(None).cast("string")
    chain = F.when(F.lit(False), F.lit(None))
    for r in rules.recipients:
        email, file = (F.lit(v or None).cast("string") for v in (r.email, r.file))
        if r.name == REQUESTOR:
            hit = F.lit(True)
            email = F.coalesce(none if task_email is None else task_email, email)
            file = F.coalesce(none if task_file is None else task_file, file)
        else:
            name = F.lit(r.name.lower())
            hit = F.contains(display, name) | F.contains(name, display)
        chain = chain.when(hit, F.struct(email.alias("email"), file.alias("file"), F.lit(True).alias("resolved")))
    unresolved = F.struct(none.alias("email"), none.alias("file"), F.lit(False).alias("resolved"))
    return F.coalesce(chain.cast("struct<email: string, file: string, resolved: boolean>"), unresolved)


def _with_rules(df: DataFrame, rules: DataFrame, kind: str, keys: tuple[str, ...]) -> DataFrame:
    """``df`` and its rules of one kind as one array in file order; null where there is no map.

    A map is one small document, so its rules are one row for each key. That side is broadcast when its measured size allows,
    and an equi-join otherwise, whose hot keys adaptive execution splits. Null keys meet null keys.
    """
    rule = F.struct("pos", "name", "target", "file")
    own = rules.filter(F.col("kind") == kind).groupBy(*[F.col(k).alias(f"_map_{k}") for k in keys]).agg(F.array_sort(F.collect_list(rule)).alias("_rules"))
    match = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_map_{k}")) for k in keys], F.lit(True))
    return df.join(own, match, "left").drop(*[f"_map_{k}" for k in keys])


def resolve_documents(df: DataFrame, doc_type: str, rules: DataFrame, *keys: str) -> DataFrame:
    """Add ``document`` as :func:`resolve_document` gives it, by rules held as rows: one map for each value of ``keys``.

    ``rules`` is what ``map_rules`` gives: kind, pos, name, target and file.
    """
    text = F.lower(doc_type)
    fits = F.filter("_rules", lambda r: (r["name"] == "*") | F.contains(text, F.lower(r["name"])))
    found = F.get(fits, F.lit(0))
    empty = lambda c: F.when(c != "", c)
    document = F.when(found.isNotNull(), F.struct(found["name"].alias("name"), empty(found["target"]).alias("folder"), empty(found["file"]).alias("file")))
    return _with_rules(df, rules, "document", keys).withColumn("document", document).drop("_rules")


def resolve_recipients(df: DataFrame, who: str, rules: DataFrame, *keys: str) -> DataFrame:
    """Add ``contact`` as :func:`resolve_recipient` gives it, by rules held as rows: one map for each value of ``keys``."""
    display = F.lower(F.col(who)["display"])

    def fit(r: Column) -> Column:
        name = F.lower(r["name"])
        return (r["name"] == REQUESTOR) | F.contains(display, name) | F.contains(name, display)

    found = F.get(F.filter("_rules", fit), F.lit(0))
    empty = lambda c: F.when(c != "", c)
    contact = F.struct(empty(found["target"]).alias("email"), empty(found["file"]).alias("file"), found.isNotNull().alias("resolved"))
    return _with_rules(df, rules, "recipient", keys).withColumn("contact", contact).drop("_rules")


def list_files(files: DataFrame, folder: str | None = None) -> DataFrame:
    """Files of a listing, directories left out."""
    plain = files.filter(~F.coalesce(F.col("is_dir"), F.lit(False))) if "is_dir" in files.columns else files
    return plain if folder is None else plain.filter(F.col("folder") == folder)


def _day_number(d: Column) -> Column:
    return F.datediff(d, F.make_date(F.lit(1), F.lit(1), F.lit(1)))


def _dated_files(files: DataFrame, patterns: list[FilePattern], ref_date: dt.date) -> DataFrame:
    """(folder, pattern, day, file_name, file_date) for every pattern a file matches."""
    hits = []
    for p in patterns:
        date = p.date_of("file_name", ref_date)
        usable = p.matches("file_name") & (date.isNotNull() if p.dated else F.lit(True))
        hits.append(F.when(usable, F.struct(F.lit(p.source).alias("pattern"), date.alias("file_date"))))
    found = files.select("folder", "file_name", F.inline(F.array_compact(F.array(*hits))))
    return found.withColumn("day", F.coalesce(_day_number(F.col("file_date")), F.lit(UNDATED)))


def _calendars(listed: DataFrame) -> DataFrame:
    """(folder, pattern, first, days, days_ahead, files_ahead), one row for each folder and pattern of the listing.

    ``days`` are the distinct days in order; element i of the other arrays counts the days and files ahead of ``first`` + i,
    from the first day to the one after the last.
    """
    by_day = listed.groupBy("folder", "pattern", "day").agg(F.count("*").alias("n"))
    calendar = Window.partitionBy("folder", "pattern").orderBy("day")
    entry = F.struct(
        "day",
        "n",
        F.coalesce(F.sum("n").over(calendar.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("files"),
        (F.row_number().over(calendar) - 1).alias("days"),
        F.coalesce(F.col("day") - F.lag("day").over(calendar), F.lit(1)).alias("gap"),
    )
    entries = by_day.select("folder", "pattern", entry.alias("e")).groupBy("folder", "pattern").agg(F.array_sort(F.collect_list("e")).alias("e"))
    last = F.get("e", F.size("e") - 1)

    def ahead(field: str, total: Column) -> Column:
        spread = F.flatten(F.transform("e", lambda e: F.array_repeat(e[field], e["gap"])))
        return F.concat(spread, F.array(total))

    return entries.select(
        "folder",
        "pattern",
        F.get("e", F.lit(0))["day"].alias("first"),
        F.col("e.day").alias("days"),
        ahead("days", F.size("e")).alias("days_ahead"),
        ahead("files", last["files"] + last["n"]).alias("files_ahead"),
    )


def with_bounds(requests: DataFrame) -> DataFrame:
    """Add ``start`` and ``end``: an open start counts from 1970, an open end has no limit."""
    epoch, far = F.lit(dt.date(1970, 1, 1)), F.lit(dt.date(9999, 12, 31))
    known = F.col("range").isNotNull()
    return requests.withColumns(
        {
            "start": F.when(known, F.coalesce(F.col("range.start"), epoch)),
            "end": F.when(known, F.coalesce(F.col("range.end"), far)),
        }
    )


RANGE_KEYS = ["folder", "pattern", "start", "end"]


def wanted_ranges(requests: DataFrame) -> DataFrame:
    """Distinct ranges of the requests that can match a file: folder, pattern and dates known.

    Requests repeat, so every range is matched once for all of them. What is known is told behind the grouping: a filter on the
    keys themselves would be moved below it and read every text again.
    """
    known = reduce(and_, [F.col(k).isNotNull() for k in RANGE_KEYS])
    ranges = with_bounds(requests).select(*RANGE_KEYS, known.alias("_known")).groupBy(*RANGE_KEYS).agg(F.max("_known").alias("_known"))
    return ranges.filter("_known").drop("_known")


def _on_calendar(bounded: DataFrame, listed: DataFrame, patterns: list[FilePattern]) -> DataFrame:
    """``bounded`` rows with the calendar of their folder and pattern, and what lies ahead of both ends: ``_low``, ``_high``.

    Rows without a folder, pattern or range keep nulls there, so does a range that ends before it starts.
    """
    dated = F.col("pattern").isin(*[p.source for p in patterns if p.dated])
    low = F.when(dated, _day_number(F.col("start"))).otherwise(UNDATED)
    high = F.when(dated, _day_number(F.col("end"))).otherwise(UNDATED) + 1
    ends = F.when(F.col("start").isNotNull() & F.col("end").isNotNull() & (low < high), F.struct(low.alias("low"), high.alias("high")))

    def ahead(end: str) -> Column:
        at = F.least(F.greatest(F.col("_ends")[end] - F.col("first"), F.lit(0)), F.size("files_ahead") - 1)
        return let(at, lambda i: F.struct(F.get("days_ahead", i).alias("days"), F.get("files_ahead", i).alias("files")))

    met = bounded.withColumn("_ends", ends).join(_calendars(listed), ["folder", "pattern"], "left")
    return met.withColumns({"_low": ahead("low"), "_high": ahead("high")})


def _wanted_days(bounded: DataFrame, listed: DataFrame, patterns: list[FilePattern], *columns: str) -> DataFrame:
    """``columns`` with one row for every day in the range that has files."""
    n_days = F.greatest(F.col("_high.days") - F.col("_low.days"), F.lit(0))
    own = F.slice("days", F.col("_low.days") + 1, n_days)
    return _on_calendar(bounded, listed, patterns).select(*columns, F.explode_outer(own).alias("day")).filter("day is not null")


def _of_day(days: DataFrame, listed: DataFrame) -> DataFrame:
    """Days with what the listing has for them. One struct is the key, since the optimizer would filter bare keys where they come
    from, and they come from texts that are costly to read twice."""
    key = F.struct("folder", "pattern", "day").alias("_at")
    own = [c for c in listed.columns if c not in ("folder", "pattern", "day")]
    return days.withColumn("_at", key).join(listed.select(key, *own), "_at").drop("_at")


def matching_files(
    files: DataFrame, wanted: DataFrame, patterns: list[FilePattern], ref_date: dt.date
) -> DataFrame:
    """Files of every (folder, pattern, start, end) in ``wanted``, one row each.

    A name must match the pattern and, if the pattern has a date, carry a date in the range.
    """
    listed = _dated_files(list_files(files), patterns, ref_date)
    days = _wanted_days(wanted.select(*RANGE_KEYS), listed, patterns, *RANGE_KEYS)
    return _of_day(days, listed).select(*RANGE_KEYS, "file_name", "file_date")


def request_files(
    requests: DataFrame, files: DataFrame, patterns: list[FilePattern], ref_date: dt.date, *keys: str
) -> DataFrame:
    """One row per request and matching file; no step before has more rows than that, and the requests are read once."""
    listed = _dated_files(list_files(files), patterns, ref_date)
    named = {k: f"_key_{k}" for k in keys}
    bounded = with_bounds(requests).select(*[F.col(k).alias(n) for k, n in named.items()], *RANGE_KEYS)
    days = _wanted_days(bounded, listed, patterns, *named.values(), "folder", "pattern")
    found = _of_day(days, listed)
    own = [F.col(n).alias(k) for k, n in named.items()]
    return found.select(*own, *[c for c in ("folder", "file_name", "file_date") if c not in keys])


def file_counts(
    requests: DataFrame, files: DataFrame, patterns: list[FilePattern], ref_date: dt.date
) -> DataFrame:
    """Requests with ``n_files``, zero included; the requests are read once and meet one row for each folder and pattern."""
    listed = _dated_files(list_files(files), patterns, ref_date)
    kept = [F.col(c).alias(f"_own_{c}") for c in requests.columns]
    met = _on_calendar(with_bounds(requests).select(*RANGE_KEYS, *kept), listed, patterns)
    n_files = F.coalesce(F.col("_high.files") - F.col("_low.files"), F.lit(0)).cast("bigint")
    return met.select(*[F.col(f"_own_{c}").alias(c) for c in requests.columns], n_files.alias("n_files"))


def file_lists(
    files: DataFrame, wanted: DataFrame, patterns: list[FilePattern], ref_date: dt.date
) -> DataFrame:
    """``file_names`` of every (folder, pattern, start, end) in ``wanted`` that has files, by date and name.

    Names are put together once for each day and then for each range, never for each request; a list is as long as the
    files it names.
    """
    listed = _dated_files(list_files(files), patterns, ref_date)
    by_day = listed.groupBy("folder", "pattern", "day").agg(F.array_sort(F.collect_list("file_name")).alias("names"))
    days = _wanted_days(wanted.select(*RANGE_KEYS), listed, patterns, *RANGE_KEYS)
    whole = _of_day(days, by_day).groupBy(*RANGE_KEYS).agg(F.array_sort(F.collect_list(F.struct("day", "names"))).alias("d"))
    return whole.select(*RANGE_KEYS, F.flatten("d.names").alias("file_names"))


def with_file_lists(
    requests: DataFrame, files: DataFrame, patterns: list[FilePattern], ref_date: dt.date
) -> DataFrame:
    """Requests with ``file_names`` and ``folder_found``; give stored requests, which are read for their ranges and for the result.

    ``file_names`` is null without a match. ``folder_found`` is null unless folder, pattern and range are known, and tells
    whether the listing has the folder; a directory in the listing is enough.
    """
    lists = file_lists(files, wanted_ranges(requests), patterns, ref_date)
    there = files.select("folder").distinct().withColumn("_there", F.lit(True))
    met = with_bounds(requests).join(lists, RANGE_KEYS, "left").join(there, ["folder"], "left")
    known = F.col("pattern").isNotNull() & F.col("folder").isNotNull() & F.col("range").isNotNull()
    found = F.when(known, F.coalesce("_there", F.lit(False))).alias("folder_found")
    return met.select(*requests.columns, "file_names", found)
