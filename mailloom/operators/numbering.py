"""Message order and numbers: newest first, 1 = newest, per account and folder.

One folder may hold a large share of all mail, so nothing here sorts a folder in one task.
:func:`newest` needs only the first n and lets every map task drop the rest before the shuffle
(window group limit). :func:`with_numbers` numbers whole folders from counts: each row is ranked
inside a small block of the order, and the sizes of the blocks before it are added.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mailloom.functions.text import as_col

FOLDER_KEYS = ("account", "folder")
# UIDs are unique 32-bit numbers within a folder: a block of 2**16 has at most 65,536 rows, and a
# timestamp at most 65,536 blocks. Received times have a resolution of one second, so a day has
# at most 86,400 of them.
UID_BLOCK_BITS = 16

# Default message counts by output mode.
DEFAULT_COUNTS = {"text": 100, "full": 20, "html": 20, "json": 20, "json:html": 25, "json:table": 25}


def default_count(mode: str = "text") -> int:
    return DEFAULT_COUNTS[mode]


def received(date: Column | str = "internal_date") -> Column:
    """Received time; a missing one counts as the epoch and so sorts last."""
    return F.coalesce(as_col(date).cast("timestamp_ntz"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def _order(date: str, uid: str) -> list[Column]:
    return [received(date).desc(), F.col(uid).asc()]


def newest_first(df: DataFrame, date: str = "internal_date", uid: str = "uid") -> DataFrame:
    """Newest-first order of one mailbox; ties by UID."""
    return df.orderBy(*_order(date, uid))


def with_numbers(
    df: DataFrame,
    keys: tuple[str, ...] = FOLDER_KEYS,
    date: str = "internal_date",
    uid: str = "uid",
    name: str = "email_no",
    first: int = 1,
    last: int | None = None,
) -> DataFrame:
    """Add the message number of every row, however large the folder; a null account or folder is a key like any other.

    The wide rows are shuffled once, on (folder, second, UID block); only block sizes take the
    further shuffles, and every window runs over a bounded group. With ``first`` and ``last`` only
    these numbers stay, and only blocks that hold one of them move.
    """
    k = list(keys)
    marked = df.withColumns(
        {
            "_at": received(date),
            "_day": F.to_date(received(date)),
            "_block": F.shiftright(F.col(uid), UID_BLOCK_BITS),
        }
    )
    second = [*k, "_day", "_at"]
    block = [*second, "_block"]

    def before(size: str, within: list[str], *order: Column) -> Column:
        w = Window.partitionBy(*within).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(size).over(w), F.lit(0))

    def joined(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        """An inner join in which null meets null."""
        right = right.withColumnsRenamed({c: f"_r_{c}" for c in on})
        match = reduce(and_, [left[c].eqNullSafe(right[f"_r_{c}"]) for c in on])
        return left.join(right, match).drop(*[f"_r_{c}" for c in on])

    blocks = marked.groupBy(*block).agg(F.count("*").alias("_n"))
    seconds = blocks.groupBy(*second).agg(F.sum("_n").alias("_n"))
    days = seconds.groupBy(*k, "_day").agg(F.sum("_n").alias("_n"))
    block_start = blocks.select(*block, "_n", before("_n", second, F.asc("_block")).alias("_b"))
    second_start = seconds.select(*second, before("_n", [*k, "_day"], F.desc("_at")).alias("_s"))
    day_start = days.select(*k, "_day", before("_n", k, F.desc("_day")).alias("_d"))
    starts = joined(joined(block_start, second_start, second), day_start, [*k, "_day"])
    starts = starts.select(*block, "_n", (F.col("_b") + F.col("_s") + F.col("_d")).alias("_start"))
    if first > 1:
        starts = starts.filter(F.col("_start") + F.col("_n") >= first)
    if last is not None:
        starts = starts.filter(F.col("_start") < last)
    rank = F.row_number().over(Window.partitionBy(*block).orderBy(F.asc(uid)))
    numbered = joined(marked, starts.drop("_n"), block).withColumn("_rank", rank)
    out = numbered.select(*df.columns, (F.col("_start") + F.col("_rank")).alias(name))
    if first > 1:
        out = out.filter(F.col(name) >= first)
    return out if last is None else out.filter(F.col(name) <= last)


def newest(
    df: DataFrame,
    n: int,
    keys: tuple[str, ...] = FOLDER_KEYS,
    date: str = "internal_date",
    uid: str = "uid",
    name: str = "email_no",
) -> DataFrame:
    """The newest ``n`` messages of every folder with their numbers, by the same plan for every n."""
    return with_numbers(df, keys, date, uid, name, last=n)


def nth(df: DataFrame, n: int, **kw) -> DataFrame:
    """Message number ``n`` of every folder; folders with fewer messages give no row."""
    if n < 1:
        raise ValueError("the message number starts at 1")
    return with_numbers(df, **kw, first=n, last=n)


def parse_range(text: str) -> tuple[int, int | None]:
    """``a-b``, ``a-`` or ``a-last``; an open end is None."""
    m = re.fullmatch(r"(\d+)-(\d+|last)?", text, re.IGNORECASE)
    if not m:
        raise ValueError(f"not a range: {text!r}; write 5-10, 50- or 50-last")
    start = int(m[1])
    end = int(m[2]) if m[2] and m[2].isdigit() else None
    if start < 1:
        raise ValueError("a range starts at 1 or later")
    if end is not None and end < start:
        raise ValueError("a range may not end before it starts")
    return start, end


def number_range(df: DataFrame, text: str, **kw) -> DataFrame:
    """Messages whose number lies in the range; an end past the last message is cut."""
    start, end = parse_range(text)
    return with_numbers(df, **kw, first=start, last=end)


def first_processed(df: DataFrame, n: int, keep: Column | None = None, **kw) -> DataFrame:
    """Stop after ``n`` processed messages: ignored ones do not count, filters are not looked at."""
    return newest(df if keep is None else df.filter(keep), n, name="_nth", **_but_name(kw)).drop("_nth")


def first_matches(
    df: DataFrame,
    predicate: Column,
    n: int,
    pool: int | None = None,
    keys: tuple[str, ...] = FOLDER_KEYS,
    date: str = "internal_date",
    uid: str = "uid",
    name: str = "email_no",
    matches: DataFrame | None = None,
) -> DataFrame:
    """First ``n`` matches among the newest ``pool`` (all for None), with their mailbox numbers.

    Filters first: a map task hands on the first ``n`` matches of a folder, and only these get a number, by counting.
    ``matches`` gives the matching messages directly, say from a join; ``df`` then only counts.
    """
    found = df.filter(predicate) if matches is None else matches
    nth_match = F.row_number().over(Window.partitionBy(*keys).orderBy(*_order(date, uid)))
    chosen = found.withColumn("_nth", nth_match).filter(F.col("_nth") <= n).drop("_nth")
    numbered = numbers_of(chosen, df, keys, date, uid, name)
    return numbered if pool is None else numbered.filter(F.col(name) <= pool)


def numbers_of(
    chosen: DataFrame,
    df: DataFrame,
    keys: tuple[str, ...] = FOLDER_KEYS,
    date: str = "internal_date",
    uid: str = "uid",
    name: str = "email_no",
) -> DataFrame:
    """Add the mailbox number within ``df`` to a few chosen messages of each folder, by counting the rows ahead of them.

    Rows are counted as coarsely as they can be: by day, by second only on days of a chosen message, by block of UIDs only in
    its second, and one by one only in its block. These counts are added up in message order. No row of ``df`` moves; what
    a map task hands on are counts, and a folder has some 86,400 of them for each chosen message at most, and one a day.
    """
    k = list(keys)

    def placed(rows: DataFrame) -> DataFrame:
        slim = rows.select(*k, received(date).alias("_at"), F.col(uid).alias("_uid"))
        return slim.withColumns({"_day": F.to_date("_at"), "_block": F.shiftright("_uid", UID_BLOCK_BITS)})

    wanted = placed(chosen).groupBy(*k, "_day").agg(F.collect_set("_at").alias("_seconds"), F.collect_set(F.struct("_at", "_block")).alias("_blocks"))
    wanted = wanted.withColumnsRenamed({c: f"_w_{c}" for c in (*k, "_day")})
    rows = placed(df)
    near = rows.join(wanted, reduce(and_, [rows[c].eqNullSafe(wanted[f"_w_{c}"]) for c in (*k, "_day")]), "left")
    second = F.when(F.col("_seconds").isNotNull(), F.col("_at"))
    block = F.when(F.array_contains("_seconds", F.col("_at")), F.col("_block"))
    one = F.when(F.array_contains("_blocks", F.struct("_at", "_block")), F.col("_uid"))
    counts = near.groupBy(*k, "_day", second.alias("_at"), block.alias("_block"), one.alias("_uid")).agg(F.count("*").alias("_n"))
    order = Window.partitionBy(*k).orderBy(F.desc("_day"), F.desc("_at"), "_block", "_uid").rowsBetween(Window.unboundedPreceding, 0)
    numbers = counts.select(*[F.col(c).alias(f"_c_{c}") for c in k], F.col("_uid").alias("_c_uid"), F.sum("_n").over(order).alias(name)).filter("_c_uid is not null")
    match = reduce(and_, [chosen[c].eqNullSafe(numbers[f"_c_{c}"]) for c in k] + [chosen[uid] == numbers["_c_uid"]])
    return chosen.join(numbers, match).select(*[chosen[c] for c in chosen.columns], name)


def _but_name(kw: dict) -> dict:
    return {k: v for k, v in kw.items() if k != "name"}
