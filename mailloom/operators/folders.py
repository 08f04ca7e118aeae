"""Folder lookup, folder tree and folder moves."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mailloom.operators.filters import all_of
from mailloom.operators.numbering import UID_BLOCK_BITS
from mailloom.sources.messages import drop_partition, read_table
from mailloom.sources.staging import staged

# Short folder names and the special-use attribute they stand for.
SPECIAL_USE = {
    "sent": "Sent", "drafts": "Drafts", "draft": "Drafts", "trash": "Trash", "deleted": "Trash",
    "junk": "Junk", "spam": "Junk", "archive": "Archive", "flagged": "Flagged", "starred": "Flagged",
    "all": "All", "allmail": "All", "important": "Important",
}


def special_use_of(name: Column) -> Column:
    """Special-use attribute (without its leading mark) of a short folder name, or null."""
    aliases = F.create_map(*[F.lit(x) for pair in SPECIAL_USE.items() for x in pair])
    return F.try_element_at(aliases, F.lower(name))


def _has_attribute(attribs: Column, attribute: str) -> Column:
    wanted = rf"(?iu)^[\\$]{re.escape(attribute)}\z"
    return F.coalesce(F.exists(attribs, lambda a: a.rlike(wanted)), F.lit(False))


def resolve_folders(folders: DataFrame, targets: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """Full path for each wanted name: exact name, else special use, else part of a name.

    ``folders`` has name, full_path, attribs and ord (listing order). Each folder row lists the
    targets it could serve, and the best one per target is an aggregate with partial results, so
    no join is needed. Targets without a folder give no row.
    """
    name = F.lower("name")

    def candidate(target: str) -> Column:
        wanted = target.lower()
        special = F.lit(False)
        if wanted in SPECIAL_USE:
            special = _has_attribute(F.col("attribs"), SPECIAL_USE[wanted])
        rank = F.when(name == wanted, 1).when(special, 2).when(F.contains(name, F.lit(wanted)), 3)
        return F.when(rank.isNotNull(), F.struct(F.lit(target).alias("target"), rank.alias("rank")))

    offers = F.inline(F.array_compact(F.array(*[candidate(t) for t in targets])))
    best = F.min_by(F.struct("full_path", "rank"), F.struct("rank", "ord")).alias("best")
    return (
        folders.select(*keys, "full_path", "ord", offers)
        .groupBy(*keys, "target")
        .agg(best)
        .select(*keys, "target", "best.full_path", "best.rank")
    )


def flatten_tree(folders: DataFrame, separator: str = "/", max_depth: int = 1000) -> DataFrame:
    """Full path of every folder, with a ``listing`` key that sorts the tree in pre-order.

    Rows have node, parent (null for a root), name, delimiter, attribs and ord. A folder without a delimiter takes its
    parent's. ``listing`` holds the order numbers from the root down, whatever their size. The tree is one recursive query:
    each level joins the one above it alone, and nothing runs before the result is used. A tree deeper than ``max_depth`` (or
    a loop, which no root reaches) is never cut silently: too deep a tree is an error, a loop gives no rows.
    """
    nodes = folders.select("node", "parent", "name", F.col("delimiter").cast("string").alias("delimiter"), "attribs", F.col("ord").cast("bigint").alias("ord"))
    return folders.sparkSession.sql(
        f"""
        WITH RECURSIVE tree (node, name, full_path, delimiter, attribs, depth, listing) MAX RECURSION LEVEL {int(max_depth)} AS (
          SELECT node, name, name, coalesce(delimiter, :separator), attribs, 1L, array(ord) FROM {{nodes}} WHERE parent IS NULL
          UNION ALL
          SELECT n.node, n.name, concat(t.full_path, coalesce(n.delimiter, t.delimiter), n.name), coalesce(n.delimiter, t.delimiter),
                 n.attribs, t.depth + 1L, concat(t.listing, array(n.ord))
          FROM {{nodes}} n JOIN tree t ON n.parent = t.node)
        SELECT * FROM tree""",
        args={"separator": separator},
        nodes=nodes,
    )


def target_folder(folders: DataFrame, target: str) -> str:
    """The full path of a move's target: a listed path, else what :func:`resolve_folders` finds for the name."""
    listed = folders if "full_path" in folders.columns else flatten_tree(folders)
    if not listed.filter(F.col("full_path") == target).isEmpty():
        return target
    if {"name", "attribs", "ord"} <= set(listed.columns):
        found = resolve_folders(listed, [target]).head()
        if found is not None:
            return found["full_path"]
    raise ValueError(f"no such folder: {target}")


def _moves(target: str, predicate: Column | None) -> Column:
    if predicate is None:
        raise ValueError("a move needs a filter or a message number")
    return all_of(F.coalesce(predicate, F.lit(False))) & ~F.col("folder").eqNullSafe(target)


def moved_messages(df: DataFrame, target: str, predicate: Column | None, uid: str = "uid") -> DataFrame:
    """The messages that a move takes, with ``folder`` the target, new UIDs, and ``from_folder`` and ``from_uid``.

    New UIDs follow the largest one of the account's target folder without gaps, in the order of old folder and UID. They
    come from counts: rows are ranked inside a block of 65,536 old UIDs, and the sizes of the account's earlier blocks are
    added, so no account is sorted in one task and a task that is run again gives the same numbers.
    """
    kind = df.schema[uid].dataType
    taken = df.filter(_moves(target, predicate)).withColumns({"from_folder": F.col("folder"), "from_uid": F.col(uid), "_block": F.shiftright(F.col(uid), UID_BLOCK_BITS)})
    block = ["account", "from_folder", "_block"]
    sizes = taken.groupBy(*block).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy("account").orderBy("from_folder", "_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(c).alias(f"_s{c}") for c in block], F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    last = df.filter(F.col("folder") == target).groupBy(F.col("account").alias("_of")).agg(F.max(uid).alias("_last"))
    starts = starts.join(last, F.col("_saccount").eqNullSafe(F.col("_of")), "left")
    rank = F.row_number().over(Window.partitionBy(*block).orderBy("from_uid"))
    match = reduce(and_, [F.col(c).eqNullSafe(F.col(f"_s{c}")) for c in block])
    new = F.coalesce("_last", F.lit(0)) + F.col("_start") + F.col("_rank")
    numbered = taken.withColumn("_rank", rank).join(starts, match)
    return numbered.withColumns({uid: new.cast(kind), "folder": F.lit(target)}).select(*df.columns, "from_folder", "from_uid")


def move_messages(df: DataFrame, target: str, predicate: Column | None, folders: DataFrame | None = None) -> DataFrame:
    """The message table after a move; (account, folder, uid) stays unique.

    A predicate is required. With a folder list the target is looked up in it, by path, name, special use or part of a name.
    """
    if folders is not None:
        target = target_folder(folders, target)
    moved = moved_messages(df, target, predicate).select(*df.columns)
    return df.filter(~_moves(target, predicate)).unionByName(moved)


def move_in_table(spark: SparkSession, path: str, target: str, predicate: Column | None, folders: DataFrame | None = None) -> list[tuple]:
    """Move messages of the table at ``path`` (as ``write_messages`` lays it out); returns the (account, folder) it took some from.

    Only touched partitions are written: the target's folders get further files, the folders that lose messages are replaced,
    and those that lose all go. All other partitions keep their files. The messages to move are first written to the
    checkpoint folder, then to the target, and last taken from their old folders: a run that breaks off loses none.
    """
    df = read_table(spark, path)
    if folders is not None:
        target = target_folder(folders, target)
    hit = _moves(target, predicate)
    sizes = df.groupBy("account", "folder").agg(F.count("*").alias("n"), F.count_if(hit).alias("moved")).filter("moved > 0").collect()
    if not sizes:
        return []
    touched = [(r["account"], r["folder"]) for r in sizes]
    taken = staged(moved_messages(df, target, predicate).select(*df.columns), "moved")
    taken.write.mode("append").partitionBy("account", "folder").parquet(path)
    stays = [(r["account"], r["folder"]) for r in sizes if r["moved"] < r["n"]]
    if stays:
        rest = staged(df.filter(_one_of(stays) & ~hit), "stays")
        rest.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("account", "folder").parquet(path)
    for account, folder in sorted(set(touched) - set(stays), key=str):
        drop_partition(spark, path, account=account, folder=folder)
    return touched


def _one_of(places: list[tuple]) -> Column:
    """Is the row in one of these partitions? Plain comparisons of partition columns, so directories are pruned."""
    return reduce(or_, [F.col("account").eqNullSafe(a) & F.col("folder").eqNullSafe(f) for a, f in places])
