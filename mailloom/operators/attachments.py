"""Attachments: summaries, export names and manifests.

Groups are single messages, whose size the mail format bounds, or are cut to 27 rows per name
before they are shuffled.
"""

from __future__ import annotations

import string
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from mailloom.functions.mime import attachment_name, extension, is_attachment, safe_name
from mailloom.functions.patterns import IgnoreRule, Pattern, matches
from mailloom.operators.filters import MESSAGE_KEYS, all_of, not_ignored_attachments
from mailloom.operators.numbering import FOLDER_KEYS, received


def attachment_parts(parts: DataFrame, with_size: bool = False) -> DataFrame:
    """Attachment leaves of a part table with their resolved ``name``."""
    have = set(parts.columns)

    def column(name: str) -> Column:
        return F.col(name) if name in have else F.lit(None).cast("string")

    names = [column(c) for c in ("disp_filename", "param_name", "param_filename")]
    kept = is_attachment(
        column("disposition"), column("type"), column("subtype"), *names, "size" if with_size else None
    )
    return parts.filter(kept).withColumn("name", attachment_name(*names, column("subtype")))


def summaries(
    attachments: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS, name: str = "name", order: str = "part_no"
) -> DataFrame:
    """Names of each message joined by ``', '`` in part order."""
    pairs = F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(name).alias("n"))))
    joined = F.array_join(F.transform(pairs, lambda p: p["n"]), ", ")
    return attachments.groupBy(*keys).agg(joined.alias("summary"))


def with_summary(
    messages: DataFrame, attachments: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS
) -> DataFrame:
    """Add ``summary`` (``false`` without attachments) and ``has_attachment``."""
    joined = messages.join(summaries(attachments, keys), list(keys), "left")
    return joined.withColumns(
        {
            "has_attachment": F.col("summary").isNotNull(),
            "summary": F.coalesce("summary", F.lit("false")),
        }
    )


def with_summary_or_raw(
    messages: DataFrame, attachments: DataFrame, parsed: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS
) -> DataFrame:
    """Summary from the part structure, else from the attachments found in the raw message."""
    own = summaries(attachments, keys).withColumnRenamed("summary", "_own")
    raw = summaries(parsed, keys).withColumnRenamed("summary", "_raw")
    joined = messages.join(own, list(keys), "left").join(raw, list(keys), "left")
    return joined.withColumn("summary", F.coalesce("_own", "_raw", F.lit("false"))).drop("_own", "_raw")


def _whole(window: WindowSpec) -> WindowSpec:
    """All rows of the group in the order of ``window``: numbers and counts of one order share a window, and a task holds one sort."""
    return window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def export_names(
    attachments: DataFrame,
    keys: tuple[str, ...] = MESSAGE_KEYS,
    directory: tuple[str, ...] = FOLDER_KEYS,
    name: str = "name",
) -> DataFrame:
    """Target file of every attachment that is written to its folder's directory.

    A message with several attachments prefixes their position: ``2_a.pdf``. A taken name gets a
    letter (``2a_a.pdf`` to ``2z_a.pdf``), and later ones are skipped. A single attachment keeps
    its bare name and replaces an earlier file of that name, so the last message wins. A bare name
    that looks like a prefixed one takes that name from the prefixed files, so a target stands once
    per directory. A slash in a name becomes an underscore.

    Needs ``internal_date`` for the message order. Popular names are hot keys, so both windows
    keep a fixed number of rows per name, which Spark already applies before the shuffle.
    """
    message = Window.partitionBy(*keys).orderBy("part_no")
    numbered = attachments.withColumns(
        {
            "_count": F.count("*").over(_whole(message)),
            "_n": F.row_number().over(message),
            "_at": received(),
        }
    ).withColumn("_numbered", F.col("_count") > 1)
    file = F.translate(F.col(name), "/", "_")
    base = F.concat_ws("_", F.col("_n").cast("string"), file)
    processing = [F.desc("_at"), F.asc("uid")]
    reversed_processing = [F.asc("_at"), F.desc("uid")]

    taken = F.row_number().over(Window.partitionBy(*directory, "_base").orderBy(*processing))
    letters = F.array(F.lit(""), *[F.lit(c) for c in string.ascii_lowercase])
    last = F.row_number().over(Window.partitionBy(*directory, "target").orderBy(*reversed_processing))
    bare = (
        numbered.filter(~F.col("_numbered"))
        .withColumn("target", file)
        .withColumn("_last", last)
        .filter(F.col("_last") == 1)
        .drop("_last")
    )
    shape = r"(?s)^([0-9]+)([a-z]?)_(.*)$"
    number, letter, rest = (F.regexp_extract("target", shape, i) for i in (1, 2, 3))
    blocked = (
        bare.filter(F.col("target").rlike(shape))
        .select(*[F.col(k).alias(f"_r_{k}") for k in directory], F.concat_ws("_", number, rest).alias("_r_base"), letter.alias("_letter"))
        .groupBy(*[f"_r_{k}" for k in directory], "_r_base")
        .agg(F.collect_set("_letter").alias("_blocked"))
    )
    claims = (
        numbered.filter("_numbered")
        .withColumn("_base", base)
        .withColumn("_taken", taken)
        .filter(F.col("_taken") <= 1 + len(string.ascii_lowercase))
    )
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in directory], F.col("_base") == F.col("_r_base"))
    free = F.array_except(letters, F.coalesce("_blocked", F.array().cast("array<string>")))
    prefixed = (
        claims.join(blocked, same, "left")
        .withColumn("target", F.concat(F.col("_n").cast("string"), F.get(free, F.col("_taken") - 1), F.lit("_"), file))
        .filter(F.get(free, F.col("_taken") - 1).isNotNull())
        .drop("_base", "_taken", "_blocked", "_r_base", *[f"_r_{k}" for k in directory])
    )
    return prefixed.unionByName(bare).drop("_count", "_n", "_at", "_numbered")


def file_mode_names(
    attachments: DataFrame, base: str, keys: tuple[str, ...] = MESSAGE_KEYS, name: str = "name"
) -> DataFrame:
    """Names for export to one named file: ``1_base`` by attachment name, plus a differing extension."""
    message = Window.partitionBy(*keys).orderBy(F.lower(name), "part_no")
    position = F.row_number().over(message)
    dot = base.rfind(".")
    own, given = extension(name), base[dot:].lower() if dot > 0 else ""
    suffix = F.when(own == given, "").otherwise(own)
    prefix = F.when(F.col("_count") > 1, F.concat(F.col("_position").cast("string"), F.lit("_"))).otherwise("")
    counted = attachments.withColumns({"_count": F.count("*").over(_whole(message)), "_position": position})
    return counted.withColumn("target", F.concat(prefix, F.lit(base), suffix)).drop("_count", "_position")


def without_existing(manifest: DataFrame, listing: DataFrame, keys: tuple[str, ...] = FOLDER_KEYS) -> DataFrame:
    """Skip targets that the directory listing already has."""
    return manifest.join(listing.select(*keys, "target"), [*keys, "target"], "left_anti")


def with_content(manifest: DataFrame, contents: DataFrame, keys: tuple[str, ...] = MESSAGE_KEYS) -> DataFrame:
    """Attachment bytes next to their target name; parts without bytes are left out."""
    rows = contents.filter(F.col("content").isNotNull()).select(*keys, "part_no", "content")
    return manifest.join(rows, [*keys, "part_no"])


def filtered_manifest(
    messages: DataFrame,
    parts: DataFrame,
    base: str | None = None,
    from_: Pattern | None = None,
    sender: Pattern | None = None,
    subject: Pattern | None = None,
    body: Pattern | None = None,
    ignore: list[IgnoreRule] | None = None,
    keys: tuple[str, ...] = MESSAGE_KEYS,
) -> DataFrame:
    """Export task: matching messages, their attachments with safe names, ignore rules, targets.

    Without ``base`` each attachment keeps its own name.
    """
    chosen = messages.filter(
        all_of(
            matches("from_addr", from_),
            matches("return_path", sender),
            matches("subject", subject),
            matches("body", body),
        )
    )
    files = attachment_parts(parts, with_size="size" in parts.columns).withColumn("name", safe_name("name"))
    kept = not_ignored_attachments(files, ignore or [])
    joined = kept.join(chosen.select(*keys, "from_addr", "subject"), list(keys))
    return joined.withColumn("target", F.col("name")) if base is None else file_mode_names(joined, base, keys)
