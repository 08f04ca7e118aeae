"""Text, JSON and attachment output."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mailloom.sources.messages import split_recipients

# Output fields in their order.
FIELDS = ("from", "to", "date", "subject", "attachment", "body")
#: Name of the output in a folder target.
RESPONSE_NAME = "response.txt"


def project(df: DataFrame, field: str, *keys: str) -> DataFrame:
    """One output field; an unknown name gives all six."""
    return df.select(*keys, *([field] if field in FIELDS else FIELDS))


def text_block(number: Column | None = None, fields: tuple[str, ...] = FIELDS) -> Column:
    """``Field: value`` lines of one message, under its number when there is one."""
    lines = [
        F.concat(F.lit(f"{f.capitalize()}: "), F.coalesce(F.col(f).cast("string"), F.lit(""))) for f in fields
    ]
    if number is not None:
        lines.insert(0, F.concat(F.lit("=== Email #"), number.cast("string"), F.lit(" ===")))
    return F.concat_ws("\n", *lines)


def output_target(path: str) -> str:
    """Where output for this path goes: a path whose last name has an extension is the output itself, any other, and one that
    ends with a separator, is a folder that gets a default name. Spark writes an output as a directory, so the name decides
    and not what is on the storage."""
    folder = path.rstrip("/\\")
    name = re.split(r"[/\\]", folder)[-1]
    is_output = folder == path and os.path.splitext(name)[1] not in ("", ".")
    return path if is_output else f"{folder}/{RESPONSE_NAME}"


def write_text(df: DataFrame, path: str, number: Column | None = None) -> str:
    """Write text blocks to the path's ``output_target`` and return that; existing output is never replaced."""
    target = output_target(path)
    df.select(text_block(number).alias("value")).write.mode("errorifexists").text(target)
    return target


def json_record(number: str = "email_no") -> Column:
    """One JSON object per message; recipients are a list."""
    return F.to_json(
        F.struct(
            F.col(number).alias("Email"),
            F.col("from").alias("From"),
            split_recipients(F.col("to")).alias("To"),
            F.col("date").alias("Date"),
            F.col("subject").alias("Subject"),
            F.col("attachment").alias("Attachment"),
            F.col("body").alias("Body"),
        ),
        {"ignoreNullFields": "false"},
    )


def write_json(df: DataFrame, path: str, number: str = "email_no") -> None:
    df.select(json_record(number).alias("value")).write.mode("errorifexists").text(path)


def _write_file(directory: str, target: str, content: bytes, attempt: int) -> str:
    path = os.path.join(directory, target.replace("/", "_"))
    if os.path.exists(path):
        return "exists"
    partial = f"{path}.{attempt}.partial"
    with open(partial, "wb") as f:
        f.write(content)
    os.replace(partial, path)
    return "written"


def write_files(df: DataFrame, directory: str, target: str = "target", content: str = "content") -> DataFrame:
    """Write each row's bytes to ``directory/target`` on storage all executors share.

    Every file is written under a task-local name and then renamed, so a repeated attempt leaves
    one whole file; files that exist are skipped. Returns what was done; run an action on it.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        attempt = TaskContext.get().taskAttemptId()
        os.makedirs(directory, exist_ok=True)
        for frame in frames:
            done = [_write_file(directory, t, c, attempt) for t, c in zip(frame[target], frame[content])]
            yield pd.DataFrame({"target": frame[target], "status": done})

    return df.select(target, content).mapInPandas(batches, "target string, status string")
