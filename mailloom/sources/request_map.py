"""Request map: ordered document and recipient rules from one JSON document."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mailloom.functions.filenames import FilePattern

# Name of the rule that stands for whoever sent the request.
REQUESTOR = "%requestor%"
MAP_SCHEMA = (
    "struct<documents: array<struct<name: string, folder: string, file: string>>, "
    "recipients: array<struct<name: string, email: string, file: string>>>"
)


@dataclass(frozen=True)
class DocumentRule:
    name: str
    folder: str | None = None
    file: str | None = None


@dataclass(frozen=True)
class RecipientRule:
    name: str
    email: str | None = None
    file: str | None = None


@dataclass(frozen=True)
class RequestMap:
    """Rules in file order; the first that fits wins."""

    documents: tuple[DocumentRule, ...] = ()
    recipients: tuple[RecipientRule, ...] = ()

    @classmethod
    def from_json(cls, text: str) -> RequestMap:
        def rules(kind, items, fields):
            return tuple(kind(**{f: item.get(f) for f in fields}) for item in items or [])

        data = json.loads(text)
        return cls(
            rules(DocumentRule, data.get("documents"), ("name", "folder", "file")),
            rules(RecipientRule, data.get("recipients"), ("name", "email", "file")),
        )

    def file_patterns(self, *extra: str) -> list[FilePattern]:
        """Every file pattern a request can end up with."""
        sources = [r.file for r in (*self.documents, *self.recipients) if r.file]
        return [FilePattern.parse(s) for s in dict.fromkeys([*sources, *extra])]


def load_map(path: str | None) -> RequestMap | None:
    """Read a configuration file of the driver; no path gives no map, a missing or broken file is an error."""
    if path is None:
        return None
    try:
        with open(path, encoding="utf-8") as f:
            return RequestMap.from_json(f.read())
    except (OSError, ValueError, TypeError, AttributeError) as problem:
        raise ValueError(f"cannot read the request map {path}: {problem}") from problem


def read_map_rules(spark: SparkSession, path: str) -> DataFrame:
    """The rules of map files in any storage that Spark reads (a file, a folder, a pattern): ``source`` and :func:`map_rules`.

    An address that cannot be reached is an error, and so is a file that holds no map.
    """
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("source"), F.col("value").alias("doc"))
    readable = F.from_json("doc", MAP_SCHEMA)
    has_rules = readable["documents"].isNotNull() | readable["recipients"].isNotNull()
    checked = F.when(has_rules, F.col("doc")).otherwise(F.raise_error(F.concat(F.lit("not a request map: "), "source")).cast("string"))
    return map_rules(whole.withColumn("doc", checked), "doc", "source")


def map_rules(df: DataFrame, document: str, *keys: str) -> DataFrame:
    """One row per rule of JSON map documents held in a column, with its position.

    ``kind`` is document or recipient; ``target`` is the folder or the e-mail address. A document
    that cannot be read gives no rows.
    """
    parsed = df.select(*keys, F.from_json(document, MAP_SCHEMA).alias("m"))

    def rules(kind: str, items: str, target: str) -> DataFrame:
        return parsed.select(*keys, F.posexplode(items).alias("pos", "r")).select(
            *keys,
            F.lit(kind).alias("kind"),
            F.col("pos").cast("bigint").alias("pos"),
            "r.name",
            F.col(f"r.{target}").alias("target"),
            "r.file",
        )

    return rules("document", "m.documents", "folder").unionByName(rules("recipient", "m.recipients", "email"))
