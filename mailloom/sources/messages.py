"""Message tables in Parquet, laid out by account and folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mailloom.functions.text import trim_ws

HEADER_COLUMNS = (
    "account", "folder", "uid", "internal_date", "flags", "from_addr", "return_path", "to_addrs", "subject",
)


def write_messages(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Partitioned by account and folder, so that selecting either prunes directories.

    Rows of a folder are brought together first, so there are few files; adaptive execution splits a large folder again.
    """
    df.hint("rebalance", F.col("account"), F.col("folder")).write.mode(mode).partitionBy("account", "folder").parquet(path)


def read_messages(
    spark: SparkSession, path: str, account: str | None = None, folder: str | None = None, bodies: bool = False
) -> DataFrame:
    """Header scan of one account and folder (all for None); bodies are read only on request."""
    return select_mailbox(headers(read_table(spark, path), bodies), account, folder)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All columns of a message table. Accounts and folders are texts whatever they look like, so "0123" stays what it is."""
    found = spark.read.parquet(path).schema
    texts = [T.StructField(f.name, T.StringType()) if f.name in ("account", "folder") else f for f in found]
    return spark.read.schema(T.StructType(texts)).parquet(path)


def drop_partition(spark: SparkSession, path: str, **keys: str | None) -> None:
    """Delete the files of one partition of a table, on whatever file system it lies."""
    jvm = spark.sparkContext._jvm
    utils = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for name, value in keys.items():
        path = f"{path.rstrip('/')}/{utils.getPartitionPathString(name, value)}"
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def headers(df: DataFrame, bodies: bool = False) -> DataFrame:
    """The header columns present; text columns outside of them are never read from Parquet."""
    wanted = (*HEADER_COLUMNS, "body") if bodies else HEADER_COLUMNS
    return df.select(*[c for c in wanted if c in df.columns])


def select_mailbox(df: DataFrame, account: str | None = None, folder: str | None = None) -> DataFrame:
    if account is not None:
        df = df.filter(F.col("account") == account)
    return df if folder is None else df.filter(F.col("folder") == folder)


def joined_header(c):
    """All values of a header as one text."""
    return F.array_join(c, " ")


def first_header(c):
    """First value of a header, or null."""
    return F.get(c, F.lit(0))


def split_recipients(c):
    """``a, b`` to an array of trimmed addresses."""
    return F.transform(F.split(c, ","), trim_ws)
