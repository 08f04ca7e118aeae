"""Run queries and their reference SQL side by side: python -m workload.check [table dir] [name part ...]."""

from __future__ import annotations

import datetime as dt
import glob
import math
import os
import sys
import time
import warnings
from collections import Counter

warnings.filterwarnings("ignore")

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck_connection(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def cell(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 6)
    if isinstance(x, (dt.datetime, dt.date)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return tuple(cell(y) for y in x)
    return x


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(cell(r[i]) for i in order) for r in rows)


# DuckDB type -> Spark type
TYPES = {"VARCHAR": "string", "BIGINT": "bigint", "INTEGER": "int", "BOOLEAN": "boolean", "DOUBLE": "double", "DATE": "date"}


def compare(spark_df, con, sql: str) -> tuple[str, int]:
    """Empty text when equal, else what differs; and the number of rows."""
    got = rows_of(spark_df.columns, spark_df.collect())
    ran = con.execute(sql)
    columns = [d[0] for d in ran.description]
    types = {d[0]: TYPES.get(str(d[1]), str(d[1])) for d in ran.description}
    want = rows_of(columns, ran.fetchall())
    n = sum(got.values())
    if sorted(columns) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} != {sorted(columns)}", n
    differing = {c: (t, types[c]) for c, t in spark_df.dtypes if t != types[c]}
    if differing:
        return f"types {differing}", n
    if got != want:
        extra, missing = got - want, want - got
        return (
            f"{n} rows, {sum(want.values())} expected; {sum(extra.values())} extra e.g. {list(extra)[:2]}, "
            f"{sum(missing.values())} missing e.g. {list(missing)[:2]}"
        )[:1500], n
    return "", n


def main(argv: list[str]) -> int:
    from mailloom import local_session
    from workload.all import ORACLES, QUERIES
    from workload.views import Views

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session(8, "check")
    spark.sparkContext.setLogLevel("ERROR")
    con = duck_connection(sf_dir)
    bad = 0
    for name, fn in QUERIES.items():
        if argv[1:] and not any(part in name for part in argv[1:]):
            continue
        began = time.time()
        try:
            df = fn(Views(spark, sf_dir))
            problem, n = compare(df, con, ORACLES[name]) if name in ORACLES else ("", len(df.collect()))
        except Exception as e:
            problem, n = f"{type(e).__name__}: {str(e)[:1500]}", 0
        bad += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name:32s} {n:8d} rows {time.time() - began:6.2f}s {problem}", flush=True)
    print(f"{bad} failed")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv[1:]) else 0)
