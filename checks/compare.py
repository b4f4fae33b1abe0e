"""Run queries in Spark and their counterparts in DuckDB and compare the rows.

    python -m checks.compare /root/testdata/sf0.01 [name ...]
"""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession


def local_session(cores: int = 8, shuffle_partitions: int | None = None) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lakewarden")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or cores))
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.maxPlanStringLength", "10000")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(directory: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{directory}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"create view {name} as select * from read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, float, decimal.Decimal)):
        number = float(value)
        return "nan" if math.isnan(number) else f"{number:.17g}"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def rows_of(columns: list[str], rows) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def compare(spark: SparkSession, con, directory: str, run, sql: str) -> tuple[int, str]:
    """Row count, and what differs ('' when nothing does)."""
    df = run(spark, directory)
    ours = rows_of(df.columns, df.collect())
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    theirs = rows_of(names, cursor.fetchall())
    count = sum(ours.values())
    if sorted(names) != sorted(df.columns):
        return count, f"columns {sorted(df.columns)} vs {sorted(names)}"
    if ours != theirs:
        more, less = ours - theirs, theirs - ours
        return count, (
            f"{sum(more.values())} rows only here, e.g. {list(more)[:2]}; "
            f"{sum(less.values())} missing, e.g. {list(less)[:2]}"
        )[:1500]
    return count, ""


def main() -> None:
    from .oracles import ORACLES
    from .queries import QUERIES

    directory, wanted = sys.argv[1], sys.argv[2:]
    spark, con = local_session(), duck(directory)
    bad = 0
    for name in wanted or QUERIES:
        start = time.time()
        try:
            count, problem = compare(spark, con, directory, QUERIES[name], ORACLES[name])
        except Exception as error:  # noqa: BLE001 - report and go on
            count, problem = -1, f"{type(error).__name__}: {str(error)[:1200]}"
        bad += bool(problem)
        print(f"{'BAD' if problem else 'ok ':4} {name:28} {count:8} rows {time.time() - start:6.2f}s {problem}", flush=True)
    print(f"{bad} differ")
    spark.stop()


if __name__ == "__main__":
    main()
