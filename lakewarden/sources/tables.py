"""Named tables in, JSON rows out."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_tables(spark: SparkSession, directory: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Read ``directory/NAME.parquet`` for each name and register it as a view."""
    tables = {}
    for name in names:
        tables[name] = spark.read.parquet(f"{directory.rstrip('/')}/{name}.parquet")
        tables[name].createOrReplaceTempView(name)
    return tables


def rows_to_json(df: DataFrame, column: str = "row") -> DataFrame:
    """One JSON object per row, NULL fields kept. No rows stay no rows."""
    packed = F.to_json(F.struct("*"), {"ignoreNullFields": "false"})
    return df.select(packed.alias(column))


def write_json_rows(df: DataFrame, path: str) -> None:
    """Write one JSON object per line, a file per partition."""
    df.write.option("ignoreNullFields", "false").json(path)
