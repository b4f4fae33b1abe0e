"""Tables laid out by their keys, so that later joins and groupings need no shuffle."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_bucketed(df: DataFrame, table: str, columns: Sequence[str], buckets: int, path: str | None = None) -> DataFrame:
    """Write `df` as a table dealt to `buckets` by the hash of its key columns, sorted in each, and read it.

    One shuffle, paid once: groupings by the key and joins of tables that are
    dealt by the same key to as many buckets then work bucket by bucket. Each
    bucket is one file, as rows are brought together before they are written. A
    bucket is a task later on, so choose about as many as a shuffle of the table
    would have partitions. The key columns of two tables need the same types.
    With `path` the data lies there and the catalog only points to it.
    """
    if not columns or buckets < 1:
        raise ValueError("bucketing needs key columns and a positive number of buckets")
    writer = df.repartition(buckets, *columns).write.mode("overwrite").format("parquet").bucketBy(buckets, *columns).sortBy(*columns)
    if path is not None:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return df.sparkSession.table(table)
