"""Joining rows to a small table of one row per key when a key may be hot."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# How many tasks share the rows of one key.
SALTS = 32


def _is_broadcast(df: DataFrame) -> bool:
    """Whether Spark takes a table to be small enough for a broadcast."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold()


def salted_lookup(
    rows: DataFrame,
    lookup: DataFrame,
    keys: Sequence[str],
    spread_by: Sequence[str],
    how: str = "inner",
    salts: int = SALTS,
) -> DataFrame:
    """Equi-join with null-safe keys; rows of one key go to `salts` tasks.

    `lookup` holds at most one row per key and is copied `salts` times, so it
    should be small next to `rows` (totals per database, schema names).
    `spread_by` names columns of `rows` that differ within a key. A lookup that
    Spark broadcasts has no hot keys and is not copied: Spark judges by the size
    before copying, and the driver would hold all copies.
    """
    renamed = {k: f"_key_{k}" for k in keys}
    if _is_broadcast(lookup):
        salts = 1
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int")) if salts > 1 else rows.withColumn("_salt", F.lit(0))
    right = lookup.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))) if salts > 1 else F.lit(0))
    right = right.withColumnsRenamed({**renamed, "_salt": "_key_salt"})
    condition = F.col("_salt") == F.col("_key_salt")
    for k, other in renamed.items():
        condition = condition & F.col(k).eqNullSafe(F.col(other))
    return left.join(right, condition, how).drop("_salt", "_key_salt", *renamed.values())


def with_schema_name(
    rows: DataFrame, pg_namespace: DataFrame, oid: str, name: str, spread_by: Sequence[str],
    how: str = "inner",
) -> DataFrame:
    """Replace a schema id by the schema's name; one schema may own most rows."""
    schemas = pg_namespace.select("db_id", F.col("oid").alias(oid), F.col("nspname").alias(name))
    return salted_lookup(rows, schemas, ["db_id", oid], spread_by, how).drop(oid)


def id_or_none(reference: str, own: str) -> Column:
    """A reference id where 0 means none, as a join key.

    All the rows without a reference would meet in one task; minus their own
    id matches nothing either and spreads them.
    """
    return F.when(F.coalesce(reference, F.lit(0)) == 0, -F.col(own)).otherwise(F.col(reference))


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, spread_by: Sequence[str]
) -> DataFrame:
    """The first `n` rows of every group in the given order.

    Rows are first ranked within a share of their group, so that many tasks cut
    a hot group down before one sees what is left of it.
    """
    def first(rows: DataFrame, *keys: str) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
        return rows.withColumn("_rank", rank).where(F.col("_rank") <= n).drop("_rank")

    salt = F.pmod(F.xxhash64(*spread_by), F.lit(SALTS))
    return first(first(df.withColumn("_salt", salt), *group, "_salt").drop("_salt"), *group)
