"""Catalog and statistics snapshots landed from many databases.

Every table carries `db_id`, the database the row was taken from. Server
functions (index definitions, sizes, ages, privileges) are columns: the
snapshot holds what the server answered.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.skew import salted_lookup
from .shared import shared_folder

# Snapshot tables and their columns.
SNAPSHOT_SCHEMAS: dict[str, str] = {
    "pg_namespace": "db_id bigint, oid bigint, nspname string",
    "pg_am": "db_id bigint, oid bigint, amname string",
    "pg_class": (
        "db_id bigint, oid bigint, relname string, relnamespace bigint, relkind string, "
        "relam bigint, reltuples double, relpages bigint, reltoastrelid bigint, xid_age bigint"
    ),
    "pg_index": (
        "db_id bigint, indexrelid bigint, indrelid bigint, indkey string, indisunique boolean, "
        "indisprimary boolean, indisvalid boolean, indexprs string, indpred string, "
        "indexdef string, size_bytes bigint"
    ),
    "pg_stat_user_indexes": (
        "db_id bigint, indexrelid bigint, schemaname string, relname string, "
        "indexrelname string, idx_scan bigint"
    ),
    "pg_attribute": (
        "db_id bigint, attrelid bigint, attnum int, attname string, column_type string, "
        "attisdropped boolean"
    ),
    "pg_attrdef": "db_id bigint, adrelid bigint, adnum int, default_value string",
    "pg_stats": (
        "db_id bigint, schemaname string, tablename string, attname string, "
        "null_frac double, avg_width int"
    ),
    "pg_stat_activity": "db_id bigint, state string",
    "pg_sequences": (
        "db_id bigint, schemaname string, sequencename string, last_value bigint, readable boolean"
    ),
    "replication_state": (
        "db_id bigint, in_recovery boolean, receive_lsn string, replay_lsn string, "
        "last_replay_at timestamp, senders bigint"
    ),
    "pg_replication_slots": "db_id bigint, slot_name string, database string, active boolean",
    "pg_statio_user_indexes": "db_id bigint, idx_blks_hit bigint, idx_blks_read bigint",
    "pg_statio_user_tables": "db_id bigint, heap_blks_hit bigint, heap_blks_read bigint",
    "pg_constraint": (
        "db_id bigint, oid bigint, conname string, conrelid bigint, confrelid bigint, "
        "connamespace bigint, convalidated boolean"
    ),
    "pg_stat_statements": (
        "db_id bigint, query string, calls bigint, rows bigint, total_exec_time double, "
        "mean_exec_time double, stddev_exec_time double, shared_blks_hit bigint, "
        "shared_blks_read bigint, shared_blks_dirtied bigint, wal_bytes decimal(38,0)"
    ),
    "schemata": "db_id bigint, schema_name string, schema_owner string",
    "tables": "db_id bigint, table_schema string, table_name string, table_type string",
    "sequences": (
        "db_id bigint, sequence_schema string, sequence_name string, data_type string, "
        "start_value string, increment string"
    ),
    "pg_extension": "db_id bigint, extname string, extversion string, extrelocatable boolean",
    "columns": (
        "db_id bigint, table_schema string, table_name string, column_name string, "
        "ordinal_position int, data_type string, is_nullable string, column_default string"
    ),
    "table_constraints": (
        "db_id bigint, table_schema string, table_name string, constraint_name string, "
        "constraint_type string"
    ),
    "key_column_usage": (
        "db_id bigint, table_schema string, table_name string, constraint_name string, "
        "column_name string, ordinal_position int"
    ),
    "pg_indexes": (
        "db_id bigint, schemaname string, tablename string, indexname string, indexdef string"
    ),
}


# Databases whose newest landings are kept in the plan itself; of more, they are a small table that is joined.
LISTED_DATABASES = 10_000
_LANDINGS = "landings.parquet"


def land_snapshots(snapshots: Mapping[str, DataFrame], directory: str, at: str, databases: DataFrame | None = None) -> None:
    """Land the tables of one look at some databases, taken at the time `at`, for `read_snapshots`.

    Each table is partitioned by landing, ``NAME.parquet/snapshot_at=...``, so
    that later reads leave out whole folders. Landing the same time again
    replaces it. `databases` (column ``db_id``) lists who was looked at;
    without it, those that have a row in any table.

    What the newest landing of every database is stands in a small table of one
    row per database. A landing makes its next generation from the last one
    and the databases just landed, and never looks at older snapshots. It is
    written after the tables, so a landing that fails half-way is not seen. One
    landing at a time.
    """
    spark = next(iter(snapshots.values())).sparkSession
    base, time = directory.rstrip("/"), F.lit(at).cast("timestamp")
    for name, df in snapshots.items():
        columns = [f"cast(`{c}` as {kind}) as `{c}`" for c, kind in (part.split(" ") for part in SNAPSHOT_SCHEMAS[name].split(", "))]
        landed = df.selectExpr(*columns).withColumn("snapshot_at", time)
        landed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_at").parquet(f"{base}/{name}.parquet")
    if databases is None:
        seen = [spark.read.schema(_schema(name)).parquet(f"{base}/{name}.parquet").where(F.col("snapshot_at") == time) for name in snapshots]
        databases = reduce(DataFrame.unionByName, [df.select("db_id") for df in seen])
    now = databases.select(F.col("db_id").cast("bigint").alias("db_id")).distinct().withColumn("snapshot_at", time)
    last = _generation(spark, base)
    if last is not None:
        now = _landings(spark, base, last).unionByName(now).groupBy("db_id").agg(F.max("snapshot_at").alias("snapshot_at"))
    now.write.parquet(f"{base}/{_LANDINGS}/generation={0 if last is None else last + 1}")


def _schema(name: str) -> str:
    return f"{SNAPSHOT_SCHEMAS[name]}, snapshot_at timestamp"


def _generation(spark: SparkSession, base: str) -> int | None:
    """The last complete generation of the table of newest landings; none before the first landing."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/{_LANDINGS}")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(path):
        return None
    done = [
        int(folder.getPath().getName().partition("=")[2])
        for folder in files.listStatus(path)
        if folder.getPath().getName().startswith("generation=") and files.exists(spark._jvm.org.apache.hadoop.fs.Path(folder.getPath(), "_SUCCESS"))
    ]
    return max(done, default=None)


def _landings(spark: SparkSession, base: str, generation: int) -> DataFrame:
    return spark.read.schema("db_id bigint, snapshot_at timestamp").parquet(f"{base}/{_LANDINGS}/generation={generation}")


def _also_in(rows: DataFrame, looks: DataFrame) -> DataFrame:
    """The rows whose database and time are among `looks`."""
    other = looks.select(F.col("db_id").alias("_db_id"), F.col("snapshot_at").alias("_snapshot_at"))
    return rows.join(other, F.col("db_id").eqNullSafe(F.col("_db_id")) & F.col("snapshot_at").eqNullSafe(F.col("_snapshot_at")), "left_semi")


def read_snapshots(
    spark: SparkSession, directory: str, names: Iterable[str] | None = None
) -> dict[str, DataFrame]:
    """Read landed snapshot tables with their fixed schema (no inference), of each database the latest landing.

    Rows carry `snapshot_at`, the time a database was looked at; one time holds
    for all its tables. The newest time per database counts, so a table that is
    empty by then gives no rows of an older landing. The result also holds
    `databases`, one row per database.

    Tables landed by `land_snapshots` bring the newest times along. They are
    looked up once: reads leave out all landings that are no database's newest,
    and if all databases were landed at the same time nothing else is needed.
    Otherwise rows are matched with the newest times, which up to
    `LISTED_DATABASES` stand in the plan; more of them are first matched with one
    row per database of each table, and never come to the driver. Tables that were put there by other
    means are searched for their newest times first, once, over all tables read.
    """
    base = directory.rstrip("/")
    chosen = tuple(SNAPSHOT_SCHEMAS if names is None else names)
    landed = {name: spark.read.schema(_schema(name)).parquet(f"{base}/{name}.parquet") for name in chosen}
    generation = _generation(spark, base)
    if generation is not None:
        newest = _landings(spark, base, generation)
    else:
        times = [df.groupBy("db_id").agg(F.max("snapshot_at").alias("snapshot_at")) for df in landed.values()]
        found = reduce(DataFrame.unionByName, times).groupBy("db_id").agg(F.max("snapshot_at").alias("snapshot_at"))
        path = shared_folder(spark, "newest-landings")
        found.write.parquet(path)
        newest = spark.read.schema(found.schema).parquet(path)
    # one row per time that is still some database's newest; times without a zone, as they are stored
    counted = newest.groupBy(F.col("snapshot_at").cast("string").alias("at")).agg(F.count("*").alias("n")).collect()
    few = sum(row.n for row in counted) <= LISTED_DATABASES
    if few:
        rows = [(row.db_id, row.at) for row in newest.select("db_id", F.col("snapshot_at").cast("string").alias("at")).collect()]
        listed = spark.createDataFrame(rows, "db_id bigint, at string")
        newest = listed.select("db_id", F.col("at").cast("timestamp").alias("snapshot_at"))
    current = [F.lit(row.at).cast("timestamp") for row in counted]

    def latest(df: DataFrame) -> DataFrame:
        if any(row.at is None for row in counted):  # rows without a time: no landing can be left out
            kept = df
        else:
            kept = df.where(F.col("snapshot_at").isin(*current)) if current else df.where(F.lit(False))
        if len(current) > 1 or generation is None:
            if few:
                kept = salted_lookup(kept, newest, ["db_id", "snapshot_at"], [c for c in df.columns if c != "db_id"])
            else:
                # the many databases meet one row per database of this table, and its rows only the newest of those
                own = kept.select("db_id", "snapshot_at").distinct()
                kept = _also_in(kept, _also_in(own, newest.hint("merge")))
        return kept.drop("snapshot_at")

    return {**{name: latest(df) for name, df in landed.items()}, "databases": newest.select("db_id")}
