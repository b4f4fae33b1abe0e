"""Inventories over catalog snapshots: schemas, objects, table details."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_OBJECTS = {
    # object type: (filter on table_type, schema column, output columns)
    "table": ("BASE TABLE", "table_schema", {"table_schema": "schema", "table_name": "name", "table_type": "type"}),
    "view": ("VIEW", "table_schema", {"table_schema": "schema", "table_name": "name", "table_type": "type"}),
    "sequence": (None, "sequence_schema", {"sequence_schema": "schema", "sequence_name": "name", "data_type": "data_type"}),
    "extension": (None, None, {"extname": "name", "extversion": "version", "extrelocatable": "relocatable"}),
}


def list_schemas(schemata: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Schemas with their class, sorted if `ordered`. ``_`` in ``pg_%`` is a wildcard: pgxfoo is a system schema."""
    kind = (
        F.when(F.col("schema_name").like("pg_%"), "System Schema")
        .when(F.col("schema_name") == "information_schema", "System Information Schema")
        .otherwise("User Schema")
    )
    out = schemata.select("db_id", "schema_name", "schema_owner", kind.alias("schema_type"))
    return out.orderBy("schema_type", "schema_name", "db_id") if ordered else out


def list_objects(df: DataFrame, object_type: str, schema: str | None = None) -> DataFrame:
    """Objects of one type, of one schema or of all (`schema=None`).

    `df` is the snapshot that lists the type: tables (also for views),
    sequences or extensions. Extensions belong to no schema.
    """
    if object_type not in _OBJECTS:
        raise ValueError(f"unsupported object type {object_type!r}")
    table_type, schema_column, columns = _OBJECTS[object_type]
    out = df
    if table_type:
        out = out.where(F.col("table_type") == table_type)
    if schema is not None and schema_column:
        out = out.where(F.col(schema_column) == schema)
    out = out.select("db_id", *[F.col(c).alias(name) for c, name in columns.items()])
    return out.orderBy("name", *(["schema"] if schema_column else []), "db_id")


def sequence_details(
    sequences: DataFrame, *, schema: str | None = None, name: str | None = None
) -> DataFrame:
    """Type, start and step of sequences, of one or of all."""
    out = sequences
    if schema is not None:
        out = out.where(F.col("sequence_schema") == schema)
    if name is not None:
        out = out.where(F.col("sequence_name") == name)
    return out.select(
        "db_id", F.col("sequence_schema").alias("schema"), F.col("sequence_name").alias("name"),
        "data_type", "start_value", "increment",
    )


def table_constraints(constraints: DataFrame, key_columns: DataFrame) -> DataFrame:
    """Every constraint with its columns in key order; none gives an empty array.

    Columns are matched by constraint and table: constraint names repeat
    across the tables of a schema. Both inputs are stacked and grouped, one
    shuffle in place of a join. A key has at most 32 columns in the database
    the snapshot comes from, and rows landed twice count once, so the arrays
    stay small.
    """
    keys = ["db_id", "table_schema", "table_name", "constraint_name"]
    column = F.when(F.col("column_name").isNotNull(), F.struct("ordinal_position", "column_name"))
    rows = constraints.select(*keys, "constraint_type").unionByName(
        key_columns.select(*keys, column.alias("column")), allowMissingColumns=True
    )
    return (
        rows.groupBy(*keys)
        .agg(
            F.max("constraint_type").alias("constraint_type"),
            F.sort_array(F.collect_set("column"))["column_name"].alias("columns"),
        )
        .where(F.col("constraint_type").isNotNull())
    )


def table_details(
    columns: DataFrame,
    constraints: DataFrame,
    key_columns: DataFrame,
    indexes: DataFrame,
    *,
    schema: str | None = None,
    table: str | None = None,
    object_type: str = "table",
) -> DataFrame:
    """One nested row per table: ``basic``, ``columns``, ``constraints``, ``indexes``.

    A table has at most 1,600 columns in the database the snapshot comes from,
    and rows landed twice count once. Constraints and indexes have no such
    limit; a document holds all of its table's. A table that is known by them
    alone has no columns. The three lists are stacked and grouped in one shuffle; `schema` and `table` are
    pushed into the snapshot scans.
    """

    def only(df: DataFrame, schema_column: str, table_column: str) -> DataFrame:
        if schema is not None:
            df = df.where(F.col(schema_column) == schema)
        if table is not None:
            df = df.where(F.col(table_column) == table)
        return df

    keys = ["db_id", "table_schema", "table_name"]
    column = F.struct(
        "ordinal_position",
        F.col("column_name").alias("column"),
        "data_type",
        "is_nullable",
        F.col("column_default").alias("default"),
    )
    constraint = F.struct(
        F.col("constraint_name").alias("name"), F.col("constraint_type").alias("type"), "columns"
    )
    index = F.struct(F.col("indexname").alias("name"), F.col("indexdef").alias("definition"))
    grouped = table_constraints(
        only(constraints, "table_schema", "table_name"),
        only(key_columns, "table_schema", "table_name"),
    )
    parts = [
        only(columns, "table_schema", "table_name").select(*keys, column.alias("column")),
        grouped.select(*keys, constraint.alias("constraint")),
        only(indexes, "schemaname", "tablename").select(
            "db_id",
            F.col("schemaname").alias("table_schema"),
            F.col("tablename").alias("table_name"),
            index.alias("index"),
        ),
    ]
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    documents = stacked.groupBy(*keys).agg(
        F.sort_array(F.collect_set("column")).alias("columns"),
        F.sort_array(F.collect_set("constraint")).alias("constraints"),
        F.sort_array(F.collect_set("index")).alias("indexes"),
    )
    return documents.select(
        "db_id",
        F.struct(
            F.col("table_schema").alias("schema"),
            F.col("table_name").alias("name"),
            F.lit(object_type).alias("type"),
        ).alias("basic"),
        F.transform("columns", lambda c: c.dropFields("ordinal_position")).alias("columns"),
        "constraints",
        "indexes",
    )
