import datetime

import pytest
from pyspark.sql import functions as F

from lakewarden import (
    connection_health,
    health_report,
    index_hit_rate,
    list_objects,
    list_schemas,
    replication_lag,
    sequence_headroom,
    table_constraints,
    table_details,
    table_hit_rate,
    unvalidated_constraints,
    wraparound_headroom,
)
from lakewarden.operators.health import parse_health_types


def test_connections(spark):
    counts = {1: (501, 0), 2: (500, 101), 3: (501, 101), 4: (500, 100), 5: (42, 3)}
    rows = [(db, "active") for db, (total, idle) in counts.items() for _ in range(total - idle)]
    rows += [(db, "idle in transaction") for db, (_, idle) in counts.items() for _ in range(idle)]
    out = {r.db_id: r for r in connection_health(spark.createDataFrame(rows, "db_id int, state string")).collect()}
    assert {db: (r.total, r.idle_in_transaction) for db, r in out.items()} == counts
    assert {db: r.verdict for db, r in out.items()} == {
        1: "too many connections", 2: "too many idle in transaction", 3: "too many connections", 4: "healthy", 5: "healthy",
    }


def test_hit_rates(spark):
    df = spark.createDataFrame([(1, 97, 3), (2, 92, 8), (3, 0, 0), (4, 95, 5)], "db_id int, idx_blks_hit bigint, idx_blks_read bigint")
    out = {r.db_id: (r.rate, r.verdict) for r in index_hit_rate(df).collect()}
    assert out == {1: (0.97, "above threshold"), 2: (0.92, "below threshold"), 3: (None, "no statistics"), 4: (0.95, "above threshold")}
    table = df.withColumnsRenamed({"idx_blks_hit": "heap_blks_hit", "idx_blks_read": "heap_blks_read"})
    assert {r.db_id: r.rate for r in table_hit_rate(table).collect()} == {1: 0.97, 2: 0.92, 3: None, 4: 0.95}


CLASS = "db_id int, oid bigint, relname string, relnamespace bigint, relkind string, reltoastrelid bigint, xid_age bigint"
NAMESPACE = "db_id int, oid bigint, nspname string"


def test_wraparound(spark):
    limit = 2_146_483_648
    classes = spark.createDataFrame(
        [
            (1, 1, "old", 7, "r", 0, limit - 9_999_999), (1, 2, "edge", 7, "r", 0, limit - 10_000_000),
            (1, 3, "by_toast", 7, "r", 4, 5), (1, 4, "toast", 7, "t", 0, limit - 1), (1, 5, "view", 7, "v", 0, limit),
            (2, 3, "other", 7, "r", 4, 5),
        ], CLASS,
    )
    names = spark.createDataFrame([(1, 7, "s"), (2, 7, "s")], NAMESPACE)
    out = [tuple(r) for r in wraparound_headroom(classes, names).collect()]
    assert out == [(1, "s", "by_toast", 1), (1, "s", "old", 9_999_999)]


def test_sequences(spark):
    found = spark.createDataFrame(
        [(1, "s", "t", c, kind, "public", f"q{c}") for c, kind in (("a", "integer"), ("b", "bigint"), ("c", "smallint"), ("d", "integer"), ("e", "integer"))],
        "db_id int, table_schema string, table string, column string, column_type string, sequence_schema string, sequence_name string",
    )
    state = spark.createDataFrame(
        [(1, "public", "qa", 2_000_000_000, True), (1, "public", "qb", 2_000_000_000, True), (1, "public", "qc", 32_000, True),
         (1, "public", "qd", 2_000_000_000, False), (2, "public", "qe", 2_000_000_000, True)],
        "db_id int, schemaname string, sequencename string, last_value bigint, readable boolean",
    )
    out = sequence_headroom(found, state).collect()
    assert [(r.column, r.remaining) for r in out] == [("a", 147_483_647.0)]
    assert [r.column for r in sequence_headroom(found, state, strict_types=True).collect()] == ["c", "a"]
    assert sequence_headroom(found, state, threshold=0.95).collect() == []


def test_replication(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    before = now - datetime.timedelta(seconds=90, microseconds=500_000)
    df = spark.createDataFrame(
        [(1, False, "a", "b", before, 1), (2, True, "a", "a", before, 0), (3, True, "a", "b", before, 1),
         (4, True, None, "b", before, 0), (5, True, "a", "b", None, 0)],
        "db_id int, in_recovery boolean, receive_lsn string, replay_lsn string, last_replay_at timestamp, senders bigint",
    )
    out = [tuple(r) for r in replication_lag(df, F.lit(now)).orderBy("db_id").collect()]
    assert out == [
        (1, "primary", True, None), (2, "replica", False, 0.0), (3, "replica", True, 90.5),
        (4, "replica", False, 90.5), (5, "replica", False, 0.0),
    ]


def test_unvalidated(spark):
    constraints = spark.createDataFrame(
        [(1, 100, "fk", 1, 2, 7, False), (1, 101, "ck", 1, 0, 7, False), (1, 102, "ok", 1, 2, 7, True), (1, 103, "odd", 1, 2, 99, False)],
        "db_id int, oid bigint, conname string, conrelid bigint, confrelid bigint, connamespace bigint, convalidated boolean",
    )
    classes = spark.createDataFrame([(1, 1, "t", 7, "r", 0, 0), (1, 2, "u", 8, "r", 0, 0)], CLASS)
    names = spark.createDataFrame([(1, 7, "s"), (1, 8, "z")], NAMESPACE)
    out = sorted(tuple(r) for r in unvalidated_constraints(constraints, classes, names).collect() if r.name != "odd")
    assert out == [(1, "s", "t", "ck", None, None), (1, "s", "t", "fk", "z", "u")]
    odd = [r for r in unvalidated_constraints(constraints, classes, names).collect() if r.name == "odd"]
    assert odd[0].schema is None and odd[0].referenced_table == "u"


def test_health_types():
    assert parse_health_types("all") == ["index", "connection", "vacuum", "sequence", "replication", "buffer", "constraint"]
    assert parse_health_types(" buffer , connection") == ["connection", "buffer"]
    with pytest.raises(ValueError, match="foobar"):
        parse_health_types("buffer,foobar")


def test_report_reads_only_what_it_needs(spark):
    activity = spark.createDataFrame([(1, "active")] * 3, "db_id int, state string")
    rows = health_report({"pg_stat_activity": activity}, F.lit("2024-01-01").cast("timestamp"), "connection").collect()
    assert [tuple(r) for r in rows] == [(1, "connection", "connections", "total", 3.0, 500.0, "ok", "healthy")]


def test_schemas(spark):
    names = ["pg_catalog", "pgxfoo", "pg", "information_schema", "public"]
    df = spark.createDataFrame([(1, n, "me") for n in names], "db_id int, schema_name string, schema_owner string")
    assert [(r.schema_name, r.schema_type) for r in list_schemas(df).collect()] == [
        ("information_schema", "System Information Schema"), ("pg_catalog", "System Schema"), ("pgxfoo", "System Schema"),
        ("pg", "User Schema"), ("public", "User Schema"),
    ]


def test_objects(spark):
    df = spark.createDataFrame(
        [(1, "s", "b", "BASE TABLE"), (1, "s", "a", "BASE TABLE"), (1, "s", "v", "VIEW"), (1, "z", "c", "BASE TABLE")],
        "db_id int, table_schema string, table_name string, table_type string",
    )
    assert [r.name for r in list_objects(df, "table", "s").collect()] == ["a", "b"]
    assert [r.name for r in list_objects(df, "table").collect()] == ["a", "b", "c"]
    assert [tuple(r) for r in list_objects(df, "view", "s").collect()] == [(1, "s", "v", "VIEW")]
    with pytest.raises(ValueError):
        list_objects(df, "index")


KEYS = "db_id int, table_schema string, table_name string, constraint_name string"


def test_table_details(spark):
    columns = spark.createDataFrame(
        [(1, "s", "t", "b", 2, "int", "NO", None), (1, "s", "t", "a", 1, "text", "YES", "''"), (1, "s", "u", "a", 1, "int", "NO", None)],
        "db_id int, table_schema string, table_name string, column_name string, ordinal_position int, data_type string, is_nullable string, column_default string",
    )
    constraints = spark.createDataFrame(
        [(1, "s", "t", "uq_ab", "UNIQUE"), (1, "s", "t", "ck", "CHECK"), (1, "s", "u", "uq_ab", "UNIQUE")], KEYS + ", constraint_type string"
    )
    usage = spark.createDataFrame(
        [(1, "s", "t", "uq_ab", "b", 2), (1, "s", "t", "uq_ab", "a", 1), (1, "s", "u", "uq_ab", "z", 1), (1, "s", "t", "gone", "a", 1)],
        KEYS + ", column_name string, ordinal_position int",
    )
    indexes = spark.createDataFrame([(1, "s", "t", "i", "CREATE")], "db_id int, schemaname string, tablename string, indexname string, indexdef string")
    found = {(r.table_name, r.constraint_name): r["columns"] for r in table_constraints(constraints, usage).collect()}
    assert found == {("t", "uq_ab"): ["a", "b"], ("t", "ck"): [], ("u", "uq_ab"): ["z"]}
    one = table_details(columns, constraints, usage, indexes, schema="s", table="t").collect()
    assert len(one) == 1 and one[0].asDict(recursive=True) == {
        "db_id": 1,
        "basic": {"schema": "s", "name": "t", "type": "table"},
        "columns": [
            {"column": "a", "data_type": "text", "is_nullable": "YES", "default": "''"},
            {"column": "b", "data_type": "int", "is_nullable": "NO", "default": None},
        ],
        "constraints": [{"name": "ck", "type": "CHECK", "columns": []}, {"name": "uq_ab", "type": "UNIQUE", "columns": ["a", "b"]}],
        "indexes": [{"name": "i", "definition": "CREATE"}],
    }
    assert len(table_details(columns, constraints, usage, indexes).collect()) == 2
