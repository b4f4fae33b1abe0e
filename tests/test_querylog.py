import pytest

from lakewarden import check_read_only, classify_statements, mask_log_credentials, normalize_query_stats, query_stats, top_queries

STATEMENTS = {
    # every allowed beginning
    "select count(*) from parcels": "allowed",
    "\n\t select 7 as lucky": "allowed",
    "show work_mem": "allowed",
    "explain (analyze, buffers) select sum(weight) from parcels": "allowed",
    "vacuum (verbose) parcels": "allowed",
    "analyze parcels (weight)": "allowed",
    "create extension hstore": "allowed",
    "with heavy as (select * from parcels where weight > 9) table heavy": "allowed",
    "declare walk cursor for table parcels": "allowed",
    "fetch forward 5 from walk": "allowed",
    "close walk": "allowed",
    "deallocate plan_7": "allowed",
    # writing beginnings
    "insert into parcels (weight) select 3": "statement type not allowed",
    "update parcels set weight = weight + 1": "statement type not allowed",
    "delete from parcels": "statement type not allowed",
    "drop index parcels_weight": "statement type not allowed",
    "alter table parcels rename to boxes": "statement type not allowed",
    "truncate table only parcels": "statement type not allowed",
    "grant usage on schema depot to clerk": "statement type not allowed",
    "revoke all on parcels from clerk": "statement type not allowed",
    "create view boxes as table parcels": "statement type not allowed",
    "table parcels": "statement type not allowed",
    # comments count for nothing, literals do
    "-- truncate parcels\ntable parcels": "statement type not allowed",
    "--drop it\nselect weight from parcels": "allowed",
    "/* grant\neverything */select/**/weight from parcels": "allowed",
    "/* harmless */ alter system reset all": "statement type not allowed",
    "select weight from parcels; delete from parcels": "forbidden operation",
    "select 'never drop a parcel'": "forbidden operation",
    "select grants, dropped_at, àdelete_ from parcels": "allowed",
    "select àdelete from parcels": "forbidden operation",
    "with\theavy as (select 1) select 2": "statement type not allowed",
    "create\textension hstore": "statement type not allowed",
    "show all; create\n extension hstore": "forbidden operation",
    "show all; create  extension hstore": "forbidden operation",
    "show all; create extension hstore": "allowed",
    "select weight from recreate ": "allowed",
    "select weight from create table": "forbidden operation",
    "\u2003show all\u3000": "allowed",
    "": "statement type not allowed",
}


def test_log_column(spark):
    df = spark.createDataFrame([(s,) for s in STATEMENTS], "q string")
    rows = {r.q: r for r in classify_statements(df, "q").collect()}
    for statement, reason in STATEMENTS.items():
        assert rows[statement].reason == reason, statement
        assert rows[statement].allowed is (reason == "allowed")


@pytest.mark.parametrize(("statement", "reason"), STATEMENTS.items())
def test_single_statement(statement, reason):
    if reason == "allowed":
        check_read_only(statement)
    else:
        with pytest.raises(PermissionError, match=reason):
            check_read_only(statement)


CREDENTIALS = {
    None: None,
    "": "",
    "postgres://clerk:pa55@depot.internal/parcels": "postgres://clerk:****@depot.internal/parcels",
    "postgresql://clerk:at@home@depot:5432/parcels?ssl=1": "postgresql://clerk:****@depot:5432/parcels?ssl=1",
    "dbname=parcels password=pa55 port=5433": "dbname=parcels password=**** port=5433",
    "password = 'two words'": "password = '****'",
    'set PASSWORD="two words";': 'set PASSWORD="****";',
    "dbname=parcels user=clerk": "dbname=parcels user=clerk",
    "tried postgres://a:1@x/p then postgresql://b:2@y/p": "tried postgres://a:****@x/p then postgresql://b:****@y/p",
    "tried postgres://a:1 2@x/p": "tried postgres://a:****@x/p",
    "tried postgres://a@corp:1@x/p": "tried postgres://a@corp:****@x/p",
    "tried postgres://a:1@ x": "tried postgres://a:1@ x",
    "tried postgres://a:1@x@y": "tried postgres://a:****@x@y",
    "postgres://c:1@2@x/p left, password=3": "postgres://c:****@x/p left, password=****",
    "ftp://c:1@x/y?password=2": "ftp://c:****@x/y?password=2",
    "ftp://x/y?password=2&z=3": "ftp://x/y?password=****&z=3",
    "amqp://c:1:2@172.16.0.9": "amqp://c:****@172.16.0.9",
}


def test_credentials(spark):
    df = spark.createDataFrame([(s,) for s in CREDENTIALS], "line string")
    masked = [r.line for r in mask_log_credentials(df, "line").collect()]
    assert masked == list(CREDENTIALS.values())


STATS = "db_id int, query string, calls bigint, rows bigint, total_exec_time double, mean_exec_time double, stddev_exec_time double, shared_blks_hit bigint, shared_blks_read bigint, shared_blks_dirtied bigint, wal_bytes bigint"


def test_top_by_time(spark):
    rows = [(1, f"q{i}", 10, i, float(i), 100.0 - i, 0.0, 0, 0, 0, 0) for i in range(30)]
    rows += [(2, "only", 1, 1, None, 1.0, 0.0, 0, 0, 0, 0), (2, "other", 1, 1, 5.0, 1.0, 0.0, 0, 0, 0, 0)]
    df = spark.createDataFrame(rows, STATS).repartition(7)
    total = top_queries(df, "total_time").collect()
    assert [r.query for r in total if r.db_id == 1] == [f"q{i}" for i in range(29, 19, -1)]
    assert [r.query for r in total if r.db_id == 2] == ["only", "other"]
    mean = top_queries(df, "mean_time", 3).collect()
    assert [r.query for r in mean if r.db_id == 1] == ["q0", "q1", "q2"]
    many = spark.range(40_000).selectExpr(
        "id % 3 % 2 as db_id", "concat('q', id) as query", "1L as calls", "1L as rows", "cast(id * 7919 % 40009 as double) as total_exec_time",
        "1.0d as mean_exec_time",
    )
    large = top_queries(many, "total_time", 2500).collect()
    for db in (0, 1):
        times = sorted((i * 7919 % 40009 for i in range(40_000) if i % 3 % 2 == db), reverse=True)[:2500]
        assert [r.total_exec_time for r in large if r.db_id == db] == times
    with pytest.raises(ValueError):
        top_queries(df, "calls")
    with pytest.raises(ValueError):
        top_queries(df, "total_time", 0)


def test_resource_shares(spark):
    rows = [(1, f"q{i}", 1, 1, 1.0, 1.0, 0.0, 0, 1, 0, 0) for i in range(100)]
    rows += [(1, "slow", 1, 1, 50.0, 50.0, 0.0, 0, 0, 0, 0), (1, "dirty", 1, 1, 0.0, 0.0, 0.0, 0, 0, 9, 0)]
    rows += [(2, "idle", 1, 1, 0.0, 0.0, 0.0, 0, 0, 0, 0)]
    out = top_queries(spark.createDataFrame(rows, STATS)).collect()
    assert [(r.query, r.total_exec_time_frac, r.total_wal_bytes_frac) for r in out] == [
        ("slow", 50 / 150, None), ("dirty", 0.0, None),
    ]


def test_old_column_names(spark):
    old = spark.createDataFrame([(1, "q", 2.0, 1.0, 0.5)], "db_id int, query string, total_time double, mean_time double, stddev_time double")
    out = normalize_query_stats(old)
    assert out.columns == ["db_id", "query", "total_exec_time", "mean_exec_time", "stddev_exec_time", "wal_bytes"]
    assert out.first().wal_bytes == 0
    assert normalize_query_stats(out).columns == out.columns


def test_stats_from_log(spark):
    log = spark.createDataFrame([(1, "a", 2.0, 3, 7), (1, "a", 4.0, 1, 1), (2, "a", 1.0, 1, 1)], "db_id int, query string, exec_time double, rows int, shared_blks_hit int")
    row = query_stats(log, sums=("shared_blks_hit",)).where("db_id = 1").first()
    assert (row.calls, row.total_exec_time, row.mean_exec_time, row.stddev_exec_time, row.rows, row.shared_blks_hit) == (2, 6.0, 3.0, 1.0, 4, 8)


def test_long_lines_of_credentials_take_linear_time(spark):
    line = "postgres://a:b " * 200_000
    open_ended = "x " + "postgres://a:b@ " * 200_000
    df = spark.createDataFrame([(0, "x " + line), (1, "x " + line + "@h"), (2, open_ended), (3, "ftp://a:b@" + "c" * 1_000_000 + " d")], "i int, line string")
    rows = {r.i: r.line for r in mask_log_credentials(df, "line").collect()}
    assert rows[0] == "x " + line and rows[1] == "x postgres://a:****@h"
    assert rows[2] == open_ended and rows[3].startswith("ftp://a:****@c")
