import pytest
from pyspark.sql import functions as F

from lakewarden import column_stats, key_headroom, validate_foreign_key, validate_not_null, validate_unique


@pytest.fixture(scope="module")
def orders(spark):
    # a third of all rows share one key
    rows = [(1 if i % 3 == 0 else i, None if i % 10 == 0 else i % 7, "é" * (i % 3)) for i in range(3000)]
    return spark.createDataFrame(rows, "id int, part bigint, note string").repartition(6)


def test_unique(orders):
    assert [tuple(r) for r in validate_unique(orders, ["id"]).collect()] == [(1, 1001)]
    with_null = validate_unique(orders, ["id", "part"]).collect()
    assert sum(r.n for r in with_null) == 900 + 1 and all(r.part is not None for r in with_null)
    distinct = {(r.id, r.part): r.n for r in validate_unique(orders, ["id", "part"], nulls_distinct=False).collect()}
    assert distinct[1, None] == 100


def test_foreign_key(spark, orders):
    parents = spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 5, None)], "key bigint")
    out = {r.part: r.n_rows for r in validate_foreign_key(orders, ["part"], parents, ["key"]).collect()}
    expected = {k: sum(1 for i in range(3000) if i % 10 and i % 7 == k) for k in (4, 6)}
    assert out == expected
    pairs = spark.createDataFrame([(1, 1)], "a int, b int")
    child = spark.createDataFrame([(1, 1), (1, 2), (1, 2), (1, None)], "x int, y int")
    out = validate_foreign_key(child, ["x", "y"], pairs, ["a", "b"]).collect()
    assert [tuple(r) for r in out] == [(1, 2, 2)]


def test_not_null(orders):
    rows = {r.column_name: (r.n_rows, r.n_null) for r in validate_not_null(orders).collect()}
    assert rows == {"id": (3000, 0), "part": (3000, 300), "note": (3000, 0)}
    assert len(validate_not_null(orders, ["id"]).collect()) == 1


def test_column_stats(spark, orders):
    rows = {r.column_name: (r.null_frac, r.avg_width) for r in column_stats(orders).collect()}
    assert rows == {"id": (0.0, 4.0), "part": (0.1, 8.0), "note": (0.0, 2.0)}
    empty = column_stats(orders.where("id < 0")).collect()
    assert all(r.null_frac is None and r.avg_width is None for r in empty)
    nested = spark.sql("select array(1, 2) as a, cast(1.5 as decimal(9,2)) as d")
    assert {r.column_name: r.avg_width for r in column_stats(nested).collect()} == {"a": 5.0, "d": 4.0}


def test_key_headroom(spark):
    df = spark.createDataFrame([(2_000_000_000, 5, 1.0), (7, None, 2.0)], "a int, b bigint, c double")
    rows = {r.column_name: (r.max_value, r.exceeded) for r in key_headroom(df).collect()}
    assert rows == {"a": (2_000_000_000, True), "b": (5, False)}
    assert key_headroom(df.where("a = 1")).where(F.col("exceeded")).collect() == []
