"""Small tables that rows are matched with stay small in the driver."""

import datetime

import pytest
from pyspark.sql import functions as F

import lakewarden as lw
from lakewarden.operators.skew import salted_lookup
from lakewarden.sources import snapshots


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_broadcast_lookup_is_not_copied(spark, tmp_path):
    rows = spark.range(100).select((F.col("id") % 5).alias("k"), "id")
    spark.createDataFrame([(k, f"n{k}") for k in range(4)], "k bigint, name string").write.parquet(f"{tmp_path}/names")
    lookup = spark.read.parquet(f"{tmp_path}/names")
    out = salted_lookup(rows, lookup, ["k"], ["id"])
    assert "Broadcast" in plan(out) and "explode" not in plan(out).lower() and out.count() == 80
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        spread = salted_lookup(rows, lookup, ["k"], ["id"])
        assert "explode" in plan(spread).lower() and sorted(spread.collect()) == sorted(out.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


@pytest.mark.parametrize("listed", [100, 1])
def test_many_databases_are_neither_listed_nor_copied(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(snapshots, "LISTED_DATABASES", listed)
    state = "db_id bigint, state string"
    first = spark.createDataFrame([(1, "old"), (2, "gone"), (3, "kept"), (3, "kept"), (None, "old")], state)
    lw.land_snapshots({"pg_stat_activity": first}, str(tmp_path), "2024-03-01 00:00:00")
    names = spark.createDataFrame([(2, 1, "public")], "db_id bigint, oid bigint, nspname string")
    second = spark.createDataFrame([(1, "new"), (None, "new"), (None, "new")], state)
    lw.land_snapshots({"pg_stat_activity": second, "pg_namespace": names}, str(tmp_path), "2024-03-02 00:00:00")
    landed = lw.read_snapshots(spark, str(tmp_path), ["pg_stat_activity"])
    got = sorted((r.db_id or 0, r.state) for r in landed["pg_stat_activity"].collect())
    assert got == [(0, "new"), (0, "new"), (1, "new"), (3, "kept"), (3, "kept")]
    assert landed["databases"].count() == 4
    if listed == 1:
        assert "explode" not in plan(landed["pg_stat_activity"]).lower()
        looks = [(1, datetime.datetime(2024, 3, 2))]
        assert snapshots._also_in(spark.createDataFrame(looks * 2, "db_id bigint, snapshot_at timestamp"), spark.createDataFrame(looks, "db_id bigint, snapshot_at timestamp")).count() == 2
