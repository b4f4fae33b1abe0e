"""Landed snapshots: what the newest landing is, and what is read for it."""

import pytest
from pyspark.sql import functions as F

import lakewarden as lw
from lakewarden.sources.snapshots import SNAPSHOT_SCHEMAS


def scans(df, text="FileScan"):
    return df._jdf.queryExecution().sparkPlan().toString().count(text)


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def empty(spark):
    return {name: spark.createDataFrame([], schema) for name, schema in SNAPSHOT_SCHEMAS.items()}


def names(spark, *pairs):
    return spark.createDataFrame([(db, 1, name) for db, name in pairs], SNAPSHOT_SCHEMAS["pg_namespace"])


def test_newest_landing_per_database(spark, tmp_path):
    base = str(tmp_path)
    lw.land_snapshots({"pg_namespace": names(spark, (1, "a"), (2, "b"))}, base, "2024-01-01 00:00:00")
    lw.land_snapshots({"pg_namespace": names(spark, (2, "c"), (3, "d"))}, base, "2024-01-02 00:00:00")
    got = lw.read_snapshots(spark, base, ["pg_namespace"])
    assert rows(got["pg_namespace"]) == [(1, 1, "a"), (2, 1, "c"), (3, 1, "d")]
    assert rows(got["databases"]) == [(1,), (2,), (3,)]
    # a landing that comes late changes nothing that is newer
    lw.land_snapshots({"pg_namespace": names(spark, (1, "old"), (3, "old"))}, base, "2023-12-31 00:00:00")
    assert rows(lw.read_snapshots(spark, base, ["pg_namespace"])["pg_namespace"]) == [(1, 1, "a"), (2, 1, "c"), (3, 1, "d")]
    # the same time again replaces what was landed then
    lw.land_snapshots({"pg_namespace": names(spark, (2, "c2"), (3, "d"))}, base, "2024-01-02 00:00:00")
    assert rows(lw.read_snapshots(spark, base, ["pg_namespace"])["pg_namespace"]) == [(1, 1, "a"), (2, 1, "c2"), (3, 1, "d")]


def test_a_database_without_rows_was_looked_at_all_the_same(spark, tmp_path):
    base, dbs = str(tmp_path), spark.createDataFrame([(1,), (2,)], "db_id bigint")
    lw.land_snapshots({"pg_namespace": names(spark, (1, "a"), (2, "b"))}, base, "2024-01-01 00:00:00", dbs)
    lw.land_snapshots({"pg_namespace": names(spark, (1, "a"))}, base, "2024-01-02 00:00:00", dbs)
    got = lw.read_snapshots(spark, base, ["pg_namespace"])
    assert rows(got["pg_namespace"]) == [(1, 1, "a")] and rows(got["databases"]) == [(1,), (2,)]


def test_a_landing_that_broke_off_is_not_seen(spark, tmp_path):
    base = str(tmp_path)
    lw.land_snapshots({"pg_namespace": names(spark, (1, "a"))}, base, "2024-01-01 00:00:00")
    late = names(spark, (1, "half")).withColumn("snapshot_at", F.lit("2024-01-02 00:00:00").cast("timestamp"))
    late.write.mode("append").partitionBy("snapshot_at").parquet(f"{base}/pg_namespace.parquet")
    (tmp_path / "landings.parquet" / "generation=1").mkdir()
    assert rows(lw.read_snapshots(spark, base, ["pg_namespace"])["pg_namespace"]) == [(1, 1, "a")]


def test_more_databases_than_are_listed_are_joined(spark, tmp_path, monkeypatch):
    base = str(tmp_path)
    lw.land_snapshots({"pg_namespace": names(spark, (1, "a"), (2, "b"))}, base, "2024-01-01 00:00:00")
    lw.land_snapshots({"pg_namespace": names(spark, (2, "c"))}, base, "2024-01-02 00:00:00")
    monkeypatch.setattr("lakewarden.sources.snapshots.LISTED_DATABASES", 1)
    assert rows(lw.read_snapshots(spark, base, ["pg_namespace"])["pg_namespace"]) == [(1, 1, "a"), (2, 1, "c")]


@pytest.fixture(scope="module")
def landed(spark, tmp_path_factory):
    base = str(tmp_path_factory.mktemp("landed"))
    dbs = spark.createDataFrame([(1,)], "db_id bigint")
    for day in ("01", "02", "03"):
        lw.land_snapshots(empty(spark) | {"schemata": spark.createDataFrame([(1, "public", day)], SNAPSHOT_SCHEMAS["schemata"])}, base, f"2024-01-{day} 00:00:00", dbs)
    return lw.read_snapshots(spark, base)


def test_older_landings_are_left_out_of_the_scan(landed):
    df = lw.list_schemas(landed["schemata"], ordered=False)
    assert scans(df) == 1 and [r.schema_owner for r in df.collect()] == ["03"]
    plan = df._jdf.queryExecution().executedPlan().toString()
    filters = plan.split("PartitionFilters: [")[1].split("]")[0]
    assert "snapshot_at" in filters
    nodes = df._jdf.queryExecution().executedPlan().collectLeaves()
    metrics = nodes.apply(0).metrics()
    assert metrics.apply("numPartitions").value() == 1  # of three landings one


def test_a_report_over_all_landed_tables_scans_each_about_once(landed):
    report = lw.health_report(landed, F.lit("2024-01-04").cast("timestamp"))
    assert report.count() == 3  # one database without statistics: connections and two caches
    assert scans(report) <= len(SNAPSHOT_SCHEMAS) + 1
