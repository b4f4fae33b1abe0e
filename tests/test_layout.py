"""Bucketed tables, collated order, scans of streams, anonymised streams."""

import uuid

import pytest
from pyspark.sql import functions as F

import lakewarden as lw
from lakewarden.operators.text_scan import scan_text


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bucketed_tables_need_no_shuffle(spark, small, tmp_path):
    items, orders = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("lineitem", "orders"))
    orders = orders.where("o_orderkey % 5 <> 0")
    tag = uuid.uuid4().hex
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        child = lw.write_bucketed(items.select("l_orderkey", "l_linenumber"), f"items_{tag}", ["l_orderkey"], 8, f"{tmp_path}/items")
        parent = lw.write_bucketed(orders.select("o_orderkey"), f"orders_{tag}", ["o_orderkey"], 8, f"{tmp_path}/orders")
        gone, twice = lw.validate_foreign_key(child, ["l_orderkey"], parent, ["o_orderkey"]), lw.validate_unique(child, ["l_orderkey"])
        for df in (gone, twice):
            assert "Exchange" not in df._jdf.queryExecution().sparkPlan().toString()
            df.collect()
            assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert rows(gone) == rows(lw.validate_foreign_key(items, ["l_orderkey"], orders, ["o_orderkey"])) and gone.count() > 0
        assert rows(twice) == rows(lw.validate_unique(items, ["l_orderkey"]))
        assert len(child.inputFiles()) == 8  # a file a bucket
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("items", "orders"):
            spark.sql(f"DROP TABLE IF EXISTS {name}_{tag}")
    with pytest.raises(ValueError):
        lw.write_bucketed(items, "x", [], 8)


def test_duplicates_in_the_order_of_a_locale(spark):
    schema = "db_id int, schema string, `table` string, name string, columns array<string>, `using` string, `unique` boolean, `primary` boolean, valid boolean, indexprs string, indpred string"
    inventory = spark.createDataFrame(
        [(1, "s", t, f"{t}_{n}", ["x", "y"][:n], "btree", False, False, True, None, None) for t in ("c", "B", "a", "ä", "Z") for n in (1, 2)], schema
    )
    assert [r.table for r in lw.duplicate_indexes(inventory).collect()] == ["B", "Z", "a", "c", "ä"]
    assert [r.table for r in lw.duplicate_indexes(inventory, collation="UNICODE").collect()] == ["a", "ä", "B", "c", "Z"]
    assert rows(lw.duplicate_indexes(inventory, collation="UNICODE")) == rows(lw.duplicate_indexes(inventory))


TEXTS = [(1, "mail a@b.io now", "2024-01-01 00:00:00"), (2, "none", "2024-01-01 05:00:00"), (3, "10.0.0.1 and a@b.io, c@d.io", "2024-01-02 01:00:00"), (4, None, "2024-01-02 02:00:00")]


def texts(spark, some):
    return spark.createDataFrame(some, "id int, text string, at string").withColumn("at", F.col("at").cast("timestamp"))


def test_scan_stream_counts_each_text_once(spark, tmp_path):
    base = str(tmp_path)
    for some in (TEXTS[:2] + TEXTS[:1], TEXTS[2:] + TEXTS[:1]):
        texts(spark, some).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("id int, text string, at timestamp").parquet(f"{base}/in")
        lw.scan_stream(stream, ["id"], "text", "at", f"{base}/out", f"{base}/state", delay="30 days").awaitTermination()
    assert rows(spark.read.parquet(f"{base}/out")) == rows(scan_text(texts(spark, TEXTS), ["id"], "text"))


def test_scan_stream_by_windows_gives_out_what_is_final(spark, tmp_path):
    base = str(tmp_path)
    more = [*TEXTS, (5, "x", "2024-01-09 00:00:00")]
    for some in (more[:3], more[3:], [(6, "late a@b.io", "2024-01-01 01:00:00"), (7, "x", "2024-01-20 00:00:00")]):
        texts(spark, some).write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema("id int, text string, at timestamp").parquet(f"{base}/in")
        lw.scan_stream(stream, ["id"], "text", "at", f"{base}/out", f"{base}/state", delay="1 day", window="1 day").awaitTermination()
    got = {(str(r.window_start)[:10], r.detector): (r.n_texts, r.n) for r in spark.read.parquet(f"{base}/out").collect()}
    assert got == {("2024-01-01", "email"): (1, 1), ("2024-01-02", "email"): (1, 2), ("2024-01-02", "ipv4"): (1, 1)}


def test_masked_stream_in_both_modes(spark, tmp_path):
    base = str(tmp_path)
    people = spark.createDataFrame([(1, "a@b.io", "x"), (2, "c@d.io", "y"), (3, None, "x")], "n int, email string, kind string")
    policy = lw.mask_policy({"people": people})
    for part in (people.where("n = 1"), people.where("n > 1")):
        part.write.mode("append").parquet(f"{base}/in")
        stream = spark.readStream.schema(people.schema).parquet(f"{base}/in")
        lw.run_masked_stream(spark, "SELECT kind, count(email) AS n, max(email) AS m FROM people GROUP BY kind", {"people": stream}, policy, f"{base}/whole", f"{base}/s1", mode="complete").awaitTermination()
        lw.run_masked_stream(spark, "SELECT n, email FROM people WHERE email = '<redacted>'", {"people": stream}, policy, f"{base}/each", f"{base}/s2").awaitTermination()
    r = "<redacted>"
    assert rows(spark.read.parquet(f"{base}/whole")) == [("x", 2, r), ("y", 1, r)]
    assert rows(spark.read.parquet(f"{base}/each")) == [(1, r), (2, r), (3, r)]
    with pytest.raises(ValueError):
        lw.run_masked_stream(spark, "SELECT 1", {"people": people}, policy, f"{base}/x", f"{base}/y")
    with pytest.raises(Exception, match="cannot be found|not a masked view"):
        stream = spark.readStream.schema(people.schema).parquet(f"{base}/in")
        lw.run_masked_stream(spark, f"SELECT * FROM parquet.`{base}/in`", {"people": stream}, policy, f"{base}/x", f"{base}/y")
