"""Classification by files, detectors that are functions, documents of any depth, running counters, quoted statements."""

import math
import random

import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F

import lakewarden as lw
from lakewarden.functions import is_json_document, json_has_pii_key
from lakewarden.functions.detectors import should_redact_sql


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


# ---- files ------------------------------------------------------------------


def test_files_are_read_once(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "counts")
    first = spark.createDataFrame([(1, "a@b.io", "x"), (2, "plain", None)], "n int, note string, email string")
    first.coalesce(1).write.parquet(path)
    assert rows(lw.classify_files(spark.read.parquet(path), store)) == rows(lw.classify_columns(spark.read.parquet(path)))
    before = spark.read.parquet(store).count()
    lw.classify_files(spark.read.parquet(path), store)
    assert spark.read.parquet(store).count() == before  # nothing new, nothing read
    spark.createDataFrame([(3, "10.0.0.1", "y"), (4, "fine", "z")], "n int, note string, email string").coalesce(1).write.mode("append").parquet(path)
    # a column that came later
    spark.createDataFrame([(5, "ok", "z", "4111111111111111")], "n int, note string, email string, more string").coalesce(1).write.mode("append").parquet(path)
    table = spark.read.option("mergeSchema", "true").parquet(path)
    found = lw.classify_files(table, store)
    assert spark.read.parquet(store).select("file_path").distinct().count() == 3
    now = {r.column_name: (r.non_null, r.hits) for r in found.collect()}
    whole = {r.column_name: (r.non_null, r.hits) for r in lw.classify_columns(table).collect()}
    assert now == whole and now["note"] == (5, 2) and now["more"] == (1, 1)


def test_the_second_reading_opens_new_files_only(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "counts")
    spark.range(1000).selectExpr("concat('u', id) as note").coalesce(1).write.parquet(path)
    lw.classify_files(spark.read.parquet(path), store)
    spark.range(5).selectExpr("concat('u', id, '@x.io') as note").coalesce(1).write.mode("append").parquet(path)
    table = spark.read.parquet(path)
    new = [r.file_path for r in table.select("_metadata.file_path").distinct().collect()]
    old = {r.file_path for r in spark.read.parquet(store).collect()}
    df = table.where(F.col("_metadata.file_path").isin([p for p in new if p not in old])).select("note")
    df.collect()
    leaf = df._jdf.queryExecution().executedPlan().collectLeaves().apply(0)
    assert leaf.metrics().apply("numFiles").value() == 1
    assert lw.classify_files(table, store).where("column_name = 'note'").first().hits == 5


def test_gone_and_rewritten_files(spark, tmp_path):
    path, store = str(tmp_path / "t"), str(tmp_path / "counts")
    spark.createDataFrame([("a@b.io",)], "note string").write.parquet(path)
    assert lw.classify_files(spark.read.parquet(path), store).first().sensitive
    spark.createDataFrame([("plain",), ("also",)], "note string").coalesce(1).write.mode("overwrite").parquet(path)
    assert tuple(lw.classify_files(spark.read.parquet(path), store).first())[:4] == ("note", False, 2, 0)
    # other rules do not use these counts
    word = lw.vector_detector("word", lambda v: pc.equal(v, "plain"))
    assert lw.classify_files(spark.read.parquet(path), store, detectors=(*lw.DETECTORS, word)).first().hits == 1
    assert lw.classify_files(spark.read.parquet(path), store).first().hits == 0


def test_incremental_policy_and_nested_columns(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select 1 as n, array('a@b.io', 'x') as tags, named_struct('ssn', 'q', 'b', 'fine') as s").write.parquet(path)
    table = spark.read.parquet(path)
    policy = lw.incremental_policy({"t": table}, str(tmp_path / "counts"))
    assert rows(policy) == rows(lw.mask_policy({"t": table})) == [("t", "s.ssn", "name"), ("t", "tags[]", "value")]


# ---- detectors that are functions -------------------------------------------


def test_vector_detector_over_nested_columns(spark):
    zed = (*lw.DETECTORS, lw.vector_detector("zed", lambda v: pc.match_substring(v, "zed")))
    schema = (
        "i int, t string, s struct<mail:string,b:string,ssn:string,n:int>, a array<string>, aa array<array<string>>, "
        "m map<string,string>, mk map<string,int>, sa array<struct<x:string,y:string>>"
    )
    data = [
        (1, "a zed", ("x@y.io", "zed1", None, 5), ["zed", "ok", None], [["zed2"], None, []], {"k": "zed", "password": "b"}, {"zedkey": 1}, [("p", "zed")]),
        (2, None, None, None, None, None, None, None),
        (3, "fine", ("", "no", "s", None), [], [["q", "a@b.io"]], {"k": None}, {"k": 2}, [None, ("zed", "q")]),
    ]
    df = spark.createDataFrame(data, schema)
    r = "<redacted>"
    expected = [
        (1, r, (r, r, r, 5), [r, "ok", None], [[r], None, []], {"k": r, "password": r}, None, [("p", r)]),
        (2, None, None, None, None, None, None, None),
        (3, "fine", ("", "no", r, None), [], [["q", r]], {"k": None}, {"k": 2}, [None, (r, "q")]),
    ]
    for parts in (1, 3):
        out = lw.redact(df.repartition(parts), nested=True, detectors=zed).orderBy("i").collect()
        assert [tuple(x) for x in out] == expected
    hits = {x.column_name: x.hits for x in lw.classify_columns(df, detectors=zed).collect()}
    assert hits["aa[][]"] == 2 and hits["s.b"] == 1 and hits["mk{key}"] == 1 and hits["sa[].x"] == 1 and hits["t"] == 1 and hits["m{}"] == 1
    # without it the expressions alone
    assert {x.column_name: x.hits for x in lw.classify_columns(df).collect()}["aa[][]"] == 1


def test_vector_detector_sees_slices_and_null_verdicts(spark):
    seen = lw.vector_detector("odd", lambda v: pc.if_else(pc.equal(v, "null"), pa.scalar(None, pa.bool_()), pc.equal(v, "yes")))
    df = spark.range(5000).selectExpr("id", "array(if(id % 3 = 0, 'yes', 'no'), 'null') as a", "if(id % 2 = 0, array(named_struct('x', 'yes')), null) as s")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        out = lw.redact(df, nested=True, detectors=(seen,)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(x.a == ["<redacted>" if x.id % 3 == 0 else "no", "null"] for x in out)
    assert all(x.s == (None if x.id % 2 else [("<redacted>",)]) for x in out)


def test_a_detector_must_judge_every_value(spark):
    short = lw.vector_detector("short", lambda v: pa.array([], pa.bool_()))
    with pytest.raises(Exception, match="verdicts for"):
        lw.redact(spark.createDataFrame([("x",)], "t string"), detectors=(short,)).collect()


def test_anonymised_sql_with_a_vector_detector(spark):
    seen = lw.vector_detector("blue", lambda v: pc.equal(v, "blue"))
    df = spark.createDataFrame([(1, ["blue", "red"]), (2, ["red"])], "n int, colours array<string>")
    out = lw.run_sql(spark, "SELECT n, colours FROM t", anonymize=True, tables={"t": df}, detectors=(*lw.DETECTORS, seen))
    assert all(c == "<redacted>" for x in out.collect() for c in x.colours)  # the policy masks the whole part


# ---- documents of any depth -------------------------------------------------


def nested(n, broken=None):
    text = '{"password":' + '[{"a":' * n + "1" + "}]" * n + "}"
    return {
        None: text, "comma": text.replace("1", "1,,", 1), "swap": text.replace("}]", "}}", 1), "junk": text + " x", "key": text.replace('{"a":1', "{1:1"),
        "open": text[:-1], "more": text + "}", "words": text.replace("1", "true false"),
    }[broken]


def test_json_of_any_depth(spark):
    kinds = (None, "comma", "swap", "junk", "key", "open", "more", "words")
    cases = [(nested(n, k), k is None) for n in (400, 600, 5000) for k in kinds]
    cases += [
        ('{"password": [1 2' + "[]" * 500 + "]}", False), ('["password", 1 2' + ",[]" * 1000 + "]", False), ("[" * 5000 + "]" * 5000, True),
        ("[" * 5000 + "]" * 4999, False), ("[" * 3000 + '"password":1' + "]" * 3000, False), ("[true ,null , -1.5e3 , \"[\"" + ",[]" * 1000 + "]", True),
        ("[s" + ",[]" * 1000 + "]", False), ("[00" + ",[]" * 1000 + "]", False), ('{"a":1' + ',"b":{}' * 1000 + ",}", False),
        ("[" * 1500 + "{}" + "]" * 1500 + "\n\t ", True), ("[" * 1500 + "," + "]" * 1500, False), ("[" * 1200 + "]" * 1200 + "[]", False),
    ]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string").repartition(8)
    out = df.select("i", is_json_document(F.col("t")).alias("a"), json_has_pii_key(F.col("t")).alias("b"), F.expr(should_redact_sql("t")).alias("c")).collect()
    key = {i for i, (t, ok) in enumerate(cases) if ok and '"password":' in t}
    assert {r.i: r.a for r in out} == {i: ok for i, (_, ok) in enumerate(cases)}
    assert {r.i for r in out if r.b} == key and {r.i for r in out if r.c} == key


# ---- running counters -------------------------------------------------------


def landing(day, times, reset=None):
    """A server's counters after executions of these times."""
    n = len(times)
    mean = sum(times) / n
    return (1, "q", n, n * 2, sum(times), mean, math.sqrt(sum((t - mean) ** 2 for t in times) / n), f"2024-01-{day:02} 00:00:00", reset)


COUNTERS = "db_id int, query string, calls bigint, rows bigint, total_exec_time double, mean_exec_time double, stddev_exec_time double, at string, stats_reset string"


def test_counters_over_landings_and_a_reset(spark):
    rng = random.Random(1)
    before, after = [rng.uniform(1, 900) for _ in range(60)], [rng.uniform(1, 50) for _ in range(25)]
    seen = [landing(1, before[:20]), landing(2, before[:20]), landing(3, before), landing(4, after[:5]), landing(5, after)]
    df = spark.createDataFrame(seen, COUNTERS).withColumn("snapshot_at", F.col("at").cast("timestamp")).drop("stats_reset")
    row = lw.counter_stats(df, counters=("rows",)).first()
    times = before + after
    mean = sum(times) / len(times)
    assert (row.calls, row["rows"]) == (85, 170)
    assert row.mean_exec_time == pytest.approx(mean)
    assert row.stddev_exec_time == pytest.approx(math.sqrt(sum((t - mean) ** 2 for t in times) / len(times)), rel=1e-9)
    steps = lw.counter_increments(df, counters=("rows",)).orderBy("snapshot_at").collect()
    assert [(s.calls, s.reset) for s in steps] == [(20, True), (0, False), (40, False), (5, True), (20, False)]
    part = before[20:]
    assert steps[2].m2 == pytest.approx(sum((t - sum(part) / 40) ** 2 for t in part), rel=1e-9)


def test_a_told_reset_counts_even_if_counters_grew(spark):
    seen = [landing(1, [5.0, 7.0], "a"), landing(2, [1.0, 2.0, 30.0], "b")]
    df = spark.createDataFrame(seen, COUNTERS).withColumn("snapshot_at", F.col("at").cast("timestamp"))
    row = lw.counter_stats(df, counters=("rows",)).first()
    assert (row.calls, row.total_exec_time, row["rows"]) == (5, 45.0, 10)


# ---- statements with quotes -------------------------------------------------


@pytest.mark.parametrize(
    ("sql", "plain", "strict"),
    [
        ("select '--' as x; drop table t", True, False),
        ("select '/*'; delete from t; select '*/'", True, False),
        ("select 'drop'", False, True),
        ('select "update" from t', False, True),
        ("select $a$ drop $b$ -- $a$ from t", False, True),
        ("select $a$ x $a$; truncate t", False, False),
        ("-- it's\nselect 1", True, True),
        ("/* ' */ select 1 /* ' */; grant x", False, False),
        (r"select E'\'' ; revoke x -- '", False, False),
        (r"select E'\'; alter t; '", False, True),
        ("select 'it''s; drop table x'", False, True),
        ("select 'open; drop", False, True),
        ("insert into t values ('select')", False, False),
        ("select a$$b; drop table t; select c$$", False, False),
        ("", False, False),
        (None, False, False),
    ],
)
def test_strict_statements(spark, sql, plain, strict):
    df = spark.createDataFrame([(sql,)], "q string")
    assert lw.classify_statements(df, "q").first().allowed is plain
    assert lw.classify_statements(df, "q", strict=True).first().allowed is strict
