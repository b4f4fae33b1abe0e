from decimal import Decimal

from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakewarden import classify_columns, mask_columns, mask_policy, redact, redaction_verdicts, rows_to_json

R = "<redacted>"


def test_rows(spark):
    df = spark.createDataFrame(
        [(1, "u@x.com", "active", None), (2, None, "c@d.com", 1.5)], "id int, email string, status string, score double"
    )
    assert [tuple(r) for r in redact(df).collect()] == [(1, R, "active", None), (2, R, R, 1.5)]


def test_sensitive_name_makes_a_string_of_any_type(spark):
    df = spark.createDataFrame([(1, 2, Decimal("3.1"))], "id int, account_number int, tax_id decimal(5,1)")
    out = redact(df)
    assert [f.dataType for f in out.schema] == [T.IntegerType(), T.StringType(), T.StringType()]
    assert tuple(out.first()) == (1, R, R)


def test_payload_and_json(spark):
    df = spark.createDataFrame([("x", '{"email":"x@y.com"}', '{"a":1}')], "payload string, metadata string, config string")
    assert tuple(redact(df).first()) == (R, R, '{"a":1}')


def test_empty_input_keeps_its_schema(spark):
    df = spark.createDataFrame([], "id int, email string")
    assert redact(df).collect() == [] and redact(df).columns == ["id", "email"]


def test_repeated_and_odd_column_names(spark):
    df = spark.sql("select 'a@b.c' as x, 'ok' as x, 1 as `a.b`, 'q' as `we``ird`")
    out = redact(df)
    assert out.columns == ["x", "x", "a.b", "we`ird"] and tuple(out.first()) == (R, "ok", 1, "q")


def test_nested_only_on_request(spark):
    df = spark.sql(
        """select struct(1 as id, 'a@b.c' as note, 'x' as email, array('10.0.0.1', 'ok') as hosts) as s,
             map('password', 'x', 'other', 'y', 'mail', 'c@d.e') as m, cast(null as struct<email: string>) as n"""
    )
    assert redact(df).first() == df.first()
    out = redact(df, nested=True).first()
    assert out.s.asDict() == {"id": 1, "note": R, "email": R, "hosts": [R, "ok"]}
    assert out.m == {"password": R, "other": "y", "mail": R} and out.n is None


def test_verdicts(spark):
    df = spark.createDataFrame([(1, None, "a@b.c"), (2, "x", "ok")], "id int, email string, note string")
    assert [tuple(r) for r in redaction_verdicts(df).collect()] == [(False, True, True), (False, True, False)]


def test_mask_keeps_types_and_order(spark):
    df = spark.createDataFrame([(1, None, 2.5, "x")], "id int, Email string, tax_id double, status string")
    out = mask_columns(df, ["EMAIL", "tax_id", "absent"])
    assert out.dtypes == df.dtypes and tuple(out.first()) == (1, R, None, "x")


def test_whole_row_sees_masked_values(spark):
    df = mask_columns(spark.createDataFrame([(1, "a@b.c", None)], "id int, email string, x string"), ["email"])
    assert rows_to_json(df).first()[0] == '{"id":1,"email":"<redacted>","x":null}'
    assert rows_to_json(df.where("id > 1")).collect() == []


def test_classify_counts_every_value(spark):
    df = spark.createDataFrame(
        [("a@b.c", "x", 1, None), ("x", None, 2, None), (None, "y", 3, None)],
        "note string, status string, api_key int, empty string",
    ).repartition(3)
    rows = {r.column_name: tuple(r)[1:] for r in classify_columns(df).collect()}
    assert rows == {
        "note": (False, 2, 1, 0.5, True), "status": (False, 2, 0, 0.0, False),
        "api_key": (True, 3, 0, 0.0, True), "empty": (False, 0, 0, 0.0, False),
    }
    strict = {r.column_name: r.sensitive for r in classify_columns(df, min_hits=2).collect()}
    assert strict == {"note": False, "status": False, "api_key": True, "empty": False}


def test_classify_wide_table(spark):
    names = [f"c{i}" for i in range(230)]
    df = spark.range(3).select(*[F.lit("a@b.c" if i % 50 == 0 else "x").alias(n) for i, n in enumerate(names)])
    rows = classify_columns(df).collect()
    assert sorted(r.column_name for r in rows) == sorted(names)
    assert {r.column_name for r in rows if r.sensitive} == {"c0", "c50", "c100", "c150", "c200"}


def test_policy_reasons(spark):
    people = spark.createDataFrame([("a@b.c", "x", "k")], "note string, status string, email string")
    rows = {tuple(r) for r in mask_policy({"people": people}).collect()}
    assert rows == {("people", "note", "value"), ("people", "email", "name")}
    rows = {tuple(r) for r in mask_policy({"people": people}, classify=False).collect()}
    assert rows == {("people", "email", "name")}
