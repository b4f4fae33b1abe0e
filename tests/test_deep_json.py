"""Deep and wide documents are taken apart once, in runs of brackets."""

import json
import random

from pyspark.sql import functions as F

from lakewarden.functions import is_json_document, should_redact
from lakewarden.functions.detectors import _folded, _folded_sql, json_has_pii_key, name_is_pii, should_redact_sql


def test_texts_are_stubbed_once(spark):
    texts = spark.createDataFrame([("[1]",)], "v string")
    plan = texts.select(is_json_document(F.col("v")).alias("j"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("[1-9][0-9]") == 1


def test_fold_is_that_of_a_parser(spark):
    draw = random.Random(8)

    def document(depth):
        kind, n = draw.randrange(6), draw.randrange(4)
        if depth == 0 or kind < 2:
            return draw.choice(["0", '""', "true", "null", "false"])
        parts = [document(depth - 1) for _ in range(n)]
        return f"[{' , '.join(parts)}]" if kind < 4 else "{" + ",".join('"":' + p for p in parts) + "}"

    texts = ["[0],[0]", "[0]]", '{"":0}{}', "[", "{", '["":0]', '{"",0}', '{"":0,0}', '[0,"":0]', "[k0]", "[s:0]", "{k:0}", '["" ""]', "[true0]", "[,0]", "[0,]", '{"":0,}']
    for _ in range(1500):
        text = list(document(4))
        for _ in range(draw.choice([0, 1, 1, 2])):
            text.insert(draw.randrange(len(text) + 1), draw.choice('[]{},:0"s k'))
            del text[draw.randrange(len(text))]
        if text and text[0] in "[{":
            texts.append("".join(text))

    def good(text):
        try:
            json.loads(text)
        except ValueError:
            return False
        return set(text.replace('""', "").replace("true", "").replace("false", "").replace("null", "")) <= set("[]{},:0 ")

    rows = spark.createDataFrame([(t,) for t in texts], "v string").select("v", _folded(F.col("v")), F.expr(_folded_sql("v"))).collect()
    assert all(good(r[0]) == r[1] == r[2] for r in rows) and 300 < sum(r[1] for r in rows) < len(rows) - 300


def test_verdicts_on_deep_and_wide_documents(spark):
    deep = '{"pwd":[' * 2000 + "1" + "]}" * 2000
    comb = "[" * 1500 + '{"pwd":0}' + ",1]" * 1500
    wide = "[" + ",".join(['{"pwd":[1]}'] * 1000) + "]"
    texts = [deep, comb, wide, deep[:-1], deep[:-2] + "}]", comb.replace(",1]", ",,1]", 1), wide[:-1] + ",]", comb[:-1] + "}"]
    rows = spark.createDataFrame([(n, t) for n, t in enumerate(texts)], "n int, v string").select("n", is_json_document(F.col("v")), should_redact("v", F.col("v"))).collect()
    assert [(r[1], r[2]) for r in sorted(rows)] == [(True, True)] * 3 + [(False, False)] * 5


def test_keys_are_found_in_one_pass(spark):
    """Taking all strings out of a document took as long as the fold of its brackets; so did looking behind each letter for a number."""
    texts = spark.createDataFrame([("[1]",)], "v string")

    def plan(verdict):
        return texts.select(verdict)._jdf.queryExecution().analyzed().toString()

    assert "array_join" not in plan(json_has_pii_key(F.col("v"), ["pwd"])) and "array_join" not in should_redact_sql("v")
    assert "(?=[\\-0-9])(?<!" in plan(is_json_document(F.col("v")))


def test_sensitive_keys_are_those_of_a_parser(spark):
    draw = random.Random(9)
    parts = ["pass", "word", "x", "\\\\", "\\u0070", "assword", "\\n", '\\"', "PassWord", ":", "{", "\\\\u0070assword", "Key", "api_", "é", ","]

    def string():
        return '"' + "".join(draw.choices(parts, k=draw.randrange(4))) + '"'

    def document(depth):
        if depth == 0 or draw.random() < 0.3:
            return string()
        inner = [document(depth - 1) for _ in range(draw.randrange(4))]
        return "[" + ", ".join(inner) + "]" if draw.random() < 0.4 else "{" + ",".join(string() + draw.choice([":", " : "]) + x for x in inner) + "}"

    texts = [t for t in (document(4) for _ in range(1500)) if t[0] in "[{"]

    def keys(value):
        if isinstance(value, dict):
            yield from (k for pair in value["pairs"] for k in [pair[0], *keys(pair[1])])
        elif isinstance(value, list):
            yield from (k for x in value for k in keys(x))

    def wanted(text):
        found = keys(json.loads(text, object_pairs_hook=lambda pairs: {"pairs": pairs}))
        return any(name_is_pii(k) for k in found)

    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = rows.select("v", json_has_pii_key(F.col("v")), F.expr(should_redact_sql("v"))).collect()
    assert all(r[1] == r[2] == wanted(r[0]) for r in got) and 200 < sum(r[1] for r in got) < len(got) - 200
    long = '{"a":"' + "password " * 50_000 + '","' + "x" * 200_000 + '":[' + '"password",' * 2000 + "1]}"
    assert [tuple(r) for r in spark.createDataFrame([(long,), (long.replace("]}", '],"pwd":1}'),)], "v string").select(json_has_pii_key(F.col("v"))).collect()] == [(False,), (True,)]
