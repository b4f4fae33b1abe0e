"""Names, values and JSON keys, vector by vector."""

import json
import random

import pytest
from pyspark.sql import functions as F

from lakewarden import DETECTORS, Detector, redact
from lakewarden.functions import (
    PII_KEYWORDS,
    detect,
    is_json_document,
    is_pii_name,
    json_has_pii_key,
    name_is_pii,
    should_redact,
    value_is_pii,
)
from lakewarden.functions.detectors import should_redact_sql

# every keyword by itself and inside other words, and names that hold none
NAMES = {
    **{word: True for word in PII_KEYWORDS}, **{f"Old_{word.upper()}2": True for word in PII_KEYWORDS},
    "monkey": True, "salted": True, "asphlt": False, "weight": False, "first": False, "": False,
}

_HEX, _MIXED = "0badc0de" * 4, "Zz9_" * 10
# value -> detectors that must hit; an empty set is a near miss
VALUES = {
    "clerk+box@depot.parcels.test": {"email"},
    "9%_@-.q": {"email"},
    "clerk@depot": set(),
    "clerk@depot.test\n": set(),
    "\tclerk@depot.test": set(),
    "eyJ0eXAiOiJub25l.eyJib3giOjEyMzQ1Nn0.c2lnbmVk": {"jwt"},
    "eyJ0eXAiOiJub25l.eyJib3giOjEyMzQ1Nn0.": {"jwt"},
    "eyJ0eXAi.eyJib3giOjEyMzQ1Nn0.c2ln": set(),
    "NL20INGB0001234567": {"iban"},
    "NL20 INGB 0001 2345 67": {"iban"},
    "\u2003NL20\u3000INGB\ufeff": {"iban"},
    "nl20ingb0001234567": set(),
    "NL20ING": set(),
    "$2y$12$pepperpepperpepper": {"password_hash"},
    "$2a$4$ trailing text": {"password_hash"},
    "$argon2d$m=4096": {"password_hash"},
    "$scrypt$ln=14": {"password_hash"},
    "scrypt:16384:8:2$grain$0011": {"password_hash"},
    "{SHA256}0123456789abcdefghij": {"password_hash"},
    "hash $2y$12$pepper": set(),
    "172.16.254.3": {"ipv4"},
    "300.400.500.600": {"ipv4"},
    "172.16.0.0/12": {"ipv4"},
    "172.16.254": set(),
    "172.16.0.0/1200": set(),
    "2001:db8::7": {"ipv6"},
    "23:59:01": {"ipv6"},
    "f:00": set(),
    "2001:db8::7%en1": set(),
    "+31201234567": {"phone"},
    "+31 (0)20-123.45.67": {"phone"},
    "+0031201234567": set(),
    "+3120123": set(),
    "+3120123456789012": set(),
    _HEX: {"hex_secret"},
    _HEX[1:]: set(),
    _MIXED: {"base64_secret"},
    _HEX + "0badc0de": {"hex_secret", "base64_secret"},
    _MIXED + "==": {"base64_secret"},
    _MIXED + "===": set(),
    "5500005555555559": {"card"},
    "5500 0055 5555 5559": {"card"},
    "5500-0055-5555-5559": {"card"},
    "5500\u00a00055\u20035555\u30005559": {"card"},
    "5500005555555558": set(),
    "00000000000000": {"card"},
    "0000000000": set(),
    "parcel": set(),
    "98765": set(),
    "": set(),
}

JSON = {
    '{"box":3,"Email_2":null}': True,
    '{"to":{"postcode":"1234 AB"}}': True,
    '[{"box":1},{"ssn":[]}]': True,
    '[[[{"x":{"my_salt":0}}]]]': True,
    '{"pass\\u0077ord":1}': True,
    '{"\\u212aey":1}': True,
    '{"q":"\\"","iban"\t:\r\n2}': True,
    '{"b":1,"b":{"dob":2},"b":3}': True,
    '{"dob":1}\n\n': True,
    '{"box":3,"weight":5.5e-1}': False,
    '{"say":"ssn: none"}': False,
    '["ssn","dob"]': False,
    '{"say":"\\"ssn\\":1"}': False,
    '\n{"dob":1}': False,
    '{"dob":1} and more': False,
    '{"dob":1}{"box":2}': False,
    '{"dob":1}],[2': False,
    '{"dob":Infinity}': False,
    "{'dob':1}": False,
    "{dob:1}": False,
    '{"dob":+1}': False,
    '{"dob":1.}': False,
    '{"dob":"\x01"}': False,
    '{"dob":"\\x"}': False,
    "{}": False,
    '"dob"': False,
    "no json": False,
}
# sizes at which a parser would give up
BIG_JSON = {
    '{"email":"x@y.zz","n":' + "7" * 5000 + "}": True,
    '{"n":' + "7" * 5000 + "}": False,
    '{"a":' * 3000 + '{"email":1}' + "}" * 3000: True,
    '{"' + "a" * 60_000 + '":1,"email":2}': True,
    '{"' + "a" * 60_000 + 'email":2}': True,
    '{"email":"' + "a" * 21_000_000 + '"}': True,
    '{"email":"' + "\\n" * 1_000_000 + '"}': True,
    '{"email":' + "7" * 5000 + "x}": False,
}


def column(spark, values):
    return spark.createDataFrame([(v,) for v in values], "v string")


@pytest.mark.parametrize(("name", "expected"), NAMES.items())
def test_name_at_plan_time(name, expected):
    assert name_is_pii(name) is expected


def test_name_column(spark):
    rows = column(spark, [*NAMES, None]).select("v", is_pii_name(F.col("v"))).collect()
    assert {r[0]: r[1] for r in rows} == {**NAMES, None: False}


def test_keywords_can_be_narrowed():
    assert name_is_pii("o_orderkey") and not name_is_pii("o_orderkey", [k for k in PII_KEYWORDS if k != "key"])
    assert not name_is_pii("email", [])


def test_every_detector_on_every_value(spark):
    tests = [detect(d.name, F.col("v")).alias(d.name) for d in DETECTORS]
    for row in column(spark, VALUES).select("v", *tests, value_is_pii(F.col("v")).alias("any")).collect():
        hits = {d.name for d in DETECTORS if row[d.name]}
        assert hits == VALUES[row.v], row.v
        assert row["any"] is bool(hits), row.v


def test_null_value_is_no_hit(spark):
    row = column(spark, [None]).select(value_is_pii(F.col("v")), should_redact("status", F.col("v"))).first()
    assert tuple(row) == (False, False)


def test_json_keys(spark):
    rows = column(spark, [*JSON, None]).select("v", json_has_pii_key(F.col("v"))).collect()
    assert {r[0]: r[1] for r in rows} == {**JSON, None: False}


def _random_json(rng, depth=0):
    kind = rng.random()
    if depth > 4 or kind < 0.35:
        return rng.choice(
            ["1", "-0.5e+3", "true", "false", "null", '"x"', '"email"', r'"\"pwd\":"', '"a:b"', r'"ée"', '""', "1e999"]
        )
    gap = rng.choice(["", " ", "\n", "\t "])
    items = [_random_json(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    if kind < 0.6:
        return "[" + gap + f"{gap},".join(items) + gap + "]"
    keys = [
        rng.choice(["a", "b", "status", "k:", "é", r"x\\", r'q\"email', "Phone", r"em\u0061il", "api_key", "note", ""])
        if rng.random() < 0.3 else "z" for _ in items
    ]
    pairs = [f'"{k}"{gap}:{gap}{v}' for k, v in zip(keys, items, strict=True)]
    return "{" + gap + f",{gap}".join(pairs) + "}" + gap


def test_json_keys_equal_a_parser(spark):
    rng = random.Random(5)
    values = []
    for _ in range(1500):
        text = _random_json(rng)
        if rng.random() < 0.4 and text:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(["", ",", "}", "]", '"', "\\", ":", " ", "x", "\x01", "NaN"]) + text[at + rng.randint(0, 1):]
        values.append(text)

    def truth(text):
        keys = []

        def refuse(constant):
            raise ValueError(constant)

        try:
            json.loads(text, parse_constant=refuse, object_pairs_hook=lambda pairs: keys.extend(k for k, _ in pairs))
        except ValueError:
            return False
        return text[:1] in ("{", "[") and any(name_is_pii(k) for k in keys)

    found = [r[0] for r in column(spark, values).select(json_has_pii_key(F.col("v"))).collect()]
    wrong = [(v, f) for v, f in zip(values, found, strict=True) if f != truth(v)]
    assert wrong == [] and sum(found) > 100


def test_both_forms_of_the_verdict_agree(spark):
    rng = random.Random(6)
    values = [*VALUES, *JSON, *(_random_json(rng) for _ in range(500)), None]
    both = column(spark, values).select("v", should_redact("status", F.col("v")).alias("a"), F.expr(should_redact_sql("v")).alias("b"))
    assert both.where("a IS DISTINCT FROM b").collect() == []
    expected = {v for v, hits in VALUES.items() if hits} | {v for v, hit in JSON.items() if hit}
    hits = {r.v for r in both.where("b").collect()}
    assert {v for v in (*VALUES, *JSON) if v in hits} == expected
    narrowed = column(spark, ['{"email":1}', '{"pet":1}', '{"o\'s":1}'])
    words = ["pet", "o's"]
    rows = narrowed.select(should_redact("x", F.col("v"), words), F.expr(should_redact_sql("v", words))).collect()
    assert [tuple(r) for r in rows] == [(False, False), (True, True), (True, True)]


def test_json_long_text(spark):
    # every string of a long document is read, none is cut
    long = '{"a":[' + ",".join('"xxxxxxxxxxxxxxxxxx"' for _ in range(60_000)) + ',{"pwd":1}]}'
    rows = column(spark, [long, long.replace("pwd", "abc")]).select(json_has_pii_key(F.col("v"))).collect()
    assert [r[0] for r in rows] == [True, False]


def test_json_document(spark):
    rows = column(spark, ["{}", "[1]", "1", "{} {}", "[", None]).select("v", is_json_document(F.col("v"))).collect()
    assert [r[1] for r in rows] == [True, True, False, False, False, False]


def test_custom_detector(spark):
    plate = Detector("plate", lambda c: c.rlike(r"^[A-Z]{2}-\d{3}-[A-Z]{2}\z"))
    df = column(spark, ["AB-123-CD", "a@b.c", "x", ""])
    rows = redact(df, detectors=(*DETECTORS, plate)).collect()
    assert [r.v for r in rows] == ["<redacted>", "<redacted>", "x", ""]
    rows = redact(df, detectors=[plate]).collect()
    assert [r.v for r in rows] == ["<redacted>", "a@b.c", "x", ""]
    with pytest.raises(KeyError):
        detect("plate", F.col("v"))


def test_json_of_any_size(spark):
    df = column(spark, BIG_JSON)
    both = df.select(json_has_pii_key(F.col("v")), F.expr(should_redact_sql("v"))).collect()
    assert [tuple(r) for r in both] == [(hit, hit) for hit in BIG_JSON.values()]
