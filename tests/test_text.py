"""Scans of running text against a plain word-by-word reading."""

import random
import re

from pyspark.sql import functions as F

from lakewarden import DETECTORS, redact_text, scan_text
from lakewarden.functions import detect, fixed_values as fv
from lakewarden.functions.text import WORD_DETECTORS

SPACES = re.compile("[" + re.escape(fv.SPACE_CHARS) + "]+")
PIECES = [
    "a@b.c", "user.name+x@mail-1.example.com", "10.0.0.1", "10.0.0.1/24", "999.1.1", "fe80::1", "f:1:::", "fe80::",
    "12:34:56", "deadbeef" * 4, "DEADBEEF" * 4, "a" * 31, "a" * 40, "x" * 39, "Zz_-+/" * 8 + "==", "4111111111111111",
    "4111-1111-1111-1111", "4111111111111112", "-4111111111111111-", "+33612345678", "+1 (743) 555-3824",
    "4111 1111 1111 1111", "3782 822463 10005", "4111 1111 1111 1112", "FR7630006000011234567890189", "$2b$10$abc", "scrypt:1:2:3$x",
    "{SHA}" + "b" * 24, "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx.", "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIx.sig", "plain", "Élan", "слово",
    "日本語テキスト", "it's", "e.g.", "1,000", "50%", "http://x.io/a?b=c", "user@", "@x", "$", ":", "{}", "%%%", "4785380592391139$$$",
]
WRAPS = [("", ""), ("(", ")"), ('"', '",'), ("<", ">."), ("['", "']!?"), ("", "."), ("", ":"), ("", "###"), ("`", "`;")]
GAPS = [" ", "  ", "\n", "\t", " \n ", "\xa0", "　", "﻿", "\r\n"]


def texts(n, seed):
    rng = random.Random(seed)
    out = ["", " ", "a@b.c", "\n10.0.0.1"]
    for _ in range(n):
        words = []
        for _ in range(rng.randint(1, 30)):
            left, right = rng.choice(WRAPS)
            words.append(left + rng.choice(PIECES) + right + rng.choice(GAPS))
        out.append("".join(words) + rng.choice(["", "end", "a@b.c"]))
    return out


def words_of(text):
    out = []
    for token in SPACES.split(text):
        out.append(re.sub(rf"[{fv.WORD_TRAIL}]+\Z", "", re.sub(rf"^[{fv.WORD_LEAD}]+", "", token)))
    return [w for w in out if w]


def test_scan_equals_reading_word_by_word(spark):
    rows = list(enumerate(texts(300, 1)))
    df = spark.createDataFrame(rows, "id int, text string").repartition(4)
    found = {(r.id, r.detector): r.n for r in scan_text(df, ["id"], "text").collect()}
    # the anchored detectors applied to every word and span, split by Python
    cells = [(i, "word", w) for i, t in rows for w in words_of(t)]
    cells += [(i, "phone", s) for i, t in rows for s in re.findall(fv.PHONE_SPAN, t)]
    spaced = r"(?<![0-9])(?:[0-9]{4} [0-9]{4} [0-9]{4} [0-9]{1,7}|[0-9]{4} [0-9]{6} [0-9]{4,5})(?![0-9])"
    cells += [(i, "card", s) for i, t in rows for s in re.findall(spaced, t)]
    verdicts = spark.createDataFrame(cells, "id int, kind string, v string").select(
        "id", "kind", *[detect(d.name, F.col("v")).alias(d.name) for d in DETECTORS]
    )
    expected = {}
    for r in verdicts.collect():
        names = WORD_DETECTORS if r.kind == "word" else [r.kind]
        for name in names:
            if r[name]:
                expected[r.id, name] = expected.get((r.id, name), 0) + 1
    assert found == expected and len({d for _, d in found}) == 10


def test_redacted_text_holds_nothing_more(spark):
    rows = list(enumerate(texts(300, 2)))
    df = spark.createDataFrame(rows, "id int, text string")
    out = redact_text(df, "text")
    left = scan_text(out, ["id"], "text").where("detector <> 'card' and detector <> 'phone'").collect()
    assert left == []
    before = dict(rows)
    for r in out.collect():
        kept, original = SPACES.findall(r.text), SPACES.findall(before[r.id])
        assert len(kept) <= len(original)
        if fv.REDACTED not in r.text:
            assert r.text == before[r.id]


def test_exact_redaction(spark):
    cases = {
        "mail (a@b.c), or 10.0.0.1.": "mail (<redacted>), or <redacted>.",
        "call +1 (743) 555-3824 now": "call <redacted> now",
        "card 4111 1111 1111 1111, \"4111111111111111\" 4111111111111112": 'card <redacted>, "<redacted>" 4111111111111112',
        "x\t$2b$10$abc.\n\n  deadbeefdeadbeefdeadbeefdeadbeef:": "x\t<redacted>.\n\n  <redacted>:",
        "nothing  here\n": "nothing  here\n",
        "": "",
    }
    df = spark.createDataFrame([(t,) for t in cases], "text string")
    assert [r.clean for r in redact_text(df, "text", "clean").collect()] == list(cases.values())
    assert redact_text(spark.createDataFrame([(None,)], "text string"), "text").first().text is None


def test_long_text_is_read_to_its_end(spark):
    text = "word " * 400_000 + "last@mail.io " + "10.0.0.x " * 100_000 + "10.0.0.9"
    df = spark.createDataFrame([(1, text)], "id int, text string")
    assert {(r.detector, r.n) for r in scan_text(df, ["id"], "text").collect()} == {("email", 1), ("ipv4", 1)}
    clean = redact_text(df, "text").first().text
    assert clean == text.replace("last@mail.io", fv.REDACTED).replace("10.0.0.9", fv.REDACTED)


def test_one_long_word(spark):
    df = spark.createDataFrame([(1, "%" * 2_000_000), (2, "a" * 2_000_000), (3, "1." * 500_000)], "id int, text string")
    assert {(r.id, r.detector) for r in scan_text(df, ["id"], "text").collect()} == {(2, "hex_secret"), (2, "base64_secret")}


def test_repeated_ids_are_summed(spark):
    df = spark.createDataFrame([(1, "a@b.c"), (1, "x d@e.f a@b.c"), (2, None)], "id int, text string")
    assert [tuple(r) for r in scan_text(df, ["id"], "text").collect()] == [(1, "email", 3)]
