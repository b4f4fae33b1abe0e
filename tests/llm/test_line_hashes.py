"""Words of a line are hashed as its normalised text has them."""

import random

import numpy as np
from pyspark.sql import functions as F

from lakewarden.llm import lines


def test_lines_hash_alike_if_their_normalised_texts_are_alike(spark):
    draw = random.Random(8)
    pieces = ["Word", "wORD", "x1", "Été", "été", "日本", "İ", "i̇", "K", "k", "K", "--", " ", "\t", "\r", "\x00", "_", "\n", "\n", " ", "กข", "\U0001f600", "9", "٤"]
    texts = ["".join(draw.choice(pieces) for _ in range(draw.randint(0, 30))) for _ in range(600)] + ["", "\n", "\n\n", "a"]
    df = spark.createDataFrame(list(enumerate(texts)), "id bigint, text string")
    each = df.select("id", F.posexplode(F.split("text", "\n", -1)).alias("line", "body")).select("id", "line", lines.normalised(F.col("body")).alias("norm"))
    norm = {(r.id, r.line): r.norm for r in each.collect() if r.norm}
    readable = [bytes(r.text) for r in lines._readable(df).orderBy("id").collect()]
    text, number, sizes, l1, l2, words = lines.hashed_words(readable)
    assert set(zip(text.tolist(), number.tolist(), strict=True)) == set(norm)
    by_norm, by_word, at = {}, {}, 0
    for t, n, size, one, two in zip(text.tolist(), number.tolist(), sizes.tolist(), l1.tolist(), l2.tolist(), strict=True):
        said = norm[t, n]
        assert by_norm.setdefault(said, (one, two)) == (one, two) and size == len(said.split(" "))
        for word in said.split(" "):
            assert by_word.setdefault(word, words[at]) == words[at]
            at += 1
    assert at == len(words)
    for part in (0, 1):
        assert len({h[part] for h in by_norm.values()}) == len(by_norm)
    assert len(set(by_word.values())) == len(by_word)


def test_lines_of_no_text():
    for texts in ([], [b""], [b"\n", b"-"]):
        assert [len(x) for x in lines.hashed_words(texts)] == [0] * 6
    assert lines.hashed_words([b"", b"-\nA b"])[0].tolist() == [1] and lines.hashed_words([b"", b"-\nA b"])[1].tolist() == [1]


def test_normalising_takes_no_expression_of_ascii_texts(spark):
    """The slowest stage: each line was cut into words and hashed by expressions of its own, row by row."""
    df = spark.createDataFrame([(1, 2, "a b\nc")], "id bigint, rk bigint, text string")
    plan = lines._lines(df, 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "xxhash64" not in plan
    assert np.all(lines.LETTERS[[10, 32, 95, 0]] == 0) and bytes(lines.LETTERS[list(b"Az09")]) == b"az09"
