"""Repeated lines of any length, and edits at any place."""

import random

import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from lakewarden.llm import lines
from lakewarden.llm.queries import QUERIES


def removed(df):
    return {(r.doc_id, r.n_removed_lines) for r in df.collect()}


def test_repeats_of_few_words_go(spark, tmp_path):
    rows = [(1, "All rights reserved.\nLes.\n\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\n\n"), (2, "all rights reserved\n\n LES \nother"), (3, "\u65e5\u672c\u8a9e\u306e\u6587\u7ae0\u3002\n...")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op3_lines"](spark, str(tmp_path))
    assert removed(found) == {(1, 0), (2, 2), (3, 1)}
    left = {r.doc_id: r.text for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left == {1: rows[0][1], 2: "\nother", 3: "..."}


def edited(words, places, draw):
    """The words with an edit of each kind at the places."""
    out = list(words)
    for at in sorted(places, reverse=True):
        kind = draw.randrange(3)
        out[at : at + (kind != 1)] = [draw.getrandbits(62)] if kind < 2 else []
    return out


@pytest.mark.parametrize("often", [False, True])
def test_linked_lines_always_meet(often):
    draw, count = random.Random(4), 0
    for n in [5, 6, 9, 10, 15, 20, 30, 64, 150, 260, 700] * 40:
        a = [draw.getrandbits(62) if draw.random() < 0.5 else draw.randrange(50) for _ in range(n)]
        most = n // 5
        ends = [0, n - 1, *range(1, n - 1)]
        b = edited(a, ends[:most] if draw.random() < 0.3 else draw.sample(range(n), draw.randint(1, most)), draw)
        longer = max(len(a), len(b))
        if a == b or longer - lines.edit_distance(a, b) < 0.8 * longer:
            continue
        hashes = np.array([*a, *b], np.int64) * 7046029254386353131
        sizes, known = np.array([len(a), len(b)]), np.sort(np.arange(50) * 7046029254386353131)
        line, key = lines.word_keys(hashes, sizes, (known, np.arange(50)) if often else (known[:0], known[:0]), 0.8)
        assert set(key[line == 0]) & set(key[line == 1])
        rows = pd.DataFrame(lines.signatures(hashes, np.array([0, len(a)])), columns=[f"s{k}" for k in range(lines.WORDS)])
        rows["n"] = sizes
        rows["wide"] = [lines.signatures(h, np.array([0]), lines.WIDE).tobytes() for h in np.split(hashes, [len(a)])]
        assert lines._Filter(rows, 0.8).near(np.array([0]), np.array([1])).all()
        count += 1
    assert count > 200


def test_lines_edited_at_both_ends_go(spark):
    draw, rows, gone = random.Random(9), [], 0
    for n in (5, 10, 15, 20, 30, 250):
        for places in ([0], [n - 1], [n // 2], [0, n - 1], [0, n // 2, n - 1]):
            words = [f"w{draw.getrandbits(40)}" for _ in range(n)]
            near = [f"x{draw.getrandbits(40)}" if k in places else w for k, w in enumerate(words)]
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(near))]
            gone += len(places) <= n // 5
    found = lines.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), share=0.8, exact=True)
    assert found.count() == gone and all(r.id % 2 for r in found.collect())


def test_planted_edits_at_any_place_meet_by_simhash(spark):
    draw, rows, near = random.Random(5), [], 0
    for n in (10, 12, 20, 30, 60, 150, 400):
        for turn in range(30):
            words = [f"w{draw.getrandbits(40)}" for _ in range(n)]
            most = n // 10
            places = [0, n - 1, *range(1, n - 1)][:most] if turn % 3 == 0 else draw.sample(range(n), draw.randint(1, most))
            other = [str(w) for w in edited(words, places, draw)]
            longer = max(n, len(other))
            near += longer - lines.edit_distance(words, other) >= 0.9 * longer
            rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other))]
            # one edit too many is no repeat
            far = [f"x{k}" if k <= most else w for k, w in enumerate(words)]
            rows.append((len(rows), " ".join(far)))
    found = [r.id for r in lines.repeated_lines(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()]
    assert all(i % 3 == 1 for i in found) and 0.9 * near <= len(found) <= near


def test_simhash_of_long_lines_is_that_of_their_words():
    draw = np.random.default_rng(2)
    sizes = np.array([12, 127, 128, 3 * lines.VOTES + 5, 40])
    hashes = draw.integers(-(2**62), 2**62, sizes.sum())
    starts = np.cumsum(sizes) - sizes
    whole = lines.simhash(hashes, starts, 4)
    for k, (s, n) in enumerate(zip(starts, sizes, strict=True)):
        assert (lines.simhash(draw.permutation(hashes[s : s + n]), np.array([0]), 4)[0] == whole[k]).all()
