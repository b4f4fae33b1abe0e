"""Lines cost little where they are many: characters are looked up, not matched, and keys of many lines are met in parts."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from lakewarden.llm import lines


def test_points_are_as_the_normalised_text_has_them(spark):
    """Texts with any letter beyond ASCII were normalised by regular expressions, which took most of the query's time."""
    taken = [c for a, b in lines.PLAIN for c in range(a, b + 1) if c != 10]
    df = spark.createDataFrame([(c, f"x{chr(c)}y") for c in taken], "id bigint, text string")
    said = {r.id: r.norm for r in df.select("id", lines.normalised(F.col("text")).alias("norm")).collect()}
    for c in taken:
        own = lines.POINTS[c]
        assert said[c] == (f"x{chr(own)}y" if own else "x y"), hex(c)
    held = [(c, chr(c)) for c in range(1, 0x110000, 7) if not 0xD800 <= c < 0xE000] + [(c, chr(c)) for c in (0x130, 0x3A3, 0x52F, 0x530, 0x1E00, 0x2BFF, 0x2C00)]
    other = spark.createDataFrame(held, "id bigint, text string").where(lines._other(F.col("text")))
    inside = {c for a, b in lines.PLAIN for c in range(a, b + 1)}
    assert {r.id for r in other.select("id").collect()} == {c for c, _ in held} - inside


def test_plain_letters_take_no_regular_expression(spark):
    rows = spark.createDataFrame([(1, "Été – “œuvre”\nΔέλτα, Ёж"), (2, "Été\n日本 É")], "id bigint, text string")
    got = {r.id: bytes(r.text).decode() for r in lines._readable(rows).collect()}
    assert got == {1: "Été – “œuvre”\nΔέλτα, Ёж", 2: "Été\n日 本 é"}


def test_a_tree_connects_what_near_pairs_connect(monkeypatch):
    draw = np.random.default_rng(5)
    signs = draw.integers(-(2**63), 2**63 - 1, (60, lines.WORDS))[draw.integers(0, 60, 200)]
    rows = pd.DataFrame(signs, columns=[f"s{k}" for k in range(lines.WORDS)]).assign(n=draw.integers(18, 22, 200))
    pairs = lines._Filter(rows, 0.9)
    for at_once in (lines.PAIRS, 500):
        monkeypatch.setattr(lines, "PAIRS", at_once)
        whole, tree = lines._Forest(190), lines._Forest(190)
        for x in range(10, 200):
            for y in range(x + 1, 200):
                if pairs.near(np.array([x]), np.array([y]))[0]:
                    whole.join(x - 10, y - 10)
        for x, y in zip(*lines._tree(pairs, 10, 200), strict=True):
            assert pairs.near(np.array([x + 10]), np.array([y + 10]))[0] and tree.join(x, y)
        assert [whole.root(x) for x in range(190)] == [tree.root(x) for x in range(190)]


def test_pairs_of_small_and_large_groups(monkeypatch):
    monkeypatch.setattr(lines, "FEW", 3)
    rows = pd.DataFrame(0, index=range(9), columns=[f"s{k}" for k in range(lines.WORDS)]).assign(n=20)
    starts, ends = np.array([0, 1, 4]), np.array([1, 4, 9])
    found = {(x, y) for xs, ys in lines._near_pairs(lines._Filter(rows, 0.9), starts, ends) for x, y in zip(xs.tolist(), ys.tolist(), strict=True)}
    assert found == {(x, y) for s, e in ((1, 4), (4, 9)) for x in range(s, e) for y in range(x + 1, e)}


def test_windows_give_all_near_pairs_and_tell_dense_groups():
    draw = np.random.default_rng(6)
    signs = draw.integers(-(2**63), 2**63 - 1, (150, lines.WORDS))[np.concatenate([draw.integers(0, 150, 200), np.zeros(100, np.int64)])]
    group = np.concatenate([np.sort(draw.integers(0, 5, 200)), np.full(100, 5)])
    rows = pd.DataFrame(signs, columns=[f"s{k}" for k in range(lines.WORDS)]).assign(n=draw.integers(10, 40, 300), group=group)
    rows.loc[group == 5, "n"] = 20
    rows = rows.sort_values(["group", "n"], ignore_index=True)
    pairs, group, n = lines._Filter(rows, 0.9), rows["group"].to_numpy(), rows["n"].to_numpy()
    starts, ends = np.searchsorted(group, np.arange(6)), np.searchsorted(group, np.arange(6), side="right")
    u, v, dense = lines._in_windows(pairs, starts, ends, np.floor(n / 0.9 + 1e-9))
    assert dense.tolist() == [False] * 5 + [True]
    x, y = np.triu_indices(200, 1)
    kept = (group[x] == group[y]) & pairs.near(x, y)
    assert set(zip(u.tolist(), v.tolist(), strict=True)) == set(zip(x[kept].tolist(), y[kept].tolist(), strict=True)) and kept.any()


def test_the_first_filter_rejects_no_pair_that_lengths_allow():
    for share in (0.3, 0.5, 0.8, 0.9):
        sizes = np.arange(1, 200)
        rows = pd.DataFrame(0, index=range(len(sizes)), columns=[f"s{k}" for k in range(lines.WORDS)]).assign(n=sizes)
        pairs = lines._Filter(rows, share)
        a, b = np.meshgrid(sizes, sizes)
        most = a + b - 2 * np.ceil(share * np.maximum(a, b) - 1e-9)
        allowed = np.minimum(np.where(most >= np.abs(a - b), most, 0), 64)
        assert np.all(pairs.most[a - 1] >= allowed) and np.all(pairs.most[b - 1] >= allowed)


def test_keys_of_many_lines_are_met_in_parts(spark, monkeypatch):
    said = [" ".join(["common", *(f"w{k % 90 + j}" for j in range(12))]) for k in range(300)]
    said += [line.replace("common", f"x{k}") for k, line in enumerate(said)]
    df = spark.createDataFrame(list(enumerate(said)), "doc_id bigint, text string")
    whole = {(r.id, r.line) for r in lines.repeated_lines(df).collect()}
    monkeypatch.setattr(lines, "BLOCK", 5)
    monkeypatch.setattr(lines, "EVERY", 1)
    assert {(r.id, r.line) for r in lines.repeated_lines(df).collect()} == whole and whole


def test_a_forest_of_pairs_connects_as_they_do():
    draw = np.random.default_rng(7)
    u, v = draw.integers(100, 160, (2, 90))
    a, b = lines._forest(u, v)
    whole, part = lines._Forest(160), lines._Forest(160)
    for x, y in zip(u.tolist(), v.tolist(), strict=True):
        whole.join(x, y)
    assert all(part.join(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True))
    assert [whole.root(x) for x in range(160)] == [part.root(x) for x in range(160)]
    assert [len(x) for x in lines._forest(u[:0], v[:0])] == [0, 0]
