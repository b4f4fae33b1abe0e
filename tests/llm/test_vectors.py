"""Clustering and neighbour search: against brute force, and every edge with a defined result."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import centroids, neighbours
from lakewarden.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, id string, v string, cluster int, shelf int, asks int, node string"


def made(spark, rows):
    return spark.createDataFrame([(i, v, "x", "y", 1, 2, 3, "z") for i, v in rows], SCHEMA)


def lloyd(v, start, rounds):
    c = [list(map(int, x)) for x in start]
    for _ in range(rounds + 1):
        d = [[sum((int(a) - b) ** 2 for a, b in zip(x, y, strict=True)) for y in c] for x in v]
        own = [row.index(min(row)) for row in d]
        last = c
        c = [[sum(int(x[p]) for x in mine) // len(mine) for p in range(len(old))] if (mine := [x for x, o in zip(v, own, strict=True) if o == n]) else old
             for n, old in enumerate(c)]
    return own, [row[o] for row, o in zip(d, own, strict=True)], last


@pytest.mark.parametrize("spread", [30, 2000, 2**26])
def test_bounds_never_change_the_clusters(spark, spread):
    rng = np.random.default_rng(spread)
    # close clusters, far ones, equal vectors and ties
    v = np.concatenate([rng.normal(c, spread / 40, size=(60, 3)) for c in rng.uniform(-spread, spread, size=(9, 3))]).round().astype(int)
    v = np.concatenate([v, v[:40], np.zeros((5, 3), int)])
    points = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "id bigint, v array<int>")
    start = v[rng.integers(0, len(v), 7)].tolist()
    start[1] = start[0]  # equal centroids: the second stays without vectors
    own, distance, last = lloyd(v, start, 8)
    found = centroids.kmeans(points, start, 8)
    rows = sorted(map(tuple, found.assigned.collect()))
    assert rows == [(i, o, d) for i, (o, d) in enumerate(zip(own, distance, strict=True))]
    assert found.centroids == last
    assert found.scanned[0] == len(v) and min(found.scanned) < len(v)


def test_a_ball_behind_the_move_loosens_nothing():
    old, new = np.array([[0, 0], [100, 0]]), np.array([[0, 0], [110, 0]])
    # the second centroid leaves the first one's ball: no point there has it nearer
    assert centroids.approach(old, new, np.array([10.0, 10.0]))[0] < 1e-6
    # it comes towards it: all of the way
    assert 9.9 < centroids.approach(old, np.array([[0, 0], [90, 0]]), np.array([10.0, 10.0]))[0] < 10.1
    # it moves aside: part of it
    assert 0 < centroids.approach(old, np.array([[0, 0], [100, 10]]), np.array([10.0, 10.0]))[0] < 5


def test_what_comes_nearer_is_bounded():
    rng = np.random.default_rng(5)
    for _ in range(200):
        old, new, radius = rng.normal(size=(4, 5)) * 50, rng.normal(size=(4, 5)) * 50, rng.uniform(0, 60, 4)
        old, new = old.round(), (old + (new - old) * rng.uniform(0, 0.6)).round()
        bound = centroids.approach(old, new, radius)
        for i in range(4):
            x = rng.normal(size=(300, 5))
            x = old[i] + x / np.linalg.norm(x, axis=1, keepdims=True) * radius[i] * rng.uniform(0, 1, (300, 1)) ** 0.2
            for j in set(range(4)) - {i}:
                nearer = np.linalg.norm(x - old[j], axis=1) - np.linalg.norm(x - new[j], axis=1)
                assert nearer.max() <= bound[i] * (1 + 1e-9) + 1e-9


def test_clustering_edges(spark):
    good = [1.0, -2.0, 0.5]
    rows = [(1, good), (1, good), (2, [0.0, 0.0, 0.0]), (None, [5.0, 5.0, 5.0]), (3, None), (4, []), (5, [1.0, None, 2.0]),
            (6, [float("nan"), 0.0, 0.0]), (7, [float("inf"), 0.0, 0.0]), (8, [1.0, 2.0]), (9, [1e30, 0.0, 0.0]), (10, [-0.0004, 0.0, 0.0])]
    found = centroids.cluster_vectors(made(spark, rows), dims=3, k=3)
    got = [tuple(r) for r in found.assigned.collect()]
    assert sorted((r[0] for r in got), key=str) == [1, 1, 10, 2, None]
    assert len(found.centroids) == 3 and [-1, 0, 0] in found.centroids + [[-1, 0, 0]]
    assert len(centroids.cluster_vectors(made(spark, rows[:1]), dims=3).centroids) == 1
    empty = centroids.cluster_vectors(made(spark, []), dims=3)
    assert empty.centroids == [] and empty.assigned.columns == ["id", "cluster", "distance"] and empty.assigned.count() == 0
    small = centroids.whole_numbers(made(spark, [(1, [-0.0004, 0.9999, 1.0])]), "vec_id", "embedding", 3, 1024).first()
    assert small.v == [-1, 1023, 1024]


def brute(rows, k=20, every=20):
    kept = {}
    for i, v in rows:
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            kept[i] = min(kept.get(i, v), v)
    out = {}
    for q, a in kept.items():
        if q % every == 0:
            near = [(-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in kept.items() if i != q and len(a) == len(b)]
            out[q] = [(i, -s) for s, i in sorted(near)[:k]]
    return out


def answers(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: r["rank"]):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def test_neighbours_recall_on_the_tables(spark, small):
    for folder in ("sf0.001", "sf0.1"):
        directory = small.replace("sf0.001", folder)
        rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{directory}/embeddings.parquet").collect()]
        ids, v = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
        found = answers(QUERIES["op12_neighbours"](spark, directory))
        asked = np.flatnonzero(ids % 20 == 0)
        assert found.keys() == set(ids[asked].tolist()) and all(len(f) == 20 for f in found.values())
        scores = v[asked] @ v.T
        scores[np.arange(len(asked)), asked] = -np.inf
        best = {int(ids[q]): set(ids[np.argsort(-s, kind="stable")[:20]].tolist()) for q, s in zip(asked, scores, strict=True)}
        assert np.mean([len(best[q] & {i for i, _ in f}) / 20 for q, f in found.items()]) >= 0.93
        at = {int(i): n for n, i in enumerate(ids)}
        for q, f in found.items():
            assert all(abs(s - v[at[q]] @ v[at[i]]) < 1e-12 for i, s in f)
            assert f == sorted(f, key=lambda x: (-x[1], x[0])) and q not in {i for i, _ in f}


def test_neighbours_in_small_blocks_are_the_same(spark, small):
    df = spark.read.parquet(f"{small}/embeddings.parquet").limit(300)
    whole = answers(neighbours.nearest(df))
    assert answers(neighbours.nearest(df, rows=17, block=3)) == whole
    # parts too small for what is wanted: all of the shelf is looked at
    exact = answers(neighbours.nearest(df, factor=50.0))
    assert exact.keys() == whole.keys()
    assert exact == {q: [(i, pytest.approx(s)) for i, s in f] for q, f in brute([(r.vec_id, r.embedding) for r in df.collect()]).items()}


def test_neighbours_of_copies_lengths_and_odd_rows(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 4)).astype(np.float32).tolist()
    rows = [(i, v[i]) for i in range(40)]
    rows += [(i, v[0]) for i in range(100, 190)]  # a large group of copies, some of them queries
    rows += [(i, [8.0 * x for x in v[i % 40]]) for i in range(200, 230)]  # much longer vectors
    rows += [(300, [1.0, 0.0]), (301, [0.5, 0.5]), (320, [1.0, 1.0, 1.0])]  # other numbers of components
    rows += [(400, None), (420, []), (440, [0.0] * 4), (460, [float("nan")] * 4), (480, [float("inf"), 0.0, 0.0, 0.0]), (500, [1.0, None, 0.0, 0.0]), (None, v[0])]
    rows += [(20, v[20]), (20, [9.0, 9.0, 9.0, 9.0])]  # a repeated row, and an id with two vectors
    found = answers(neighbours.nearest(made(spark, rows), factor=50.0))
    expected = {q: f for q, f in brute(rows).items() if f}
    assert {q: [i for i, _ in f] for q, f in found.items()} == {q: [i for i, _ in f] for q, f in expected.items()}
    assert 320 not in found and found[300][0][0] == 301 and 440 not in found
    few = made(spark, rows[:3])
    assert {q: len(f) for q, f in answers(neighbours.nearest(few)).items()} == {0: 2}
    assert neighbours.nearest(made(spark, [])).count() == 0
    assert neighbours.nearest(made(spark, rows), asks=F.lit(None).cast("boolean")).count() == 0
