"""Exact k-means over whole-numbered vectors, with lower bounds that loosen less than the centroids drift.

Lloyd's rounds, but most vectors are not compared with all centroids. Each keeps
an upper bound of the distance to its own centroid and a lower bound of that to
any other. When centroids move, the usual lower bound falls by the largest
drift. Here each cluster's vectors lie in a ball around its old centroid, of the
largest upper bound as radius, and the bound falls by what any other centroid
can have come nearer to a point of that ball.

That is a question of plane geometry. Let a centroid move by p from a to b, and
M be the middle. For any point x, |x - a| - |x - b| is at most p times the cosine
of the angle at M between x and b: |x - a| + |x - b| is at least 2 |x - M|, and
the squares differ by 2 p |x - M| cos. Seen from M, a ball with its centre at
distance D under the angle alpha fills the angles from alpha - beta on, where
sin beta = radius / D. So the bound is p cos(alpha - beta): all of p if the ball
reaches the ray or holds M, nothing if it lies behind the plane through M.

A vector whose upper bound is below its lower bound, or below half the distance
from its centroid to the next, keeps its centroid. The others are ambiguous: they
are measured exactly, first against their own centroid and then against all.
Distances are whole numbers, and bounds are padded by more than doubles err, so
the clusters are those of Lloyd's rounds.

Each round is one pass without a shuffle: it reads the vectors with their bounds,
writes them with new ones, and adds a row of sums per task and cluster. Only the
sums, one row per cluster and component, come to the driver.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, ship, written

#: Components beyond it have squared distances that no long holds
LARGEST = 2**27
#: How much bounds are widened, far more than doubles err in them
PAD = 1e-9

STATE = "id bigint, v array<int>, cluster int, upper double, lower double, n bigint, sums array<bigint>, radius double, scanned bigint"


class Clustering(NamedTuple):
    """``assigned``: (id, cluster, distance), written; ``centroids`` by number; vectors compared with all of them, by round."""

    assigned: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def whole_numbers(vectors: DataFrame, id: str, vector: str, dims: int, scale: int) -> DataFrame:
    """(id, v): the usable vectors, each component as floor(scale * x)."""
    x = F.col("x")
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast("array<double>").alias("x"))
    usable = F.when(
        F.size(x) == dims, F.forall(x, lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) <= LARGEST / scale), F.lit(False)))
    ).otherwise(False)
    return rows.where(usable).select("id", F.transform(x, lambda e: F.floor(e * scale).cast("int")).alias("v"))


def squared(v: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances of whole-numbered vectors (n, d) to centroids (k, d)."""
    top = max(int(np.abs(v).max(initial=0)), int(np.abs(centroids).max(initial=0)))
    if 4 * v.shape[1] * top * top < 2**53:  # every partial sum is a whole number that a double holds
        a, c = v.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] + (c * c).sum(1)[None] - 2 * (a @ c.T)).astype(np.int64)
    a = v.astype(np.int64)
    return np.stack([((a - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def approach(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """For each cluster, by how much any other centroid can have come nearer to a point of the cluster's ball."""
    a, b = old.astype(np.float64), new.astype(np.float64)
    step = b - a
    drift = np.sqrt((step * step).sum(1))
    seen = a[:, None, :] - (a + step / 2)[None]  # from the middle of each step to each ball's centre
    far = np.sqrt((seen * seen).sum(2))
    with np.errstate(divide="ignore", invalid="ignore"):
        cosine = np.clip((seen * step[None]).sum(2) / (far * drift[None]), -1, 1)
        half_width = np.arcsin(np.clip(radius[:, None] / far, 0, 1))
        angle = np.maximum(np.arccos(cosine) - half_width, 0)
    nearer = drift[None] * np.maximum(np.cos(angle), 0)
    nearer = np.where((far <= radius[:, None] * (1 + PAD)) | ~np.isfinite(nearer), drift[None], nearer)
    nearer = np.minimum(nearer + drift[None] * PAD, drift[None] * (1 + PAD))
    np.fill_diagonal(nearer, 0)
    return nearer.max(axis=1, initial=0)


class _Round(NamedTuple):
    """What a pass needs to know: the centroids and, after the first, how far they came."""

    centroids: np.ndarray
    drift: np.ndarray | None
    nearer: np.ndarray | None
    half: np.ndarray

    def assign(self, v: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """Cluster, bounds, and how many vectors were compared with all centroids."""
        if self.drift is None:
            unsure = np.arange(len(v))
            cluster, upper, lower = np.zeros(len(v), np.int32), np.zeros(len(v)), np.zeros(len(v))
        else:
            upper = (upper + self.drift[cluster]) * (1 + PAD)
            lower = np.maximum(lower - self.nearer[cluster], 0) * (1 - PAD)
            safe = np.maximum(lower, self.half[cluster])
            unsure = np.flatnonzero(upper >= safe)
            own = ((v[unsure].astype(np.int64) - self.centroids[cluster[unsure]]) ** 2).sum(1)
            upper[unsure] = np.sqrt(own.astype(np.float64)) * (1 + PAD)
            unsure = unsure[upper[unsure] >= safe[unsure]]
        if len(unsure):
            distances = squared(v[unsure], self.centroids)
            best = distances.argmin(axis=1)  # of equal ones the first
            row = np.arange(len(unsure))
            cluster[unsure] = best
            upper[unsure] = np.sqrt(distances[row, best].astype(np.float64)) * (1 + PAD)
            rest = distances.astype(np.float64)
            rest[row, best] = np.inf
            lower[unsure] = np.sqrt(rest.min(axis=1)) * (1 - PAD)
        return cluster, upper, lower, len(unsure)


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _pass(rows: DataFrame, now: _Round, dims: int) -> DataFrame:
    """The vectors with their new clusters and bounds, and rows of sums per task and cluster."""
    schema = pa.schema([
        ("id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("upper", pa.float64()), ("lower", pa.float64()),
        ("n", pa.int64()), ("sums", pa.list_(pa.int64())), ("radius", pa.float64()), ("scanned", pa.int64()),
    ])

    def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(now.centroids)
        n, sums, radius, scanned = np.zeros(k, np.int64), np.zeros((k, dims), np.int64), np.zeros(k), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dims)
            held = [batch.column(c).to_numpy(zero_copy_only=False).copy() if now.drift is not None else None for c in ("cluster", "upper", "lower")]
            cluster, upper, lower, some = now.assign(v, *held)
            scanned += some
            for c in np.unique(cluster):
                mine = cluster == c
                n[c] += mine.sum()
                sums[c] += v[mine].sum(axis=0, dtype=np.int64)
                radius[c] = max(radius[c], upper[mine].max())
            none = {f.name: pa.nulls(len(v), f.type) for f in schema}
            yield pa.RecordBatch.from_pydict(
                none | {"id": batch.column("id"), "v": batch.column("v"), "cluster": pa.array(cluster, pa.int32()), "upper": pa.array(upper), "lower": pa.array(lower)},
                schema,
            )
        held = np.flatnonzero(n)
        if len(held):
            none = {f.name: pa.nulls(len(held), f.type) for f in schema}
            yield pa.RecordBatch.from_pydict(
                none | {"cluster": pa.array(held, pa.int32()), "n": pa.array(n[held]), "sums": pa.array(list(sums[held]), schema.field("sums").type),
                        "radius": pa.array(radius[held]), "scanned": pa.array([scanned] + [0] * (len(held) - 1), pa.int64())},
                schema,
            )

    return rows.mapInArrow(go, STATE)


def _totals(state: DataFrame, k: int, dims: int) -> tuple[list[int], list[list[int]], np.ndarray, int]:
    """Per cluster the number of vectors, component sums and radius; vectors compared with all centroids."""
    parts = state.where("n is not null")
    each = parts.groupBy("cluster").agg(F.sum("n").alias("n"), F.max("radius").alias("radius"), F.sum("scanned").alias("scanned"))
    n, radius, scanned = [0] * k, np.zeros(k), 0
    for row in each.collect():  # a row per cluster
        n[row.cluster], radius[row.cluster], scanned = row.n, row.radius, scanned + row.scanned
    sums = [[0] * dims for _ in range(k)]
    components = parts.select("cluster", F.posexplode_outer("sums").alias("place", "part")).groupBy("cluster", "place").agg(F.sum("part").alias("total"))
    for row in components.collect():  # a row per cluster and component
        sums[row.cluster][row.place] = row.total
    return n, sums, radius, scanned


def _half_gaps(centroids: np.ndarray) -> np.ndarray:
    """Half the distance from each centroid to the next one."""
    gaps = squared(centroids, centroids).astype(np.float64)
    np.fill_diagonal(gaps, np.inf)
    return np.sqrt(gaps.min(axis=1)) / 2 * (1 - PAD)


def kmeans(points: DataFrame, start: list[list[int]], rounds: int) -> Clustering:
    """Lloyd's rounds over ``points`` (id, v) from the given centroids, then one more assignment.

    Every vector goes to the nearest centroid, of equally near ones to the
    smaller number. Then each centroid becomes floor(sum / count) of its
    vectors, componentwise; one without vectors stays. Equal vectors and equal
    centroids are no special case. ``points`` must be readable many times alike.
    """
    spark = points.sparkSession
    ship(spark)
    k, dims = len(start), len(start[0]) if start else 0
    if not k:
        return Clustering(points.select("id", F.lit(0).alias("cluster"), F.lit(0).cast("bigint").alias("distance")).where("false"), [], [])
    centroids = np.array(start, np.int64)
    state, drift, nearer, scanned = points, None, None, []
    for _ in range(rounds):
        source = state if drift is None else state.where("upper is not null")
        after = written(_pass(source, _Round(centroids, drift, nearer, _half_gaps(centroids)), dims), "centroid-rounds")
        if drift is not None:
            discard(state)
        state = after
        n, sums, radius, some = _totals(state, k, dims)
        scanned.append(some)
        moved = np.array([[s // m for s in total] if m else old for m, total, old in zip(n, sums, centroids.tolist(), strict=True)], np.int64)
        nearer = approach(centroids, moved, radius)
        step = (moved - centroids).astype(np.float64)
        drift = np.sqrt((step * step).sum(1)) * (1 + PAD)
        centroids = moved
        if not drift.any():  # no later round would change anything
            break
    last = _Round(centroids, drift, nearer, _half_gaps(centroids))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            v = _matrix(batch.column("v"), dims)
            held = [batch.column(c).to_numpy(zero_copy_only=False).copy() if last.drift is not None else None for c in ("cluster", "upper", "lower")]
            cluster = last.assign(v, *held)[0]
            distance = ((v.astype(np.int64) - last.centroids[cluster]) ** 2).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(cluster, pa.int32()), pa.array(distance)], names=["id", "cluster", "distance"])

    source = state if drift is None else state.where("upper is not null")
    assigned = written(source.mapInArrow(finish, "id bigint, cluster int, distance bigint"), "centroid-clusters")
    if drift is not None:
        discard(state)
    return Clustering(assigned, centroids.tolist(), scanned)


def cluster_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", dims: int = 64, scale: int = 1024, k: int = 8,
    rounds: int = 10, start_by: Callable[[Column], Column] = lambda id: F.sha2(F.concat(F.lit("3:"), id.cast("string")), 256),
) -> Clustering:
    """Clusters of the vectors with exactly ``dims`` components, each taken as floor(scale * x).

    Centroids start as the ``k`` vectors least by ``start_by`` of their id; of
    fewer vectors, all of them. Vectors that are NULL, of another length, hold
    NULL or non-finite components, or are so large that squared distances fit no
    long, take no part. Rows that repeat an id count each; a NULL id starts no
    centroid before all others. Of an empty table there are no clusters. Other
    columns are ignored.
    """
    points = written(whole_numbers(vectors, id, vector, dims, scale), "centroid-vectors")
    first = points.orderBy(start_by(F.col("id")).asc_nulls_last(), "id", "v").limit(k).collect()
    return kmeans(points, [list(r.v) for r in first], rounds)
