"""Approximate nearest neighbours by inner product, with a forest of hash prefixes.

Each tree gives every vector a long string of bits: on which side of random
planes it lies. Vectors under a small angle share long prefixes. To make the
largest inner product the smallest angle, vectors of about the same length are
put on one shelf and get one more component that brings all of them to the
shelf's greatest length; queries have 0 there.

A tree is a sorted array of strings, kept in parts by their first bits; large
parts are dealt to blocks. A query descends to its longest prefix by binary
search, which also tells how many strings share each shorter one. Then all trees
ascend together: the longest prefix length at which they hold enough candidates
between them is the query's level, one for all trees. Every string that shares
so long a prefix in any tree is a candidate, and none is left out. Candidates are
measured where they lie, and only the best of each part leave it. A query whose
parts hold too few is compared with all vectors of the shelf, in blocks.

Equal vectors are one entry with the smallest of its ids.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, hinted, ship, written

TREES, BITS, SEED = 32, 32, 12
#: Candidates, of all trees together, that a query wants among n vectors: FACTOR * n ** POWER
FACTOR, POWER = 5.0, 0.8
#: Vectors and queries of a block
ROWS, ASKS = 16_384, 1_024


def usable(vectors: DataFrame, id: str, vector: str) -> DataFrame:
    """(id, v, norm2): each id once, with the least of its vectors; without those that take no part."""
    kind = "float" if vectors.schema[vector].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col(f"`{id}`").cast("bigint").alias("id"), F.col(f"`{vector}`").cast(f"array<{kind}>").alias("v"))
    finite = F.forall("v", lambda e: F.coalesce(~F.isnan(e) & (F.abs(e) < float("inf")), F.lit(False)))
    square = F.aggregate("v", F.lit(0.0), lambda s, e: s + e.cast("double") * e.cast("double"))
    rows = rows.where(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False))).withColumn("norm2", square)
    rows = rows.where((F.col("norm2") > 0) & (F.col("norm2") < float("inf")))
    return rows.groupBy("id").agg(F.min_by(F.struct("v", "norm2"), "v").alias("r")).select("id", "r.v", "r.norm2")


def planes(dims: int, trees: int, bits: int, seed: int = SEED) -> np.ndarray:
    """(dims + 1, trees * bits) normal components; the last row is for the component that makes lengths equal."""
    return np.random.default_rng([seed, dims]).normal(size=(dims + 1, trees * bits))


def strings(sides: np.ndarray, trees: int, bits: int) -> np.ndarray:
    """The bits of each tree as one number, the first bit highest."""
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
    return (sides.reshape(len(sides), trees, bits) @ weights).astype(np.int64)


def _hashed(entries: DataFrame, lengths: dict[int, float], trees: int, bits: int) -> DataFrame:
    """The entries with their strings as an entry and, if they ask, as a query."""

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            column = batch.column("v")
            flat, sizes = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64), np.diff(column.offsets.to_numpy())
            starts = np.cumsum(sizes) - sizes
            shelf, norm2 = batch.column("shelf").to_numpy(zero_copy_only=False), batch.column("norm2").to_numpy(zero_copy_only=False)
            as_entry, as_query = (np.empty((batch.num_rows, trees), np.int64) for _ in range(2))
            for d in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == d)
                v, p = flat[starts[at][:, None] + np.arange(d)], planes(d, trees, bits)
                for s in range(0, len(at), 2000):
                    part = at[s : s + 2000]
                    shadow = v[s : s + 2000] @ p[:-1]
                    missing = np.sqrt(np.maximum(np.array([lengths[x] for x in shelf[part].tolist()]) - norm2[part], 0))
                    as_query[part] = strings(shadow > 0, trees, bits)
                    as_entry[part] = strings(shadow + missing[:, None] * p[-1] > 0, trees, bits)
            lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, trees), pa.int32()), pa.array(x.ravel())) for x in (as_entry, as_query)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *lists], names=[*batch.schema.names, "as_entry", "as_query"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in entries.schema)
    return entries.mapInArrow(go, f"{fields}, as_entry array<bigint>, as_query array<bigint>")


def _dealt(entries: DataFrame, queries: DataFrame, rows: int, asks: int, keep: list[str]) -> DataFrame:
    """Entries and queries of the same (shelf, tree, cell), every block of one with every block of the other."""
    part = ["shelf", "tree", "cell"]
    n = entries.groupBy(*part).agg(F.ceil(F.count("*") / rows).cast("int").alias("blocks"))
    m = queries.groupBy(*part).agg(F.ceil(F.count("*") / asks).cast("int").alias("turns"))
    cells = hinted(written(n.join(m, part), "forest-cells"))
    a, b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"), F.pmod(F.xxhash64("node"), F.col("turns")).cast("int")
    rows_ = entries.join(cells, part).select(*part, a.alias("a"), F.explode_outer(F.sequence(F.lit(0), F.col("turns") - 1)).alias("b"), F.lit(False).alias("asks"), *keep)
    asked = queries.join(cells, part).select(*part, F.explode_outer(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("a"), b.alias("b"), F.lit(True).alias("asks"), *keep)
    return rows_.unionByName(asked)


def _column(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False) if table.num_rows else np.zeros(0)


def _count(bits: int):
    """How many strings of the part share each prefix length with each query."""

    def go(table: pa.Table) -> pa.Table:
        asks, code, node = (_column(table, c) for c in ("asks", "code", "node"))
        asks = asks.astype(bool)
        array, wanted = np.sort(code[~asks]), code[asks]
        out = {"shelf": pa.array(_column(table, "shelf")[asks], pa.int64()), "node": pa.array(node[asks], pa.int64())}
        for length in range(bits + 1):
            drop = bits - length
            lower = (wanted >> drop) << drop
            out[f"n{length}"] = pa.array(np.searchsorted(array, lower + (1 << drop)) - np.searchsorted(array, lower), pa.int64())
        return pa.table(out)

    return go


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products in double precision, added from the first component on."""
    total = np.zeros(len(vectors))
    for d in range(vectors.shape[1]):
        total += vectors[:, d] * query[..., d]
    return total


def _best(bits: int, k: int):
    """The k best candidates of the part for each query: those that share its level's prefix."""

    def go(table: pa.Table) -> pa.Table:
        asks, code, node, level = (_column(table, c) for c in ("asks", "code", "node", "level"))
        asks = asks.astype(bool)
        v = table.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(asks), -1)
        order = np.argsort(code[~asks], kind="stable")
        array, rows, names = code[~asks][order], v[~asks][order], node[~asks][order]
        drop = bits - level[asks].astype(np.int64)
        lower = (code[asks] >> drop) << drop
        lo, hi = np.searchsorted(array, lower), np.searchsorted(array, lower + (np.int64(1) << drop))
        who, mine = node[asks], v[asks]
        span = lo * (len(array) + 1) + hi
        found = []
        for s in np.unique(span).tolist():
            begin, end = divmod(s, len(array) + 1)
            at = np.flatnonzero(span == s)
            if begin == end:
                continue
            near = mine[at] @ rows[begin:end].T
            keep = np.ones(near.shape, bool)
            if end - begin > k:  # what may be among the k best, whichever way the sums were rounded
                slack = 1e-12 * np.sqrt((mine[at] ** 2).sum(1) * (rows[begin:end] ** 2).sum(1).max())
                keep = near >= (-np.partition(-near, k - 1, axis=1)[:, k - 1] - slack)[:, None]
            q, c = np.nonzero(keep)
            exact = scores(rows[begin + c], mine[at[q]])
            rank = np.lexsort((names[begin + c], -exact, q))
            q, c, exact = q[rank], c[rank], exact[rank]
            first = np.searchsorted(q, np.arange(len(at)))
            kept = np.arange(len(q)) - first[q] < k
            found.append((who[at[q[kept]]], names[begin + c[kept]], exact[kept]))
        whole = [np.concatenate(x) if found else np.zeros(0) for x in (zip(*found, strict=True) if found else ((), (), ()))]
        return pa.table({"query": pa.array(whole[0], pa.int64()), "node": pa.array(whole[1], pa.int64()), "score": pa.array(whole[2], pa.float64())})

    return go


def _first(rows: DataFrame, by: str, n: int, name: str = "node") -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(by).orderBy(F.desc("score"), name))
    return rows.withColumn("rank", rank).where(F.col("rank") <= n)


def nearest(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", k: int = 20, asks: Column | None = None,
    trees: int = TREES, bits: int = BITS, factor: float = FACTOR, power: float = POWER, rows: int = ROWS, block: int = ASKS,
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each query the ``k`` nearest vectors found, but its own.

    Queries are the vectors whose id, as column ``id``, meets ``asks`` (by
    default those divisible by 20). Nearest first, of equal scores the smaller
    id. Rows that repeat an id count once, with the least of their vectors; rows
    with a NULL id, and vectors that are NULL, zero or not finite, take no part.
    Vectors of other lengths than the query's are no candidates. A query without
    candidates has no rows. Other columns are ignored.
    """
    ship(vectors.sparkSession)
    asks = F.col("id") % 20 == 0 if asks is None else asks
    known = written(usable(vectors, id, vector).withColumn("asks", F.coalesce(asks, F.lit(False))), "forest-vectors")
    same = known.groupBy("v").agg(F.min("id").alias("node"), F.max("asks").alias("asks"), F.first("norm2").alias("norm2"), F.count("*").alias("n"))
    # a shelf holds vectors of one number of components and, to a factor of two, of one length
    stretch = F.round(F.log2("norm2") / 2).cast("bigint")
    entries = written(same.withColumn("shelf", F.size("v").cast("bigint") * 4096 + stretch), "forest-entries")
    copies = written(known.join(entries.where("n > 1").select("v", "node"), "v").select("id", "asks", "node"), "forest-copies")

    shelves = {r.shelf: r for r in entries.groupBy("shelf").agg(F.count("*").alias("n"), F.max("norm2").alias("top")).collect()}
    hashed = written(_hashed(entries.drop("n"), {s: r.top for s, r in shelves.items()}, trees, bits), "forest-strings")
    if not shelves:
        return hashed.select(F.col("node").alias("query_id"), F.lit(0).alias("rank"), F.col("node").alias("vec_id"), F.lit(0.0).alias("score"))
    wanted = {s: factor * r.n**power for s, r in shelves.items()}
    # parts are so large that a query rarely wants more than its own hold
    cut = {s: min(bits, max(0, int(math.log2(trees * r.n / (4 * wanted[s]))))) for s, r in shelves.items()}

    def of_shelf(values: dict) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])[F.col("shelf")]

    def parts(strings: str, frame: DataFrame, *columns: str) -> DataFrame:
        each = frame.select("shelf", "node", *columns, F.posexplode_outer(strings).alias("tree", "code"))
        return each.withColumn("cell", F.expr(f"code div {2**bits}") if bits == 0 else F.floor(F.col("code") / F.pow(F.lit(2.0), bits - of_shelf(cut))).cast("bigint"))

    # each query goes to every shelf of its number of components
    shelf_of = {d: [s for s in shelves if (s + 2048) // 4096 == d] for d in {(s + 2048) // 4096 for s in shelves}}
    all_shelves = F.create_map(*[x for d, found in shelf_of.items() for x in (F.lit(d), F.array(*[F.lit(s) for s in found]))])
    asked = hashed.where("asks").select("node", "v", "as_query", F.explode_outer(all_shelves[F.size("v").cast("bigint")]).alias("shelf"))

    dealt = _dealt(parts("as_entry", hashed), parts("as_query", asked), rows, block, ["code", "node"])
    levels = [f"n{x}" for x in range(bits + 1)]
    counted = dealt.groupBy("shelf", "tree", "cell", "a", "b").applyInArrow(_count(bits), "shelf bigint, node bigint, " + ", ".join(f"{x} bigint" for x in levels))
    sums = counted.groupBy("shelf", "node").agg(*[F.sum(x).alias(x) for x in levels])
    # the longest prefix that enough strings share; below the cells' own length nothing is known
    level = F.coalesce(*[F.when((F.col(f"n{x}") >= of_shelf(wanted)) & (of_shelf(cut) <= x), F.lit(x)) for x in range(bits, -1, -1)])
    level = written(sums.select("shelf", "node", level.alias("level")), "forest-levels")

    at = asked.join(level, ["shelf", "node"])
    none = F.lit(None).cast("int")
    keep = ["code", "node", "v", "level"]
    search = _dealt(
        parts("as_entry", hashed, "v").withColumn("level", none), parts("as_query", at.where("level is not null"), "v", "level"), rows, block, keep
    )
    rest = at.where("level is null")
    if rest.limit(1).count():  # too few candidates in their parts: all vectors of the shelf
        lone = [F.lit(-1).alias("tree"), F.lit(0).cast("bigint").alias("code"), F.lit(0).cast("bigint").alias("cell")]
        whole = hashed.join(rest.select("shelf").distinct(), "shelf").select("shelf", "node", "v", none.alias("level"), *lone)
        search = search.unionByName(_dealt(whole, rest.select("shelf", "node", "v", F.lit(0).alias("level"), *lone), rows, block, keep))
    found = search.groupBy("shelf", "tree", "cell", "a", "b").applyInArrow(_best(bits, k + 1), "query bigint, node bigint, score double")
    found = written(found, "forest-found")
    discard(known, entries, level)
    # the best entries of each query's entry, their ids, and then without the query's own
    best = _first(found.groupBy("query", "node").agg(F.max("score").alias("score")), "query", k + 1).drop("rank")
    listed = F.row_number().over(Window.partitionBy("node").orderBy("id"))
    ids = copies.withColumn("at", listed).where(F.col("at") <= k + 1).groupBy("node").agg(F.collect_list("id").alias("ids"))
    named = best.join(ids, "node", "left").select("query", "score", F.explode_outer(F.coalesce("ids", F.array("node"))).alias("vec_id"))
    named = written(_first(named, "query", k + 1, "vec_id").drop("rank"), "forest-best")
    askers = copies.where("asks").select(F.col("id").alias("query_id"), F.col("node").alias("query"))
    single = named.join(copies.select(F.col("node").alias("query")).distinct(), "query", "left_anti").withColumn("query_id", F.col("query"))
    several = named.join(askers, "query")
    both = single.unionByName(several).where("vec_id != query_id")
    return _first(both.select("query_id", "vec_id", "score"), "query_id", k, "vec_id").select("query_id", "rank", "vec_id", "score")
