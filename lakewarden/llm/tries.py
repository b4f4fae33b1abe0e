"""The prefix trie of conversations, by collapsing whole sequences.

A node is a distinct sequence of first turns. No trie is walked or kept: each
turn becomes two 64-bit hashes, each prefix the exclusive or of its turns' hashes
mixed with their places, so a prefix's name comes from a running aggregate.

Conversations with the same turns collapse into one sequence with a weight, its
least conversation and the list of those that end there. Sequences that are a
proper prefix of another one are dropped by an anti-join; the others are the
leaves. All counts of a node are sums over the prefixes of distinct sequences, so
a third of all conversations being copies costs one sequence.

A sum over a subtree must count each node below once. A node belongs to the least
leaf below it; along a leaf's sequence the nodes it owns are the last ones, and
their running sum from the end, added up over the leaves below a node, is the
subtree's. So the rows are as many as the distinct sequences have turns.

Running aggregates are taken over sorted ranges, not per conversation: one
conversation may hold a third of all turns. What a range inherits from those
before it is one row per range.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, discard, ship, words_by, written

NAME = ["depth", "p1", "p2"]
#: Characters of listed ids that go into one row
LISTED = 1_000_000


def running(rows: DataFrame, by: str, order: list[str], totals: dict[str, tuple[Callable[[str], Column], str, Callable[[Column, Column], Column]]]) -> DataFrame:
    """``rows`` with, for each total, its aggregate over the rows of the same key up to and with each row.

    A total is (aggregate, column, how two parts combine). Rows are dealt by
    ranges of key and order, so rows of one key may lie in many ranges; only a
    range's first key can go on from the one before, so what it takes over is
    one row per range and is broadcast.
    """
    spark = rows.sparkSession
    ranges = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # equal rows may take any order, but they must not all meet in one range
    dealt = rows.withColumn("place", F.monotonically_increasing_id()).repartitionByRange(ranges, by, *order, "place")
    dealt = written(dealt.withColumn("range", F.spark_partition_id()), "trie-ranges")
    each = dealt.groupBy(by, "range").agg(*[f(c).alias(name) for name, (f, c, _) in totals.items()])
    earlier = Window.partitionBy(by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select(by, "range", *[f(name).over(earlier).alias(f"{name}_before") for name, (f, _, _) in totals.items()])
    before = before.where(" or ".join(f"{name}_before is not null" for name in totals))
    here = Window.partitionBy(by, "range").orderBy(*order, "place").rowsBetween(Window.unboundedPreceding, 0)
    local = dealt.select("*", *[f(c).over(here).alias(name) for name, (f, c, _) in totals.items()])
    joined = local.join(F.broadcast(before), [by, "range"], "left")
    whole = [
        F.when(F.col(f"{name}_before").isNull(), F.col(name)).otherwise(add(F.col(f"{name}_before"), F.col(name))).alias(name)
        for name, (_, _, add) in totals.items()
    ]
    out = written(joined.select(*rows.columns, *whole), "trie-running")
    discard(dealt)
    return out


_XOR = (F.bit_xor, lambda a, b: a.bitwiseXOR(b))


def turns_of(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, rank, h1, h2, words), written: each turn's number from 1 and what stands for its role and text.

    A NULL turn comes first, of equal turns the order is by a hash of role and
    text. NULL roles and texts are empty. Rows that repeat count each, rows with
    a NULL conversation do not.
    """
    said = [F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")) for c in (role, text)]
    rows = conversations.select(
        F.col(f"`{conv}`").cast("bigint").alias("conv"), F.col(f"`{turn}`").alias("turn"),
        F.xxhash64(*said).alias("h1"), F.xxhash64(F.lit("second"), said[1], said[0]).alias("h2"),
        _n_words(said[1]).alias("words"),
    ).where("conv is not null")
    rows = written(rows.withColumn("one", F.lit(1).cast("bigint")), "trie-turns")
    ranked = running(rows, "conv", ["turn", "h1", "h2"], {"rank": (F.sum, "one", lambda a, b: a + b)})
    discard(rows)
    return ranked.select("conv", "rank", "h1", "h2", "words")


def _n_words(text: Column) -> Column:
    return F.size(words_by(text, SPACES)).cast("bigint")


def rebuilt(turns: DataFrame, every: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin as their neighbour does: (conv, place, h1, h2, words) and (conv) of all, turnless ones included.

    Conversation c takes the first h turns of c - c % ``every``, all if it has
    fewer and none if there is none, and its own after its first h; h is the
    CRC-32 of c in decimals, modulo ``most``.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % most
    convs = turns.select("conv").distinct().select("conv", (F.col("conv") - F.col("conv") % every).alias("base"), h.alias("h"))
    heads = turns.where((F.col("rank") < most) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    lengths = heads.groupBy("base").agg(F.max("rank").alias("has"))
    convs = written(convs.join(lengths, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))), "trie-convs")
    taken = convs.join(heads, "base").where("rank <= h").select("conv", F.col("rank").alias("place"), "h1", "h2", "words")
    own = turns.withColumn("h", h).where("rank > h").drop("h").join(convs.select("conv", "h", "taken"), "conv")
    own = own.select("conv", (F.col("taken") + F.col("rank") - F.col("h")).alias("place"), "h1", "h2", "words")
    return taken.unionByName(own), convs.select("conv")


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(name, ends_sha256) of each name's conversations, in order, joined by commas.

    A list may be long: ranges of it are joined to texts of bounded size, and
    the texts go through the digest one after the other. No task holds a list.
    """
    ranges = int(ends.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "depth bigint, p1 bigint, p2 bigint, first bigint, listed string"

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, first, listed, size = None, None, [], 0

        def row():
            return pa.RecordBatch.from_arrays(
                [*[pa.array([x], pa.int64()) for x in (*name, first)], pa.array([",".join(listed)])], names=[*NAME, "first", "listed"]
            )

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (*NAME, "conv")]
            for *new, conv in zip(*columns, strict=True):
                if listed and (new != name or size >= LISTED):
                    yield row()
                    listed = []
                if not listed:
                    name, first, size = new, conv, 0
                listed.append(str(conv))
                size += len(listed[-1]) + 1
        if listed:
            yield row()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, state = None, None

        def rows(found):
            names = [pa.array([n[k] for n, _ in found], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*names, pa.array([d for _, d in found], pa.string())], names=[*NAME, "ends_sha256"])

        for batch in batches:
            found = []
            for *new, listed in zip(*[batch.column(c).to_pylist() for c in (*NAME, "listed")], strict=True):
                if new != name:
                    if name is not None:
                        found.append((name, state.hexdigest()))
                    name, state = new, hashlib.sha256()
                else:
                    state.update(b",")
                state.update(listed.encode())
            yield rows(found)
        if name is not None:
            yield rows([(name, state.hexdigest())])

    dealt = ends.select(*NAME, "conv").repartitionByRange(ranges, *NAME, "conv").sortWithinPartitions(*NAME, "conv")
    lists = dealt.mapInArrow(join, schema).repartition(*NAME).sortWithinPartitions(*NAME, "first")
    return lists.mapInArrow(digest, "depth bigint, p1 bigint, p2 bigint, ends_sha256 string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per node of the trie of ``turns`` (conv, place from 1, h1, h2, words); ``convs`` has every conversation.

    conv_id (the smallest member), depth, parent_conv_id (NULL at the root),
    n_convs, n_children, n_leaves, saved_tokens (over the subtree, words of a
    node's last text for each member but one), ends_sha256 (of the members that
    end there, of none the empty text's). Of no conversations there is no node,
    not even the root.
    """
    ship(turns.sparkSession)
    mixed = turns.select(
        "conv", F.col("place").alias("depth"), "words",
        F.xxhash64("place", "h1", "h2").alias("m1"), F.xxhash64(F.lit("second"), "h2", "h1", "place").alias("m2"),
    )
    xor, both = _XOR
    paths = running(mixed, "conv", ["depth"], {"p1": (xor, "m1", both), "p2": (xor, "m2", both)})
    last = paths.groupBy("conv").agg(F.max_by(F.struct("depth", "p1", "p2"), "depth").alias("end"))
    none = F.lit(0).cast("bigint")
    ends = convs.join(last, "conv", "left").select("conv", *[F.coalesce(f"end.{c}", none).alias(c) for c in NAME])
    ends = written(ends, "trie-ends")

    # identical conversations collapse: weight and least one of each sequence
    sequences = written(ends.groupBy(*NAME).agg(F.count("*").alias("weight"), F.min("conv").alias("seq")), "trie-sequences")
    kept = paths.withColumnRenamed("conv", "seq").join(sequences.select("seq", "weight", F.col("depth").alias("length")), "seq")
    kept = kept.select("seq", "weight", "length", *NAME, F.col("p1").bitwiseXOR(F.col("m1")).alias("q1"), F.col("p2").bitwiseXOR(F.col("m2")).alias("q2"), "words")
    roots = sequences.select("seq", "weight", F.col("depth").alias("length"), none.alias("depth"), none.alias("p1"), none.alias("p2"),
                             F.lit(None).cast("bigint").alias("q1"), F.lit(None).cast("bigint").alias("q2"), none.alias("words"))
    prefixes = written(kept.unionByName(roots), "trie-prefixes")
    proper = prefixes.where("depth < length").select(*NAME).distinct()
    leaves = sequences.join(proper, NAME, "left_anti").select("seq", F.lit(True).alias("leaf"))
    marked = written(prefixes.join(leaves, "seq", "left").withColumn("leaf", F.coalesce("leaf", F.lit(False))), "trie-marked")

    nodes = marked.groupBy(*NAME).agg(
        F.min("seq").alias("conv_id"), F.sum("weight").alias("n_convs"), F.max("q1").alias("q1"), F.max("q2").alias("q2"),
        F.max("words").alias("words"), F.min(F.when(F.col("leaf"), F.col("seq"))).alias("owner"), F.sum(F.col("leaf").cast("bigint")).alias("n_leaves"),
    )
    nodes = written(nodes, "trie-nodes")
    owned = nodes.select(F.col("owner").alias("seq"), "depth", ((F.col("n_convs") - 1) * F.col("words")).alias("own"))
    chains = marked.where("leaf").select("seq", *NAME).join(owned, ["seq", "depth"], "left")
    chains = chains.select("seq", *NAME, (-F.col("depth")).alias("from_end"), F.coalesce("own", none).alias("own"))
    summed = running(chains, "seq", ["from_end"], {"below": (F.sum, "own", lambda a, b: a + b)})
    saved = summed.groupBy(*NAME).agg(F.sum("below").alias("saved_tokens"))

    up = [(F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    full = nodes.join(saved, NAME).join(children, NAME, "left").join(_ends_digests(ends), NAME, "left")
    # a node may have any number of children: the join is on the parent's name and Spark splits a hot one
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent_conv_id"))
    return full.join(parents, ["depth", "q1", "q2"], "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"), "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """The trie of conversations as they are; see ``turns_of`` and ``trie``. Other columns are ignored."""
    turns = turns_of(conversations, conv, turn, role, text)
    return trie(turns.withColumnRenamed("rank", "place"), turns.select("conv").distinct())
