"""Exact Jaccard self-join of documents by token combinations.

A document's tokens are hashes of its word shingles. The join has two levels.

Routing. Documents that share keys, directly or in a chain, form a candidate
group. Tokens are ordered by hash and cut into ranges, some more than two linked
sets of a size class can differ in. So some range holds the same tokens in both,
and the combination of all its tokens (about eight at 0.9, four at 0.8) is a key
that both have; a passage that many documents share fills hardly a range, so it
joins hardly any. Of a key's documents each is bound to the least one. That is done where the
keys are made first, so a key that a third of all documents have sends one row
per block of documents, not one per document.

Joining. Equal sets are one set from here on. Inside a group tokens are ordered
from rare to frequent. A link needs a common token among each side's rarest;
where that one is rare, single tokens are the index. Where it is frequent all
common tokens are, so the prefix is extended by one and pairs of frequent tokens
are the index. Candidates are verified exactly. Groups beyond a block's size are
joined block by block.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, arrow_rows, discard, fresh, grams, hinted, let, lower_ascii, ship, words_by, written
from .components import components

#: Documents of a block; a task joins two blocks
BLOCK = 1000
#: A token is rare in a group if at most so many of its documents have it
RARE = 16
#: Keys that are brought together before they are sent
COMBINED = 1_000_000
#: Tokens whose keys are made at a time (a larger set is taken whole), and sets that go to Python at a time
TOKENS, SETS = 250_000, 1000
#: Pairs of frequent tokens that a task holds; their number grows with the square of a set's size, so beyond it single tokens are the index
PAIRS = 4_000_000


def token_set(text: Column, shingle: int) -> Column:
    """The distinct shingle hashes in order; of fewer words the whole sequence as one; of none none."""

    def of(words: Column) -> Column:
        short = F.array().cast("array<bigint>")
        for n in range(1, shingle):
            short = F.when(F.size(words) == n, grams(words, n)).otherwise(short)
        return F.when(F.size(words) >= shingle, F.array_sort(F.array_distinct(grams(words, shingle)))).otherwise(short)

    return let(words_by(lower_ascii(text), SPACES), of)


def _size_classes(share: float, limit: int = 2**31) -> np.ndarray:
    """Lower ends of the size classes; linked sets lie in one or in neighbouring ones."""
    ends, at = [1], 1.0
    while at < limit:
        at = max(at / share**3, ends[-1] + 1)
        ends.append(math.ceil(at))
    return np.array(ends)


def _differ(sizes: np.ndarray, ends: np.ndarray, share: float) -> np.ndarray:
    """Tokens that are in one only of a set and a linked one whose size is below ``ends``, at most."""
    largest = np.minimum(np.floor(sizes / share + 1e-9), ends - 1)
    return np.floor((sizes + np.maximum(largest, sizes)) * (1 - share) / (1 + share) + 1e-9).astype(np.int64)


def _range_numbers(ends: np.ndarray, share: float) -> np.ndarray:
    """For each size class the number of ranges.

    Linked sets have all ranges alike but as many as they differ in tokens. A
    range with one token or none is alike in too many sets to be a key. So there
    are as many ranges as it takes for almost all sets to have fewer of these
    light ones than are alike; a set that has more uses its light ranges as well.
    """
    ranges = np.empty(len(ends) - 1, np.int64)
    for at, (lower, end) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)):
        sizes = np.unique(np.linspace(max(1, share * lower), end - 1, 5).astype(np.int64))
        differ = _differ(sizes, np.full(len(sizes), end), share)
        d = int(differ.max())
        best, found = -np.inf, d + 1
        for m in sorted({d + 1 + int(k * (d + 8) / 30) for k in range(45)}):
            each = sizes / m
            light = m * np.exp(-each) * (1 + each)
            spare = ((m - differ - light) / np.sqrt(light + 1)).min()
            if spare > best:
                best, found = spare, m
            if spare >= 2.5:
                break
        ranges[at] = found
    return ranges


def sliced(batch: pa.RecordBatch, lists: str, values: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose lists hold about so many values together, at least one row each."""
    ends = batch.column(lists).offsets.to_numpy()
    start = 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + values, side="right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def _keyed(sets: DataFrame, share: float) -> DataFrame:
    """(id, h1, h2, n, keys): for each set a hash of the tokens in each range of its size class and, near its end, the next."""
    ends = _size_classes(share)
    ranges = _range_numbers(ends, share)
    held_columns = ["id", "h1", "h2", "n"]

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sliced(whole, "tokens", TOKENS)):
            column = batch.column("tokens")
            tokens = column.flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(column.offsets.to_numpy())
            own = np.searchsorted(ends, sizes, side="right") - 1
            place = ((tokens >> 32) + 2**31).astype(np.float64) / 2**32  # in [0, 1), as ordered
            mixed = tokens.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(32)
            row = np.repeat(np.arange(len(sizes)), sizes)
            found, owners = [], []
            for step in (0, 1):
                scheme = own + step
                takes = sizes > 0 if step == 0 else (sizes > 0) & (sizes >= np.floor(share * ends[own + 1]))
                m = ranges[scheme]
                cell = (place * m[row]).astype(np.int64)
                first = np.concatenate([[0], np.cumsum(m * takes)])
                sums = np.zeros(first[-1], np.uint64)
                used = takes[row]
                at = first[row[used]] + cell[used]
                np.add.at(sums, at, mixed[used])
                held = np.bincount(at, minlength=first[-1])
                owner = np.repeat(np.arange(len(sizes)), m * takes)
                alike = m - _differ(sizes, ends[scheme + 1], share)
                light = np.bincount(owner[held < 2], minlength=len(sizes)) >= alike
                empty = np.bincount(owner[held < 1], minlength=len(sizes)) >= alike
                # of linked sets one range alike has two tokens, unless one of them is light; then one has a token
                kept = (held >= 2) | (light[owner] & (held == 1)) | empty[owner]
                sums, owner, cells = sums[kept], owner[kept], (np.arange(first[-1]) - first[owner])[kept]
                key = sums ^ ((scheme[owner] * 2**24 + cells).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
                key *= np.uint64(0xFF51AFD7ED558CCD)
                key ^= key >> np.uint64(33)
                found.append(key)
                owners.append(owner)
            owner = np.concatenate(owners)
            key = np.concatenate(found)[np.argsort(owner, kind="stable")].view(np.int64)
            offsets = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(sizes)))])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(key))
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in held_columns], lists], names=[*held_columns, "keys"])

    marked = sets.select("id", F.xxhash64("tokens").alias("h1"), F.hash("tokens").alias("h2"), F.size("tokens").alias("n"), "tokens")
    return marked.mapInArrow(keys, "id bigint, h1 bigint, h2 int, n int, keys array<bigint>")


def _stars(keyed: DataFrame) -> DataFrame:
    """(u, v): each document and a least one that shares a key with it; a key's documents are all connected.

    Keys are brought together in blocks of documents, where each document is
    bound to the block's least of the key. Only that one is sent on, so a key
    has as many rows in the shuffle as it has blocks.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held, size = [], 0

        def combined():
            key, owner = (np.concatenate(x) for x in zip(*held, strict=True))
            order = np.lexsort((owner, key))
            key, owner = key[order], owner[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))[: len(key)]
            return key, owner, first

        for batch in batches:
            column = batch.column("keys")
            key = column.flatten().to_numpy(zero_copy_only=False)
            held.append((key, np.repeat(batch.column("id").to_numpy(zero_copy_only=False), np.diff(column.offsets.to_numpy()))))
            size += len(key)
            if size >= COMBINED:
                yield combined()
                held, size = [], 0
        if size:
            yield combined()

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, owner, first in blocks(batches):
            least = np.repeat(owner[first], np.diff(np.append(first, len(key))))
            pairs = np.unique(np.stack([owner, least], axis=1)[owner != least], axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, owner, first in blocks(batches):
            yield pa.RecordBatch.from_arrays([pa.array(key[first]), pa.array(owner[first])], names=["key", "id"])

    rows = keyed.where("id is not null and n > 0").select("id", "keys")
    least = F.min("id").over(Window.partitionBy("key"))
    across = rows.mapInArrow(heads, "key bigint, id bigint").withColumn("v", least).where("v < id").select(F.col("id").alias("u"), "v")
    return rows.mapInArrow(inside, "u bigint, v bigint").union(across).distinct()


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def prefix_join(sets: list[np.ndarray], share: float, rare: int = RARE) -> list[tuple[int, int]]:
    """Links that connect all linked sets: a spanning forest of the exact join."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n < 2 or not sizes.sum():
        return []
    _, token, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    ordered_often = np.sort(often)
    first = np.concatenate([[0], np.cumsum(sizes)])
    ranked = [np.sort(rank[token[first[i] : first[i + 1]]]) for i in range(n)]
    keys, owners, counts = [], [], []
    prefixes = [tokens[: len(tokens) - math.ceil(share * len(tokens) - 1e-9) + 2] for tokens in ranked]
    often_in = [int((ordered_often[p] > rare).sum()) for p in prefixes]
    paired = sum(k * (k - 1) // 2 for k in often_in) <= PAIRS
    for i, tokens in enumerate(ranked):
        if not len(tokens):
            continue
        spare = len(tokens) - math.ceil(share * len(tokens) - 1e-9)  # tokens that a linked set may lack
        prefix = tokens[: spare + 2]
        count = ordered_often[prefix]
        single = prefix[: spare + 1][(count[: spare + 1] > 1) & (count[: spare + 1] <= rare)]
        frequent = prefix[count > rare]
        if len(tokens) == 1:  # no second token to combine with
            pairs = frequent
        elif paired:
            a, b = np.triu_indices(len(frequent), 1)
            pairs = frequent[a] * len(often) + frequent[b] + len(often)
        else:
            pairs = prefix[: spare + 1][count[: spare + 1] > rare]
        keys += [single, pairs]
        owners.append(i)
        counts.append(len(single) + len(pairs))
    key, owner = np.concatenate(keys), np.repeat(np.array(owners, np.int32), counts)
    del keys
    order = np.argsort(key, kind="stable")  # owners ascend already
    key, owner = key[order], owner[order]
    del order
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    ends = np.concatenate([starts[1:], [len(key)]])
    partners: list[set[int]] = [set() for _ in range(n)]
    for s, e in zip(starts[ends - starts > 1], ends[ends - starts > 1], strict=True):
        members = owner[s:e].tolist()
        for at, x in enumerate(members[:-1]):
            partners[x].update(members[at + 1 :])
    flat, marked = np.concatenate(ranked), np.zeros(len(often), bool)
    forest, links = _Forest(n), []
    for x in range(n):
        others = [y for y in partners[x] if min(sizes[x], sizes[y]) >= share * max(sizes[x], sizes[y]) - 1e-9 and forest.root(y) != forest.root(x)]
        if not others:
            continue
        marked[ranked[x]] = True
        for part in range(0, len(others), 1000):
            chunk = np.array(others[part : part + 1000])
            lengths = sizes[chunk]
            ends = np.cumsum(lengths)
            at = np.arange(ends[-1]) + np.repeat(first[chunk] - (ends - lengths), lengths)
            common = np.add.reduceat(marked[flat[at]].astype(np.int64), ends - lengths)
            together = sizes[x] + lengths - common
            for y in chunk[common * 1000 >= round(share * 1000) * together].tolist():
                if forest.join(x, y):
                    links.append((x, y))
        marked[ranked[x]] = False
    return links


def _group_links(groups: DataFrame, share: float) -> DataFrame:
    def join(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", ignore_index=True)
        ids = rows["id"].to_numpy()
        links = prefix_join([np.asarray(t, np.int64) for t in rows["tokens"]], share)
        return pd.DataFrame({"u": [ids[x] for x, _ in links], "v": [ids[y] for _, y in links]}, dtype="int64")

    return groups.groupBy("part", "a", "b").applyInPandas(join, "u bigint, v bigint")


def _placed(stars: DataFrame, purpose: str) -> DataFrame:
    """(node, component, members): of each node that has a partner."""
    found = written(components(stars), "jaccard-groups")
    whole = found.groupBy("component").agg(F.count("*").alias("members"))
    out = written(found.join(whole, "component").where("members > 1"), purpose)
    discard(found)
    return out


def _narrowed(sets: DataFrame, share: float, block: int) -> DataFrame:
    """(id, component, members, tokens): large groups without the sets that can have no link, grouped again.

    A linked set has ``share`` of its tokens in other sets of its group. Most of
    a large group are sets that share a passage, which grows into a chain
    through a good part of the corpus but holds few tokens of each.
    """
    columns = ["id", "component", "members", "tokens"]
    now, small = sets.select(*columns), []
    before = None
    while (rows := now.where(F.col("members") > block).count()) and (before is None or rows < 0.9 * before):
        before = rows
        small.append(now.where(F.col("members") <= block))
        large = now.where(F.col("members") > block).withColumn("row", F.xxhash64("id", "tokens"))
        tokens = large.select("component", "row", F.size("tokens").alias("n"), F.explode("tokens").alias("token"))
        there = F.count("*").over(Window.partitionBy("component", "token"))
        wanted = F.ceil(F.min("n") * share - 1e-9)
        held = tokens.withColumn("there", there).where("there > 1").groupBy("row").agg((F.count("*") >= wanted).alias("enough")).where("enough")
        held = hinted(written(held.select("row"), "jaccard-held"))
        left = written(large.join(held, "row", "left_semi").select("id", "tokens"), "jaccard-sets")
        with arrow_rows(sets.sparkSession, SETS):
            keyed = written(_keyed(left, share), "jaccard-keys")
        stars = written(_stars(keyed), "jaccard-stars")
        placed = hinted(_placed(stars, "jaccard-places"))
        discard(keyed, stars)
        now = written(left.join(placed.withColumnRenamed("node", "id"), "id").select(*columns), "jaccard-sets")
        discard(left)
    for part in small:
        now = now.unionByName(part)
    return now


def _large_links(large: DataFrame, share: float, block: int) -> DataFrame:
    """Links of large groups, cut into blocks; what is sent grows with a group and not with its square, where most of it is linked.

    Each block meets itself and the first one, the hub, which binds most copies
    of one text. Only sets that are then outside of the group's largest
    component meet all others.
    """
    blocks = F.ceil(F.col("members") / block).cast("int")
    mine = F.pmod(F.xxhash64("id"), blocks).cast("int")
    hub = F.when(mine == 0, F.sequence(F.lit(0), blocks - 1)).otherwise(F.array(mine))
    part = F.col("component").cast("string").alias("part")
    first = large.select(part, F.explode(hub).alias("a"), F.lit(0).alias("b"), "id", "tokens")
    first = written(_group_links(first, share), "jaccard-links")
    bound = written(components(first), "jaccard-bound").select(F.col("node").alias("id"), F.col("component").alias("to"))
    state = large.select("id", "component", "members").join(bound, "id", "left").withColumn("to", F.coalesce("to", "id"))
    state = written(state.distinct(), "jaccard-state")
    most = state.groupBy("component", "to").agg(F.count("*").alias("n")).groupBy("component").agg(F.max(F.struct("n", "to")).alias("most"), F.sum("n").alias("all"))
    cuts = most.select("component", F.col("most.to").alias("main"), F.ceil((F.col("all") - F.col("most.n")) / block).cast("int").alias("rests")).where("rests > 0")
    cuts = hinted(written(cuts, "jaccard-cuts"))
    rest = state.join(cuts, "component").select("id", "rests", (F.col("to") != F.col("main")).alias("rest"))
    # a group without a rest is settled, and its sets go no further
    open_ = large.join(hinted(written(rest, "jaccard-rest")), "id")
    r = F.pmod(F.xxhash64("id", F.lit(1)), F.col("rests")).cast("int")
    numbers = F.sequence(F.lit(0), F.col("rests") - 1)
    own = F.transform(numbers, lambda o: F.struct(F.lit("r").alias("side"), F.least(o, r).alias("a"), F.greatest(o, r).alias("b")))
    others = F.transform(F.sequence(F.lit(0), blocks - 1), lambda o: F.struct(F.lit("m").alias("side"), r.alias("a"), o.alias("b")))
    met = F.transform(numbers, lambda o: F.struct(F.lit("m").alias("side"), o.alias("a"), mine.alias("b")))
    dealt = F.explode(F.when(F.col("rest"), F.concat(own, others)).otherwise(met)).alias("p")
    rows = open_.select("component", dealt, "id", "tokens")
    second = rows.select(F.concat_ws(" ", "component", "p.side").alias("part"), "p.a", "p.b", "id", "tokens")
    return first.union(_group_links(second, share))


def similar(
    documents: DataFrame, id: str = "doc_id", text: str = "text", shingle: int = 5, share: float = 0.8, block: int = BLOCK
) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id reachable by links, its own included).

    Two documents are linked if their shingle sets' Jaccard similarity is at
    least ``share``. Ids are integers. Documents without words, with NULL or
    empty texts, have no shingles and no links. Rows that repeat an id count as
    one document with each text; a row with a NULL id has no links and a NULL
    component. Other columns are ignored.
    """
    ship(documents.sparkSession)
    rows = documents.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    with arrow_rows(documents.sparkSession, SETS):
        keyed = written(_keyed(rows.select("id", token_set(F.col("text"), shingle).alias("tokens")), share), "jaccard-keys")
    stars = written(_stars(keyed), "jaccard-stars")
    candidates = written(components(stars), "jaccard-groups")
    prints = written(keyed.select("id", "h1", "h2", "n"), "jaccard-prints")
    discard(keyed, stars)

    # equal sets: the least id stands for all of them
    same = ["h1", "h2", "n"]
    named = prints.where("id is not null and n > 0")
    equal = named.groupBy(*same).agg(F.min("id").alias("least"), F.count("*").alias("several")).where("several > 1").drop("several")
    equal = hinted(written(equal, "jaccard-equal"))
    marked = named.join(equal, same, "left").select("id", "least")
    copies = marked.where("id != least").select(F.col("id").alias("u"), F.col("least").alias("v"))
    # an id may have several texts: it is left out if each of them is another's copy
    standing = marked.groupBy("id").agg(F.bool_or(F.coalesce(F.col("id") == F.col("least"), F.lit(True))).alias("first")).where("first")
    firsts = candidates.join(standing.select(F.col("id").alias("node")), "node")
    whole = firsts.groupBy("component").agg(F.count("*").alias("members"))
    placed = hinted(written(firsts.join(whole, "component").where("members > 1"), "jaccard-places"))
    # the join comes before the sets are made, so only candidates' texts are cut into words
    texts = rows.where(F.col("id").isNotNull()).join(placed.withColumnRenamed("node", "id"), "id")
    sets = texts.select("id", "component", "members", token_set(F.col("text"), shingle).alias("tokens"))
    # no filter on the sets: Spark would make them for all documents, before the join
    sets = written(sets, "jaccard-sets").where(F.size("tokens") > 0)
    # large groups lose what cannot be linked; small ones share a part
    sets = _narrowed(sets, share, block)
    all_, outside = sets.agg(F.count("*"), F.count_if(F.col("members") > block)).first()
    parts = max(1, -(-all_ // block))
    small = sets.where(F.col("members") <= block).select(
        F.concat(F.lit("s"), F.pmod(F.xxhash64("component"), F.lit(parts))).alias("part"), F.lit(0).alias("a"), F.lit(0).alias("b"), "id", "tokens"
    )
    links = _group_links(small, share).union(copies)
    if outside:
        links = links.union(_large_links(sets.where(F.col("members") > block), share, block))
    links = written(links, "jaccard-links")
    found = written(components(links), "jaccard-components")
    discard(candidates, links)
    return prints.select("id", F.col("n").cast("bigint").alias("n_shingles")).join(found.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias(id), "n_shingles", F.coalesce("component", "id").alias("component_id")
    )


def one_of_each(documents: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The documents, all columns, that are the smallest id of their component; rows with a NULL id stay."""
    kept = similar(documents, id, text, **options)
    other = fresh([documents], "other")
    others = hinted(written(kept.where(F.col(id) != F.col("component_id")).select(F.col(id).alias(other)).distinct(), "jaccard-others"))
    return documents.join(others, F.col(f"`{id}`").cast("bigint") == F.col(other), "left_anti")
