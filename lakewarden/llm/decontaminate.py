"""Benchmark decontamination: a prefix-filtered set join, verified exactly.

An item's windows (``window`` consecutive words, or the whole item when it has
fewer) are searched in every document. A window occurs only where all its
shingles occur, so one of them is a sufficient prefix: the one that is rarest
over all documents. A first pass counts the benchmark's shingles, and only counts
leave it; windows with a shingle that stands nowhere are out. A second pass joins
the prefixes alone: their places are candidates, which the positional and length
bounds cut down, and a candidate counts when the window's words stand there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, fresh, grams, hinted, lower_ascii, words_by, written

#: ASCII characters that end a word; all others are word characters
SEPARATORS = r"\x00-\x2F\x3A-\x60\x7B-\x7F"


def words_of(text: Column) -> Column:
    return words_by(lower_ascii(text), SEPARATORS)


def _windows(benchmark: DataFrame, item: str, text: str, window: int) -> DataFrame:
    """(item, w): one row per item and window."""
    words = benchmark.select(F.col(item).cast("string").alias("item"), words_of(F.col(text)).alias("words"))
    size = F.least(F.size("words"), F.lit(window))
    starts = words.where(F.size("words") > 0).select(
        "item", "words", size.alias("size"), F.explode(F.sequence(F.lit(1), F.size("words") - size + 1)).alias("start")
    )
    return starts.select(F.coalesce("item", F.lit("")).alias("item"), F.slice("words", F.col("start"), F.col("size")).alias("w"))


def _positions(docs: DataFrame, size: int, *columns: str) -> DataFrame:
    """(*columns, n, pos, h): the hash of each run of ``size`` words, and where in the document's n words it stands."""
    hashed = docs.select(*columns, F.size("words").alias("n"), grams(F.col("words"), size).alias("hs"))
    # outer: for an inner one Spark infers a filter on the array and computes it in the scan, once per element
    return hashed.select(*columns, "n", F.posexplode_outer("hs").alias("pos", "h")).where("h is not null")


def _rarity(docs: DataFrame, parts: DataFrame, sizes: list[int], broadcast_rows: int) -> DataFrame:
    """(q, h, n_places): how often each shingle of the benchmark stands in the documents; counted before the shuffle."""
    shingles = hinted(written(parts.select("q", "h").distinct(), "bench-shingles"), broadcast_rows)
    counts = None
    for size in sizes:
        own = _positions(docs, size).join(shingles.where(F.col("q") == size), "h")
        own = own.groupBy("q", "h").agg(F.count("*").alias("n_places"))
        counts = own if counts is None else counts.unionByName(own)
    return counts


def _found(docs: DataFrame, prefix: DataFrame, sizes: list[int], broadcast_rows: int) -> DataFrame:
    """(id, rk, start, size, wid): where the windows occur, each met by its prefix and verified on the words."""
    marked = hinted(prefix, broadcast_rows)
    few = marked is not prefix
    start = F.col("pos") - F.col("off")
    there = F.concat_ws(" ", F.slice(F.col("words"), F.col("start") + 1, F.col("size"))) == F.col("said")
    found = None
    for size in sizes:
        # with few prefixes the words stay in the scan's stage, and only occurrences leave it
        rows = _positions(docs, size, "id", "rk", *["words"] * few)
        met = rows.join(marked.where(F.col("q") == size), "h").withColumn("start", start).where("start >= 0 and start + size <= n")
        if not few:
            texts = docs.select(F.col("id").alias("i"), F.col("rk").alias("r"), "words").dropDuplicates(["i", "r"])
            met = met.drop("h", "pos", "n").join(texts, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")))
        own = met.where(there).select("id", "rk", "start", "size", "wid")
        found = own if found is None else found.unionByName(own)
    return found.distinct()


def occurrences(
    documents: DataFrame,
    benchmark: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    window: int = 10,
    shingle: int = 3,
    broadcast_rows: int = BROADCAST_ROWS,
) -> tuple[DataFrame, DataFrame]:
    """Where windows occur: (id, rk, start, size, wid), and the items of each window: (wid, item).

    ``rk`` is a hash of the text: with the id it tells rows apart when an id repeats.
    """
    spans = written(_windows(benchmark, item, item_text, window), "bench-windows")
    windows = written(
        spans.groupBy("w").agg(F.collect_set("item").alias("items")).withColumn("wid", F.monotonically_increasing_id()),
        "bench-ids",
    )
    q = F.least(F.size("w"), F.lit(shingle))
    sizes = sorted(r[0] for r in windows.select(q.alias("q")).distinct().collect()) or [1]  # at most `shingle` rows
    hashes = F.array().cast("array<bigint>")
    for n in sizes:
        hashes = F.when(F.col("q") == n, grams(F.col("w"), n)).otherwise(hashes)
    parts = windows.select("wid", "w", F.size("w").alias("size"), q.alias("q"))
    parts = written(parts.select("wid", "size", "q", F.posexplode(hashes).alias("off", "h")), "bench-parts")
    docs = documents.select(
        F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"), words_of(F.col(text)).alias("words")
    )
    rarity = written(_rarity(docs, parts, sizes, broadcast_rows), "bench-rarity")
    prefix = (
        parts.join(rarity, ["q", "h"])  # a shingle that is nowhere excludes its window
        .groupBy("wid", "size", "q")
        .agg(F.count("*").alias("n_shingles"), F.min(F.struct("n_places", "off", "h")).alias("least"))
        .where("n_shingles = size - q + 1")
        .join(windows.select("wid", F.concat_ws(" ", "w").alias("said")), "wid")
        .select("wid", "size", "q", "said", "least.off", "least.h")
    )
    found = _found(docs, written(prefix, "bench-prefixes"), sizes, broadcast_rows)
    return written(found, "bench-found"), windows.select("wid", F.explode("items").alias("item"))


def contamination(
    documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """One row per document: id, n_words, n_hit, items (sorted texts of item ids), contaminated.

    A NULL or empty text has no words and no hits; so has an empty item. Rows
    with the same id and text get the same answer each, a repeated id with
    another text its own. A NULL item id counts as the item ''. Of an empty
    benchmark nothing is found. Other columns are neither read nor returned.
    """
    found, items = occurrences(documents, benchmark, id, text, **options)
    covered = (
        found.select("id", "rk", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("size") - 1)).alias("at"))
        .distinct()
        .groupBy("id", "rk")
        .agg(F.count("*").alias("n_hit"))
    )
    named = (
        found.select("id", "rk", "wid").distinct().join(items, "wid").select("id", "rk", "item").distinct()
        .groupBy("id", "rk")
        .agg(F.sort_array(F.collect_list("item")).alias("items"))
    )
    per_doc = covered.join(
        named.select(F.col("id").alias("i"), F.col("rk").alias("r"), "items"),
        F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")),
    ).select(F.col("id").alias("i"), F.col("rk").alias("r"), "n_hit", "items")
    docs = documents.select(
        F.col(id).alias("id"),
        F.xxhash64(F.col(text)).alias("rk"),
        F.size(words_of(F.col(text))).cast("bigint").alias("n_words"),
    )
    return docs.join(per_doc, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")), "left").select(
        F.col("id").alias(id),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminate(
    documents: DataFrame, benchmark: DataFrame, id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """The documents, all columns, without those in which a window of the benchmark occurs."""
    found, _ = occurrences(documents, benchmark, id, text, **options)
    # broadcast, so the documents with their texts are shuffled for more of these than memory holds only
    bad = hinted(written(found.select(F.col("id").alias("i"), F.col("rk").alias("r")).distinct(), "bench-documents"), options.get("broadcast_rows", BROADCAST_ROWS))
    rk = fresh([documents], "text_hash")
    docs = documents.withColumn(rk, F.xxhash64(F.col(text)))
    return docs.join(bad, docs[id].eqNullSafe(bad.i) & (docs[rk] == bad.r), "left_anti").drop(rk)
