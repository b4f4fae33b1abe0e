"""The registered queries of this subpackage, over whole tables."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .centroids import cluster_vectors
from .chat import format_chats, masked_text, read_back
from .common import table
from .decontaminate import contamination
from .jaccard import similar
from .licences import licences
from .licences import train as train_licences
from .lines import without_repeated_lines
from .neighbours import nearest
from .pack import packed
from .quality import BASE, RULES, cascade_order, first_failed, measured
from .repeats import repeated_spans
from .secrets import secrets_by_document
from .toxicity import toxicity, train
from .tries import rebuilt, trie, turns_of

Query = Callable[[SparkSession, str], DataFrame]


def op1_quality(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    order = cascade_order(documents)
    known = measured(documents.select("doc_id", "text")).select("doc_id", "measures.*")
    base = [rule.fails(F.col) for rule in RULES if rule.name in BASE]
    return known.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        (base[0] | base[1]).alias("base_failed"),
        first_failed(order, F.col).isNull().alias("kept"),
    )


def op2_licences(spark: SparkSession, directory: str) -> DataFrame:
    documents = table(spark, directory, "documents")
    found = licences(documents, train_licences(documents))
    return found.select("doc_id", F.array_join("families", ",").alias("families"), "n_confirmed", "n_predicted")


def op3_lines(spark: SparkSession, directory: str) -> DataFrame:
    left = without_repeated_lines(table(spark, directory, "documents").select("doc_id", "text"))
    lines = F.when(F.coalesce("text", F.lit("")) == "", 0).otherwise(F.size(F.split("text", "\n", -1)))
    return left.select(
        "doc_id",
        lines.cast("bigint").alias("n_kept_lines"),
        F.col("n_removed_lines"),
        F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n_kept_chars"),
        F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"),
    )


def op4_secrets(spark: SparkSession, directory: str) -> DataFrame:
    found = secrets_by_document(table(spark, directory, "documents"))
    base = ("assign", "access", "hex")

    def listed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    of_base = F.filter("spans", lambda s: s["kind"].isin(*base))
    return found.select(
        "doc_id", *map(number, base), F.sha2(listed(of_base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans")
    )


def op5_jaccard(spark: SparkSession, directory: str) -> DataFrame:
    return similar(table(spark, directory, "documents"), shingle=3, share=0.9)


def op6_packing(spark: SparkSession, directory: str) -> DataFrame:
    return packed(table(spark, directory, "documents")).select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", "sequence_id", "offset"
    )


def op7_chat(spark: SparkSession, directory: str) -> DataFrame:
    conversations = table(spark, directory, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    chats = format_chats(conversations.unionByName(spark.createDataFrame(own, conversations.schema)))
    read = chats.select(
        F.col("conv").alias("conv_id"), "text", read_back(F.col("text")).alias("turns"),
        masked_text(F.col("text"), F.col("loss")).alias("learnt"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("text").cast("bigint").alias("formatted_chars"),
    )


def op8_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    documents, labels = table(spark, directory, "documents"), table(spark, directory, "labels")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3))
    model = train(documents, labels.where(remainder != 1))
    return toxicity(documents, model).select(
        "doc_id",
        F.coalesce(remainder == 1, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op9_repeats(spark: SparkSession, directory: str) -> DataFrame:
    found = repeated_spans(table(spark, directory, "documents"))
    sizes = F.transform("spans", lambda s: s["end"] - s["start"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate(sizes, F.lit(0).cast("bigint"), lambda total, size: total + size).alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        "kept_sha256",
    )


def op10_decontamination(spark: SparkSession, directory: str) -> DataFrame:
    found = contamination(table(spark, directory, "documents"), table(spark, directory, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        "contaminated",
    )


def op11_centroids(spark: SparkSession, directory: str) -> DataFrame:
    found = cluster_vectors(table(spark, directory, "embeddings"))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in found.centroids]
    inertia = [0] * len(digests)
    for row in found.assigned.groupBy("cluster").agg(F.sum("distance").alias("d")).collect():  # a row per cluster
        inertia[row.cluster] = row.d

    def by_cluster(values: list, kind: str):
        return F.get(F.array(*map(F.lit, values)).cast(f"array<{kind}>"), F.col("cluster"))

    return found.assigned.select(
        F.col("id").alias("vec_id"), "cluster", "distance", by_cluster(inertia, "bigint").alias("cluster_inertia"),
        F.lit(sum(inertia)).cast("bigint").alias("inertia"), by_cluster(digests, "string").alias("centroid_sha256"),
    )


def op12_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    return nearest(table(spark, directory, "embeddings"))


def op13_tries(spark: SparkSession, directory: str) -> DataFrame:
    return trie(*rebuilt(turns_of(table(spark, directory, "conversations"))))


QUERIES: dict[str, Query] = {
    "op1_quality": op1_quality,
    "op2_licences": op2_licences,
    "op3_lines": op3_lines,
    "op4_secrets": op4_secrets,
    "op5_jaccard": op5_jaccard,
    "op6_packing": op6_packing,
    "op7_chat": op7_chat,
    "op8_toxicity": op8_toxicity,
    "op9_repeats": op9_repeats,
    "op10_decontamination": op10_decontamination,
    "op11_centroids": op11_centroids,
    "op12_neighbours": op12_neighbours,
    "op13_tries": op13_tries,
}
