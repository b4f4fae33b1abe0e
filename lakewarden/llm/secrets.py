"""Secret scans through an inverted index of trigrams.

Each rule's regular expression is turned into a Boolean query: an OR of ANDs of
trigrams that every match must contain. The index holds, for the trigrams that
any rule asks for, the documents in which they occur (without case). Postings
are intersected by counting, and the regular expression runs over the
candidates only. A rule without a mandatory trigram runs over all documents.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, written

#: Alternatives followed before a literal run is cut
MAX_ALTERNATIVES = 64


@dataclass(frozen=True)
class SecretRule:
    """A kind of secret. A match counts if its group ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


# The shapes of secrets
RULES = (
    SecretRule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        group=1,
        least=6,
    ),
    # maximal runs, so a least length in the pattern keeps the same matches
    SecretRule("access", r"AKIA[A-Z0-9]{16,}"),
    SecretRule("hex", r"[0-9a-f]{24,}"),
    SecretRule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    SecretRule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    SecretRule("google", r"AIza[A-Za-z0-9_-]{35}"),
    SecretRule("stripe", r"[sr]k_live_[A-Za-z0-9]{16,}"),
    SecretRule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    SecretRule("private_key", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
)


def _walk(tokens, states: set[tuple[frozenset[str], str]]) -> set[tuple[frozenset[str], str]]:
    """Each state: the trigrams sure so far, and the literal run that is still growing."""

    def grown(state, text):
        sure, run = state
        run += text
        return (sure | {run[i : i + 3] for i in range(len(run) - 2)}, run[-2:])

    def cut(found):
        return {(sure, "") for sure, _ in found}

    for op, value in tokens:
        kind = str(op)
        before = states
        if kind == "LITERAL":
            states = {grown(s, chr(value).lower()) for s in states}
        elif kind == "SUBPATTERN":
            states = _walk(value[3], states)
        elif kind == "BRANCH":
            states = set().union(*[_walk(branch, states) for branch in value[1]])
        elif kind == "IN" and len(value) <= 8 and all(str(o) == "LITERAL" for o, _ in value):
            states = {grown(s, chr(c).lower()) for s in states for _, c in value}
        elif kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, body = value
            if (least, most) == (0, 1):
                states = states | _walk(body, states)
            else:
                for _ in range(min(least, 3)):
                    states = _walk(body, states)
                states = cut(states)
        elif kind != "AT":  # a large class or anything else: nothing is sure of it
            states = cut(states)
        if len(states) > MAX_ALTERNATIVES:
            states = cut(before)
    return states


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """An OR of ANDs of lower-case trigrams that every match contains; empty if there is none."""
    clauses = {sure for sure, _ in _walk(re._parser.parse(pattern), {(frozenset(), "")})}
    if frozenset() in clauses:
        return []
    return sorted((c for c in clauses if not any(other < c for other in clauses)), key=sorted)


def postings(documents: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index: (trigram, id, rk), for the trigrams asked for."""
    there = let(
        F.lower(F.col("text")), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t))
    )
    rows = documents.select("id", "rk", F.explode_outer(there).alias("trigram"))
    return rows.where(F.col("trigram").isNotNull()).select("trigram", "id", "rk")


def candidates(index: DataFrame, rules: list[SecretRule]) -> DataFrame:
    """(id, rk, kinds): the documents that fulfil a rule's query, and which."""
    spark = index.sparkSession
    asked = [
        (rule.kind, f"{rule.kind}{n}", len(clause), trigram)
        for rule in rules
        for n, clause in enumerate(trigram_query(rule.pattern))
        for trigram in sorted(clause)
    ]
    # one row per rule and trigram: a bound that the rules set, not the data
    queries = spark.createDataFrame(asked, "kind string, clause string, size int, trigram string")
    return (
        index.distinct().join(F.broadcast(queries), "trigram")
        .groupBy("id", "rk", "kind", "clause", "size").agg(F.count("*").alias("n"))
        .where("n = size")
        .groupBy("id", "rk").agg(F.collect_set("kind").alias("kinds"))
    )


def _spans(rows: DataFrame, rules: list[SecretRule], wanted) -> DataFrame:
    """(id, rk, copy, kind, start, end) of the matches, found by a match's and a gap's length."""

    def of(rule: SecretRule) -> Column:
        pattern = F.lit(rule.pattern)
        gaps = F.split(F.col("text"), rule.pattern, -1)
        lengths = F.transform(F.regexp_extract_all(F.col("text"), pattern, F.lit(rule.group)), F.length)
        whole = F.transform(F.regexp_extract_all(F.col("text"), pattern, F.lit(0)), F.length)
        found = let(
            gaps,
            lambda g: F.transform(
                F.arrays_zip(whole.alias("whole"), lengths.alias("part")),
                lambda m, i: F.struct(
                    F.lit(rules.index(rule)).alias("rule"),
                    i.alias("i"),
                    F.length(F.get(g, i)).cast("bigint").alias("gap"),
                    m["whole"].cast("bigint").alias("size"),
                    (m["part"] >= rule.least).alias("counts"),
                ),
            ),
        )
        empty = F.array().cast("array<struct<rule:int,i:int,gap:bigint,size:bigint,counts:boolean>>")
        return F.when(wanted(rule) & F.regexp_like(F.col("text"), pattern), found).otherwise(empty)

    arrays = reduce(lambda a, b: F.concat(a, b), [of(rule) for rule in rules])
    each = rows.select("id", "rk", F.explode_outer(arrays).alias("m")).where("m is not null").select("id", "rk", "m.*")
    each = each.dropDuplicates(["id", "rk", "rule", "i"])  # of repeated rows
    upto = Window.partitionBy("id", "rk", "rule").orderBy("i")
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(upto)).where("counts")
    names = F.array(*[F.lit(rule.kind) for rule in rules])
    return placed.select("id", "rk", F.get(names, F.col("rule")).alias("kind"), (F.col("end") - F.col("size")).alias("start"), "end")


def secret_spans(
    documents: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """One row per secret: (id, rk, kind, start, end), in code points, the end exclusive.

    Matches of a kind are leftmost and do not overlap. ``rk`` is a hash of the
    text and tells rows of a repeated id apart; of rows with equal id and text
    the spans are given once. NULL and empty texts have none. The whole text is
    read, however long.
    """
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    indexed = [rule for rule in rules if trigram_query(rule.pattern)]
    scanned = [rule for rule in rules if rule not in indexed]
    parts = []
    if indexed:
        trigrams = sorted({t for rule in indexed for clause in trigram_query(rule.pattern) for t in clause})
        index = written(postings(rows, trigrams), "trigram-index")
        found = written(candidates(index, indexed), "secret-candidates").select(
            F.col("id").alias("i"), F.col("rk").alias("r"), "kinds"
        )
        hits = rows.join(found, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")))
        parts.append(_spans(hits, indexed, lambda rule: F.array_contains("kinds", rule.kind)))
    if scanned:
        parts.append(_spans(rows, scanned, lambda rule: F.lit(True)))
    return reduce(DataFrame.unionByName, parts)


def secrets_by_document(
    documents: DataFrame, id: str = "doc_id", text: str = "text", rules: tuple[SecretRule, ...] = RULES
) -> DataFrame:
    """One row per document: id and ``spans``, an array of (start, kind, end) by start, then kind as the rules list them."""
    kinds = F.array(*[F.lit(rule.kind) for rule in rules])
    spans = (
        secret_spans(documents, id, text, rules)
        .withColumn("at", F.array_position(kinds, F.col("kind")))
        .groupBy("id", "rk")
        .agg(F.sort_array(F.collect_list(F.struct("start", "at", "kind", "end"))).alias("spans"))
        .select(F.col("id").alias("i"), F.col("rk").alias("r"), "spans")
    )
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"))
    none = F.array().cast(spans.schema["spans"].dataType)
    return rows.join(spans, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")), "left").select(
        F.col("id").alias(id), F.coalesce("spans", none).alias("spans")
    )
