"""Quality rules as a short-circuit cascade.

A document is rejected by the first rule that fails, and no later rule is
computed for it. What each rule costs and rejects is measured on a sample; the
rules are then ordered by new rejections per cost. The order decides only how
much work is done and which rule is named, never whether a document is kept.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, fresh, grams, let, occurrences_of, words_by, written

WINDOW = 5

#: What a rule may ask of a text, each an expression of its own
Measure = Callable[[Column], Column]


def _n_repeat(words: Column) -> Column:
    """Words inside windows of five that occur more than once."""

    def covered(starts: Column) -> Column:
        steps = F.transform(starts, lambda at, k: F.least(F.lit(WINDOW), F.coalesce(at - F.get(starts, k - 1), F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("bigint"), lambda total, step: total + step)

    def repeated(found: Column) -> Column:  # sorted by hash, so equal ones are neighbours
        again = F.filter(
            found,
            lambda x, i: F.coalesce(x.h == F.get(found, i - 1).h, F.lit(False))
            | F.coalesce(x.h == F.get(found, i + 1).h, F.lit(False)),
        )
        return let(F.sort_array(F.transform(again, lambda x: x.i)), covered)

    def of(hashes: Column) -> Column:
        placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
        alike = F.size(F.array_distinct(hashes)) == F.size(hashes)
        return F.when(alike, F.lit(0).cast("bigint")).otherwise(let(F.sort_array(placed), repeated))

    return let(grams(words, WINDOW), of)


def _lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n", -1), lambda line: F.length(F.btrim(line, F.lit(" \t\n\x0b\f\r"))) > 0)


def _filled(text: Column) -> Column:
    return F.coalesce(text, F.lit(""))


def _of_words(body: Callable[[Column], Column]) -> Measure:
    return lambda text: let(words_by(text, SPACES), body)


MEASURES: dict[str, Measure] = {
    "n_words": _of_words(lambda w: F.size(w).cast("bigint")),
    "word_chars": _of_words(lambda w: F.length(F.array_join(w, "")).cast("bigint")),
    "n_symbols": lambda text: occurrences_of(_filled(text), "#*$%&|<>"),
    "n_lines": lambda text: F.size(_lines(_filled(text))).cast("bigint"),
    "n_dup_lines": lambda text: let(_lines(_filled(text)), lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")),
    "n_capitals": lambda text: occurrences_of(_filled(text), r"\p{Lu}"),
    "n_repeat_words": _of_words(_n_repeat),
}


@dataclass(frozen=True)
class Rule:
    """Rejects a document when ``fails`` of its measures is true. Must not be NULL."""

    name: str
    fails: Callable[[Callable[[str], Column]], Column]


#: The two base rules, and those of published web-text filters at thresholds far from running text
RULES = (
    Rule("too_few_words", lambda m: m("n_words") < 10),
    Rule("repeated_windows", lambda m: 100 * m("n_repeat_words") > 20 * m("n_words")),
    Rule("symbols", lambda m: 100 * m("n_symbols") > 20 * m("n_words")),
    Rule("repeated_lines", lambda m: 100 * m("n_dup_lines") > 30 * m("n_lines")),
    Rule("capitals", lambda m: 100 * m("n_capitals") > 50 * m("word_chars")),
    Rule("word_length", lambda m: (m("word_chars") < 2 * m("n_words")) | (m("word_chars") > 20 * m("n_words"))),
)
BASE = ("too_few_words", "repeated_windows")


def of_text(text: Column) -> Callable[[str], Column]:
    """Measures computed where a rule needs them."""
    return lambda name: MEASURES[name](text)


def measured(documents: DataFrame, text: str = "text", names: tuple[str, ...] = tuple(MEASURES)) -> DataFrame:
    """The documents with one struct column ``measures``; the words are split once."""
    col = F.col(text)
    by_words = {
        "n_words": lambda w: F.size(w).cast("bigint"),
        "word_chars": lambda w: F.length(F.array_join(w, "")).cast("bigint"),
        "n_repeat_words": _n_repeat,
    }
    shared = let(words_by(col, SPACES), lambda w: F.struct(*[f(w).alias(k) for k, f in by_words.items()]))
    by_lines = let(
        _lines(_filled(col)),
        lambda x: F.struct(
            F.size(x).cast("bigint").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines")
        ),
    )
    w, x = fresh([documents], "of_words"), fresh([documents], "of_lines")
    both = documents.withColumns({w: shared, x: by_lines})
    place = {**{k: F.col(w)[k] for k in by_words}, "n_lines": F.col(x)["n_lines"], "n_dup_lines": F.col(x)["n_dup_lines"]}
    fields = [place.get(name, MEASURES[name](col)).alias(name) for name in names]
    return both.withColumn(fresh([documents], "measures"), F.struct(*fields)).drop(w, x)


def cascade_order(
    documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = 2000, seed: int = 7
) -> list[Rule]:
    """The rules by new rejections per second, measured on about ``sample_rows`` documents.

    Of an empty table the given order is returned.
    """
    total = documents.count()
    if not total:
        return list(rules)
    sample = written(
        documents.select(F.col(text).alias("text")).sample(fraction=min(1.0, sample_rows / total), seed=seed), "quality-sample"
    )
    measure = of_text(F.col("text"))
    cost = {}
    for rule in rules:
        job = sample.agg(F.count(F.when(rule.fails(measure), 1)))
        job.collect()  # compiles its code
        start = time.perf_counter()
        job.collect()
        cost[rule.name] = time.perf_counter() - start
    flags = sample.groupBy(*[rule.fails(measure).alias(rule.name) for rule in rules]).agg(F.count("*").alias("n"))
    patterns = [(row, row["n"]) for row in flags.collect()]  # at most 2 ** len(rules)
    left, order = list(rules), []
    while left:
        best = max(left, key=lambda r: (sum(n for row, n in patterns if row[r.name]) / cost[r.name], -rules.index(r)))
        order.append(best)
        left.remove(best)
        patterns = [(row, n) for row, n in patterns if not row[best.name]]
    return order


def first_failed(order: list[Rule], measure: Callable[[str], Column]) -> Column:
    """The name of the first rule that rejects, or NULL. CASE computes no rule beyond it."""
    verdict = F
    for rule in order:
        verdict = verdict.when(rule.fails(measure), F.lit(rule.name))
    return verdict.otherwise(F.lit(None).cast("string"))


def quality(documents: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, **options) -> DataFrame:
    """The documents, all columns, with ``rejected_by``: a rule's name, or NULL for kept ones.

    NULL and empty texts have no words and are rejected. Repeated rows are
    judged alike. If a column ``rejected_by`` exists, the new one is named
    ``rejected_by_``.
    """
    order = cascade_order(documents, text, rules, **options)
    name = fresh([documents], "rejected_by")
    return documents.withColumn(name, first_failed(order, of_text(F.col(text))))


def keep_good(documents: DataFrame, text: str = "text", **options) -> DataFrame:
    """The documents that no rule rejects, with their columns as they are."""
    name = fresh([documents], "rejected_by")
    return quality(documents, text, **options).where(F.col(name).isNull()).drop(name)
