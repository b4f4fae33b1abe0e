"""Licence scan: a paragraph classifier, confirmed by comparison with templates.

A multinomial logistic regression with an L1 penalty is trained on paragraphs
drawn from licence templates and on a bounded sample of the corpus's own
paragraphs as class ``unknown``. Its features are all word 1- to 3-grams of the
templates. A line is looked at whole if enough of its word pairs stand in the
templates, and besides in passages: runs of template word pairs with few others
between, so a notice counts whatever stands around it on its line. Neither
depends on the sample. A temperature fitted on held-out paragraphs calibrates
the probabilities. A prediction is confirmed if enough of the words in their
order stand in a template of the family.

Everything runs as DataFrame expressions; the fitted weights are literals.
"""

from __future__ import annotations

import math
import random
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, written

UNKNOWN = "unknown"

#: Other words' pairs that a passage may hold between two of the templates: those of one changed word
BETWEEN = 2
#: Pairs that a passage has at least: the least that are 0.6 of the shortest templates' four
LEAST_PAIRS = 3

# Notices by which the families are commonly declared
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
    ),
    "bsd": (
        "Released under the BSD 3-Clause License.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    ),
    "mpl-2.0": (
        "Licensed under the Mozilla Public License, Version 2.0.",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    ),
    "proprietary": (
        "All rights reserved. No part of this publication may be reproduced without prior written permission.",
        "Copyright. All rights reserved. Proprietary and confidential.",
    ),
}


def words_of(text: Column) -> Column:
    """Lower-case words of letters, digits and inner dots or hyphens."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def word_grams(words: Column, most: int = 3) -> Column:
    """All 1- to ``most``-grams, joined by spaces."""

    def run(w: Column, n: int) -> Column:
        joined = F.transform(F.sequence(F.lit(0), F.size(w) - n), lambda i: F.concat_ws(" ", *[F.get(w, i + k) for k in range(n)]))
        return F.when(F.size(w) >= n, joined).otherwise(F.array().cast("array<string>"))

    def of(w: Column) -> Column:
        return F.concat(*[run(w, n) for n in range(1, most + 1)])

    return let(words, of)


@dataclass
class Model:
    """Weights by feature, intercepts and the temperature."""

    families: list[str]
    weights: dict[str, list[float]]
    intercepts: list[float]
    temperature: float


def _variants(text: str, draw: random.Random) -> str:
    """A template as people alter it: a part of it, other case, words lost, words around it."""
    words = text.split()
    if len(words) > 14 and draw.random() < 0.5:
        size = draw.randint(10, len(words))
        at = draw.randint(0, len(words) - size)
        words = words[at : at + size]
    words = [w for w in words if len(words) < 6 or draw.random() > 0.05]
    body = " ".join(words)
    case = draw.random()
    body = body.upper() if case < 0.1 else body.lower() if case < 0.3 else body
    return draw.choice(["", "", "* ", "// ", "# ", "Note: "]) + body


def train(
    documents: DataFrame, text: str = "text", background_rows: int = 2000, copies: int = 12, penalty: float = 0.0002, seed: int = 5
) -> Model:
    """Fits the classifier on ``copies`` variants of each template and the lines of about ``background_rows`` documents.

    Lines of the sample that share a three-gram with a template are left out, as
    they may be licences. Of an empty table the background is empty lines.
    """
    spark = documents.sparkSession
    draw = random.Random(seed)
    families = sorted(TEMPLATES)
    variants = [
        (_variants(body, draw), families.index(family), n % 4 == 0)
        for family in families for body in TEMPLATES[family] for n in range(copies)
    ]
    plain = [(body, families.index(family), False) for family in families for body in TEMPLATES[family]]
    mine = spark.createDataFrame(variants + plain, "line string, label int, held boolean")
    mine = mine.select(word_grams(words_of(F.col("line"))).alias("grams"), "label", "held")
    total = documents.count()
    sample = documents.select(F.col(text).alias("text")).sample(fraction=min(1.0, background_rows / max(total, 1)), seed=seed)
    lines = sample.select(F.explode_outer(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    lines = lines.select(words_of(F.coalesce("line", F.lit(""))).alias("words"))
    lines = lines.union(lines.select(F.explode_outer(_passages(F.col("words")))).where("col is not null"))
    lines = lines.select(word_grams(F.col("words")).alias("grams"))
    telling = sorted({" ".join(g) for body, _, _ in plain for g in _python_grams(body, 3)})
    # at most as many as the templates have, so the literal is bounded by this module
    overlap = F.arrays_overlap("grams", F.array(*map(F.lit, telling)))
    lines = written(lines.where(~F.coalesce(overlap, F.lit(False))), "licence-background")
    vocabulary = sorted({" ".join(g) for body, _, _ in plain for n in (1, 2, 3) for g in _python_grams(body, n)})
    words = [v for v in vocabulary if " " not in v]
    features = vocabulary
    seen = F.array_intersect("grams", F.array(*map(F.lit, features)))
    # lines without a feature are all alike: they count by weight
    alike = lines.select(seen.alias("grams")).groupBy("grams").agg(F.count("*").alias("weight"))
    alike = alike.select("grams", F.lit(len(families)).alias("label"), F.lit(False).alias("held"), F.least("weight", F.lit(len(variants))).cast("double").alias("weight"))
    # half a licence is none: single words in other company are unknown
    lone = spark.createDataFrame([([w], len(families), False, 1.0) for w in words], alike.schema)
    rows = mine.select(seen.alias("grams"), "label", "held", F.lit(1.0).alias("weight")).unionByName(alike).unionByName(lone)
    rows = written(rows.withColumn("label", F.col("label").cast("double")), "licence-train")
    vectors = CountVectorizerModel.from_vocabulary(features, inputCol="grams", outputCol="features")
    vectors.setBinary(True)
    data = vectors.transform(rows).coalesce(1)
    fit = LogisticRegression(
        family="multinomial", regParam=penalty, elasticNetParam=0.5, weightCol="weight", maxIter=60, standardization=False
    ).fit(data.where("not held"))
    matrix, intercepts = fit.coefficientMatrix.toArray(), [float(x) for x in fit.interceptVector.toArray()]
    weights = {f: [float(x) for x in matrix[:, k]] for k, f in enumerate(features) if abs(matrix[:, k]).max() > 1e-6}
    # one temperature for all classes, the likeliest on the held-out variants
    held = [(r["grams"], int(r["label"])) for r in rows.where("held").select("grams", "label").collect()]

    def loss(t: float) -> float:
        out = 0.0
        for grams_, label in held:
            z = [(i + sum(weights[g][k] for g in grams_ if g in weights)) / t for k, i in enumerate(intercepts)]
            top = max(z)
            out += math.log(sum(math.exp(x - top) for x in z)) + top - z[label]
        return out

    temperature = min((0.25 * 1.15**k for k in range(24)), key=loss)
    return Model([*families, UNKNOWN], weights, intercepts, temperature)


def _python_grams(text: str, n: int) -> list[tuple[str, ...]]:
    words = re.findall(r"[^\W_]+(?:[.-][^\W_]+)*", text.lower())
    return [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]


def _pairs(family: str | None = None) -> list[str]:
    """The word pairs of a family's templates, or of all."""
    bodies = TEMPLATES[family] if family else [body for bodies in TEMPLATES.values() for body in bodies]
    return sorted({" ".join(g) for body in bodies for g in _python_grams(body, 2)})


def _pair(words: Column, i: Column) -> Column:
    return F.concat_ws(" ", F.get(words, i), F.get(words, i + 1))


def _known(words: Column) -> Column:
    """The positions, in order, of word pairs that stand in a template."""
    every = _pairs()
    places = F.when(F.size(words) >= 2, F.sequence(F.lit(0), F.size(words) - 2)).otherwise(F.array().cast("array<int>"))
    firsts = sorted({p.split(" ")[0] for p in every})
    return F.filter(places, lambda i: F.get(words, i).isin(firsts) & _pair(words, i).isin(every))


def _own_pairs(words: Column) -> Column:
    own = F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: _pair(words, i))
    return F.when(F.size(words) >= 2, F.array_distinct(own)).otherwise(F.array().cast("array<string>"))


def _passages(words: Column) -> Column:
    """The words of each run of at least LEAST_PAIRS known pairs: with no others, and with at most BETWEEN between two."""

    def far(known: Column, p: Column, other: Column, between: int) -> Column:
        return F.coalesce(F.abs(F.get(known, other) - p) > between + 1, F.lit(True))

    def runs(known: Column, between: int) -> Column:
        starts = F.filter(F.transform(known, lambda p, j: F.struct(p.alias("p"), j.alias("j"))), lambda x: far(known, x.p, x.j - 1, between))
        ends = F.filter(F.transform(known, lambda p, j: F.struct(p.alias("p"), j.alias("j"))), lambda x: far(known, x.p, x.j + 1, between))
        both = F.zip_with(starts, ends, lambda s, e: F.struct(s.p.alias("s"), e.p.alias("e"), (e.j - s.j).alias("n")))
        return F.transform(F.filter(both, lambda x: x.n + 1 >= LEAST_PAIRS), lambda x: F.slice(words, x.s + 1, x.e - x.s + 2))

    return let(_known(words), lambda known: F.array_distinct(F.concat(runs(known, 0), runs(known, BETWEEN))))


def licence_paragraphs(
    documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text", least: float = 0.5, confirm: float = 0.6
) -> DataFrame:
    """(id, rk, line, family, probability, likeness, confirmed): the families that the classifier gives a line, or passages of it.

    ``probability`` is calibrated and at least ``least``; ``likeness`` is the
    share of the line's or passage's word pairs that stand in a template of the
    family, and it is confirmed if that is at least ``confirm``; of a family's
    passages the likeliest counts. Looked at are whole lines of which so many
    pairs stand in any template, and passages. Lines are numbered from 0. NULL,
    empty and blank texts have none; of rows equal in id and text (``rk`` is
    its hash) each gives its lines.
    """
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    spark = documents.sparkSession
    families = model.families[:-1]
    lines = rows.select("id", "rk", F.posexplode_outer(F.split("text", "\n", -1)).alias("line", "body"))
    every = F.array(*map(F.lit, _pairs()))

    def looked_at(words: Column) -> Column:
        whole = let(_own_pairs(words), lambda own: F.size(F.array_intersect(own, every)) >= confirm * F.greatest(F.size(own), F.lit(1)))
        return F.concat(F.when(whole, F.array(words)).otherwise(F.array().cast("array<array<string>>")), _passages(words))

    # no filter on the lines' pieces: Spark would make words and pieces again in it, words once for each use
    pieces = lines.select("id", "rk", "line", F.monotonically_increasing_id().alias("place"), let(words_of(F.col("body")), looked_at).alias("pieces"))
    looked = pieces.select("id", "rk", "line", "place", F.posexplode_outer("pieces").alias("piece", "words")).where("words is not null")
    looked = written(looked.withColumn("row", F.monotonically_increasing_id()), "licence-lines")
    score = spark.createDataFrame([(f, w) for f, w in model.weights.items()], "gram string, weights array<double>")  # bounded by the templates
    grams_ = looked.select("row", F.explode_outer(F.array_distinct(word_grams(F.col("words")))).alias("gram"))
    sums = (
        grams_.join(F.broadcast(score), "gram").groupBy("row")
        .agg(*[F.sum(F.col("weights")[k]).alias(f"z{k}") for k in range(len(model.families))])
    )
    z = F.array(*[(F.col(f"z{k}") + i) / model.temperature for k, i in enumerate(model.intercepts)])
    best = sums.select("row", z.alias("z")).withColumn("top", F.array_max("z"))
    chance = 1 / F.aggregate("z", F.lit(0.0), lambda total, x: total + F.exp(x - F.col("top")))
    best = best.select("row", (F.array_position("z", F.col("top")) - 1).cast("int").alias("k"), chance.alias("probability"))
    known = spark.createDataFrame([(k, f, _pairs(f)) for k, f in enumerate(families)], "k int, family string, pairs array<string>")
    found = best.where(F.col("probability") >= least).join(F.broadcast(known), "k").join(looked, "row")
    own = _own_pairs(F.col("words"))
    likeness = F.size(F.array_intersect(own, F.col("pairs"))) / F.greatest(F.size(own), F.lit(1))
    found = found.select("id", "rk", "line", "place", "family", "probability", likeness.alias("likeness"))
    likeliest = found.groupBy("place", "id", "rk", "line", "family").agg(F.max(F.struct("likeness", "probability")).alias("x"))
    return likeliest.select("id", "rk", "line", "family", "x.probability", "x.likeness", (F.col("x.likeness") >= confirm).alias("confirmed"))


def licences(documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row per document: id, families (confirmed, sorted), n_confirmed, n_predicted lines."""
    found = licence_paragraphs(documents, model, id, text, **options).dropDuplicates(["id", "rk", "line", "family"])
    per = found.groupBy(F.col("id").alias("i"), F.col("rk").alias("r")).agg(
        F.sort_array(F.collect_set(F.when(F.col("confirmed"), F.col("family")))).alias("families"),
        F.count_distinct(F.when(F.col("confirmed"), F.col("line"))).alias("n_confirmed"),
        F.count_distinct("line").alias("n_predicted"),
    )
    rows = documents.select(F.col(id).alias("id"), F.xxhash64(F.col(text)).alias("rk"))
    joined = rows.join(per, F.col("id").eqNullSafe(F.col("i")) & (F.col("rk") == F.col("r")), "left")
    return joined.select(
        F.col("id").alias(id),
        F.coalesce("families", F.array().cast("array<string>")).alias("families"),
        F.coalesce("n_confirmed", F.lit(0)).alias("n_confirmed"),
        F.coalesce("n_predicted", F.lit(0)).alias("n_predicted"),
    )
