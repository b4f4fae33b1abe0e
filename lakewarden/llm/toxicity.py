"""Toxic spans by a linear-chain conditional random field.

The field labels each word of a text 0 or 1. What it sees of a word is the word
stem from a learnt lexicon that the word begins with, or none. It is fitted by
maximum likelihood, with forward-backward passes, on words of labelled
documents: those with a lexicon stem are labelled 1 in toxic documents, all
words of other documents 0. A document's score is a logistic function of its
words' marginals. Between lexicon words lie runs of words that look alike to the
field; they enter as powers of one matrix, so long texts cost little.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ship, written

WORD = re.compile(r"[^\W\d_]+")
#: Stems are word beginnings of these many characters; shorter words count whole
STEM_SIZES = tuple(range(3, 10))


def _trie_pattern(stems: list[str]) -> re.Pattern | None:
    """Matches a stem at the start of a word, the longest first."""
    if not stems:
        return None
    tree: dict = {}
    for stem in stems:
        node = tree
        for letter in stem:
            node = node.setdefault(letter, {})
        node[""] = {}

    def spelled(node: dict) -> str:
        options = [re.escape(letter) + spelled(child) for letter, child in sorted(node.items()) if letter]
        if not options:
            return ""
        joined = options[0] if len(options) == 1 and "" not in node else "(?:" + "|".join(options) + ")"
        return joined + "?" * ("" in node)

    # a letter class first: most word starts fail at once
    first = "".join(sorted({re.escape(s[0]) for s in stems}))
    return re.compile(rf"(?<![^\W\d_])(?=[{first}])({spelled(tree)})[^\W\d_]*")


@dataclass
class Model:
    """A fitted field: stems and their weights for label 1, transitions, and the document layer."""

    stems: list[str]
    weights: np.ndarray  # of no stem, then of each stem
    into: float = 0.0  # 0 -> 1
    out: float = 0.0  # 1 -> 0
    stay: float = 0.0  # 1 -> 1
    layer: np.ndarray = field(default_factory=lambda: np.zeros(4))
    center: np.ndarray = field(default_factory=lambda: np.zeros(3))
    scale: np.ndarray = field(default_factory=lambda: np.ones(3))

    def __post_init__(self):
        self.pattern = _trie_pattern(self.stems)
        self.number = {stem: n for n, stem in enumerate(self.stems, 1)}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("pattern", "number")}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    def observed(self, text: str) -> tuple[list[tuple[int, int, int]], list[int], int]:
        """The lexicon words (class, start, end), the number of other words before each and after the last, and all words."""
        low = text.lower()
        if len(low) != len(text):  # a few capitals have longer lower cases: keep the offsets
            low = "".join(c.lower() if len(c.lower()) == 1 else c for c in text)
        found, gaps, at = [], [], 0
        if self.pattern is not None:
            for m in self.pattern.finditer(low):
                gaps.append(_count_words(low[at : m.start()]))
                found.append((self.number[m.group(1)], m.start(), m.end()))
                at = m.end()
        gaps.append(_count_words(low[at:]))
        return found, gaps, sum(gaps) + len(found)

    def marginals(self, classes: list[int], gaps: list[int]) -> np.ndarray:
        """P(label 1) of each lexicon word, by forward-backward with matrix powers over the gaps."""
        step = np.exp(np.array([[0.0, self.into], [self.out, self.stay]]))
        other = step * np.array([1.0, np.exp(self.weights[0])])
        values, vectors = np.linalg.eig(other)
        inverse = np.linalg.inv(vectors)
        top = np.abs(values).max()

        def run(n: int) -> np.ndarray:  # the scale cancels out
            return np.real(vectors * (values / top) ** n @ inverse)

        n = len(classes)
        emit = np.stack([np.ones(n), np.exp(self.weights[classes])], axis=1)
        forward, message = np.empty((n, 2)), np.array([1.0, 0.0])  # before the text is label 0
        for i in range(n):
            message = (message @ run(gaps[i]) @ step) * emit[i]
            message = message / message.sum()
            forward[i] = message
        backward, message = np.empty((n, 2)), np.ones(2)
        message = run(gaps[n]) @ message
        for i in reversed(range(n)):
            backward[i] = message / message.sum()
            message = run(gaps[i]) @ (step @ (emit[i] * backward[i]))
        both = forward * backward
        return both[:, 1] / both.sum(axis=1)

    def features(self, marginals: np.ndarray, n_words: int) -> np.ndarray:
        total = float(marginals.sum()) if len(marginals) else 0.0
        most = float(marginals.max()) if len(marginals) else 0.0
        return np.array([most, np.log1p(total), np.log((total + 0.1) / (n_words + 20.0))])

    def score(self, features: np.ndarray) -> float:
        z = self.layer[0] + ((features - self.center) / self.scale) @ self.layer[1:]
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _count_words(text: str) -> int:
    return len(text.split())


def _choose_stems(rows: list, n_toxic: int, n_clean: int, max_stems: int) -> list[str]:
    """Stems far likelier in toxic documents; of nested ones the clearest, then the longest."""
    rated, rate = [], n_toxic / (n_toxic + n_clean)
    for stem, toxic, clean in rows:
        both = toxic + clean
        # the log-likelihood ratio against toxic documents holding it no oftener than others: 30 is chance in 1 of 10 million
        ratio = 2 * toxic * np.log(toxic / (both * rate)) + (2 * clean * np.log(clean / (both * (1 - rate))) if clean else 0.0)
        if ratio >= 30:
            rated.append((-round(float(ratio), 9), -len(stem), stem))
    clear = {stem: -z for z, _, stem in rated}
    chosen: list[str] = []
    for z, _, stem in sorted(rated):
        if len(chosen) < max_stems and not any(stem.startswith(c) or c.startswith(stem) for c in chosen):
            # the longest that is nearly as clear: it meets fewer words by chance
            chosen.append(max((s for s in clear if s.startswith(stem) and clear[s] >= -0.9 * z), key=lambda s: (len(s), clear[s])))
    return sorted(chosen)


def _fit_field(sequences: list[tuple[tuple[int, ...], bool, int]], n_classes: int, rounds: int) -> tuple[np.ndarray, ...]:
    """Weights and transitions by gradient ascent on the likelihood; sequences: (classes, toxic, how often)."""
    width = max(len(s) for s, _, _ in sequences)
    x = np.zeros((len(sequences), width), np.int64)
    there = np.zeros((len(sequences), width))
    toxic = np.array([t for _, t, _ in sequences])
    often = np.array([n for _, _, n in sequences], float)
    for row, (s, _, _) in enumerate(sequences):
        x[row, : len(s)] = s
        there[row, : len(s)] = 1
    y = (x > 0) & toxic[:, None]
    scale = often.sum()

    def expected(weights, trans):
        """Marginals of words, and of pairs (0,1), (1,0), (1,1) in a row; before the text is label 0."""
        step = np.exp(np.array([[0.0, trans[0]], [trans[1], trans[2]]]))
        emit = np.stack([np.ones(x.shape), np.exp(weights[x])], axis=2)
        emit = np.where(there[:, :, None] > 0, emit, 1.0)
        forward, norm = np.empty((*x.shape, 2)), np.empty(x.shape)
        message = np.tile([1.0, 0.0], (len(x), 1))
        for t in range(width):
            new = (message @ step) * emit[:, t]
            norm[:, t] = new.sum(axis=1)
            message = np.where(there[:, t : t + 1] > 0, new / norm[:, t : t + 1], message)
            forward[:, t] = message
        backward = np.ones((*x.shape, 2))
        for t in range(width - 2, -1, -1):
            new = (backward[:, t + 1] * emit[:, t + 1]) @ step.T / norm[:, t + 1 : t + 2]
            backward[:, t] = np.where(there[:, t + 1 : t + 2] > 0, new, 1.0)
        one = forward[:, :, 1] * backward[:, :, 1] / (forward * backward).sum(axis=2) * there
        before = np.concatenate([np.tile([1.0, 0.0], (len(x), 1, 1)), forward[:, :-1]], axis=1)
        pair = before[:, :, :, None] * step[None, None] * (emit * backward)[:, :, None, :]
        pair = pair / pair.sum(axis=(2, 3), keepdims=True) * there[:, :, None, None]
        return one, pair

    seen = np.zeros(n_classes)
    np.add.at(seen, x[y], np.repeat(often, y.sum(axis=1)))
    prior = np.concatenate([np.zeros((len(x), 1), bool), y[:, :-1]], axis=1)
    inside = there > 0
    real = np.array([((~prior & y & inside) * often[:, None]).sum(), ((prior & ~y & inside) * often[:, None]).sum(), ((prior & y & inside) * often[:, None]).sum()])
    weights, trans = np.full(n_classes, 0.0), np.array([-1.0, 0.0, 0.0])
    weights[0] = -4.0
    mean, square, penalty = np.zeros(n_classes + 3), np.zeros(n_classes + 3), 0.02 / max(scale, 1)
    for k in range(1, rounds + 1):
        one, pair = expected(weights, trans)
        guess = np.zeros(n_classes)
        np.add.at(guess, x.ravel(), (one * often[:, None]).ravel())
        flow = (pair * often[:, None, None, None]).sum(axis=(0, 1))
        slope = np.concatenate([seen - guess, real - np.array([flow[0, 1], flow[1, 0], flow[1, 1]])]) / scale
        slope -= penalty * np.concatenate([weights, trans])
        mean, square = 0.8 * mean + 0.2 * slope, 0.95 * square + 0.05 * slope**2
        move = 0.4 * (mean / (1 - 0.8**k)) / (np.sqrt(square / (1 - 0.95**k)) + 1e-9) / np.sqrt(1 + k / 10)
        weights, trans = weights + move[:n_classes], trans + move[n_classes:]
    return weights, trans


def _fit_layer(features: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression by Newton's method with a small ridge."""
    center, scale = features.mean(axis=0), features.std(axis=0) + 1e-9
    design = np.concatenate([np.ones((len(features), 1)), (features - center) / scale], axis=1)
    beta, ridge = np.zeros(design.shape[1]), np.diag([1e-6, *[0.1] * features.shape[1]])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        bend = design.T @ (design * (p * (1 - p))[:, None]) + ridge
        beta = beta + np.linalg.solve(bend, design.T @ (labels - p) - ridge @ beta)
    return beta, center, scale


def train(
    documents: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", label: str = "toxic",
    train_rows: int = 6000, max_stems: int = 500, rounds: int = 120, seed: int = 11,
) -> Model:
    """Fits a model on about ``train_rows`` labelled documents.

    Rows without a label or text are left out; an id labelled more than once is
    toxic if any label says so. Without toxic and clean rows the model has no
    stems and scores every text alike.
    """
    spark = documents.sparkSession
    ship(spark)
    known = (
        labels.select(F.col(id).alias("i"), F.col(label).alias("toxic")).where("toxic is not null")
        .groupBy("i").agg((F.max(F.col("toxic").cast("int")) > 0).alias("toxic"))
    )
    total = known.count()
    if total > train_rows:  # by a hash of the id, so the sample is the same in every run
        known = known.where(F.pmod(F.xxhash64(F.col("i"), F.lit(seed)), F.lit(1_000_000)) < int(1e6 * train_rows / total))
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text")).where("text is not null")
    sample = written(rows.join(known, F.col("id") == F.col("i")).select("text", "toxic"), "toxic-train")
    sizes = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    if not n_toxic or not n_clean:
        return Model([], np.array([-4.0]))
    words = sample.select(
        "toxic", F.monotonically_increasing_id().alias("row"),
        F.explode_outer(F.array_distinct(F.split(F.lower("text"), r"[^\p{L}]+", -1))).alias("word"),
    )
    stems = (
        words.where(F.length("word") >= STEM_SIZES[0])
        .select("row", "toxic", F.explode_outer(F.array(*[F.left(F.col("word"), F.lit(n)) for n in STEM_SIZES])).alias("stem"))
        .distinct()
        .groupBy("stem")
        .agg(F.count(F.when(F.col("toxic"), 1)).alias("n1"), F.count(F.when(~F.col("toxic"), 1)).alias("n0"))
        .where((F.col("n1") >= 5) & (F.col("n1") * n_clean >= 7 * F.col("n0") * n_toxic))
    )
    model = Model(_choose_stems(stems.collect(), n_toxic, n_clean, max_stems), np.array([-4.0]))
    if not model.stems:
        return model

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Each line as a run of classes; equal runs are counted, as most hold no stem."""
        for batch in batches:
            counted: dict[tuple, int] = {}
            for body, toxic in zip(batch["text"], batch["toxic"], strict=True):
                for line in body.split("\n"):
                    found, gaps, n = model.observed(line)
                    if n:
                        run = [0] * gaps[0]
                        for (c, _, _), gap in zip(found, gaps[1:], strict=True):
                            run += [c] + [0] * gap
                        for at in range(0, len(run), 200):
                            key = (tuple(run[at : at + 200]), bool(toxic))
                            counted[key] = counted.get(key, 0) + 1
            yield pd.DataFrame({"run": [list(k[0]) for k in counted], "toxic": [k[1] for k in counted], "n": list(counted.values())})

    grouped = sample.mapInPandas(lines, "run array<int>, toxic boolean, n bigint").groupBy("run", "toxic").agg(F.sum("n").alias("n"))
    sequences = [(tuple(r["run"]), r["toxic"], r["n"]) for r in grouped.collect()]  # of the bounded sample
    weights, trans = _fit_field(sequences, len(model.stems) + 1, rounds)
    model.weights, (model.into, model.out, model.stay) = weights, map(float, trans)
    model.layer = np.zeros(4)
    judged = _scored(sample, model, ["toxic"]).select("toxic", "features").toPandas()
    features = np.array(judged["features"].tolist(), float)
    model.layer, model.center, model.scale = _fit_layer(features, judged["toxic"].to_numpy(float))
    return model


def _scored(rows: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns to keep, with score, features, and spans."""
    ship(rows.sparkSession)
    schema = T.StructType([
        *[rows.schema[c] for c in keep],
        T.StructField("score", T.DoubleType()),
        T.StructField("features", T.ArrayType(T.DoubleType())),
        T.StructField("starts", T.ArrayType(T.LongType())),
        T.StructField("ends", T.ArrayType(T.LongType())),
        T.StructField("chances", T.ArrayType(T.DoubleType())),
    ])

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for body in batch["text"]:
                found, gaps, n = model.observed(body or "")
                chances = model.marginals([c for c, _, _ in found], gaps) if found else np.zeros(0)
                features = model.features(chances, n)
                out.append((model.score(features), features.tolist(), [s for _, s, _ in found], [e for _, _, e in found], chances.tolist()))
            frame = batch[keep].reset_index(drop=True)
            for name, values in zip(schema.names[len(keep) :], zip(*out, strict=True), strict=True):
                frame[name] = list(values)
            yield frame

    return rows.select(*keep, F.coalesce("text", F.lit("")).alias("text")).mapInPandas(judge, schema)


def toxicity(documents: DataFrame, model: Model, id: str = "doc_id", text: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id, score, and ``spans`` (start, end, chance) of words with a marginal of ``least`` or more.

    NULL and empty texts have no words and get the score of such a text. Only
    the text is read. Offsets are code points, ends exclusive.
    """
    rows = documents.select(F.col(id).alias("id"), F.col(text).alias("text"))
    spans = F.filter(
        F.transform(
            F.arrays_zip("starts", "ends", "chances"),
            lambda s: F.struct(s["starts"].alias("start"), s["ends"].alias("end"), s["chances"].alias("chance")),
        ),
        lambda s: s["chance"] >= least,
    )
    return _scored(rows, model, ["id"]).select(F.col("id").alias(id), "score", spans.alias("spans"))
