"""The pipeline's stages, each against brute force or an invariant on its own input."""

import re
from itertools import combinations

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lakewarden.llm.common import written
from lakewarden.llm.decontaminate import contamination
from lakewarden.llm.queries import QUERIES

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def steps(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        found.append(docs)
    return found


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_all_but_the_last_keep_the_columns(steps):
    for step in steps[1:-1]:
        assert step.dtypes == steps[0].dtypes
    for before, after in zip(steps[:-2], steps[1:-1]):
        assert texts(after).keys() <= texts(before).keys()


def test_quality_keeps_what_the_rules_keep(spark, small, steps):
    kept = {r.doc_id for r in QUERIES["op1_quality"](spark, small).collect() if r.kept}
    assert texts(steps[1]).keys() == kept and texts(steps[1]).items() <= texts(steps[0]).items()


def test_lines_only_disappear(steps):
    before, after = texts(steps[1]), texts(steps[2])
    for i, text in after.items():
        left = iter(before[i].split("\n"))
        assert all(line in left for line in text.split("\n"))
    lines = [" ".join(re.findall(r"[^\W_]+", x.lower())) for t in after.values() for x in t.split("\n")]
    counted = [x for x in lines if x]
    assert len(counted) == len(set(counted))
    assert all(r.n_chars == len(r.text) for r in steps[2].collect())


def test_one_of_each_group_of_near_duplicates(spark, steps):
    def shingles(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text.translate(LOWER))
        return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) > 4 else {tuple(words)} - {()}

    # of the raw documents, as line deduplication leaves few
    for source in (steps[0], steps[2]):
        sets = {i: shingles(t) for i, t in texts(source).items()}
        up = {i: i for i in sets}

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for x, y in combinations(sorted(sets), 2):
            a, b = sets[x], sets[y]
            if a and b and 10 * len(a & b) >= 8 * len(a | b):
                up[max(root(x), root(y))] = min(root(x), root(y))
        kept = corpus_pipeline.near_duplicates(spark, source, "")
        assert texts(kept).keys() == {i for i in sets if root(i) == i}


def test_no_benchmark_window_is_left(spark, small, steps):
    bench = spark.read.parquet(f"{small}/benchmark.parquet")
    found = {r.doc_id: r.contaminated for r in contamination(steps[3], bench).collect()}
    assert texts(steps[4]).keys() == {i for i, bad in found.items() if not bad}


def test_packing_holds_all_that_is_left(steps):
    assert {r.doc_id for r in steps[5].select("doc_id").distinct().collect()} == texts(steps[4]).keys()
    per = steps[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end"))
    assert per.where("n > 1024 or n != end").count() == 0


def test_run_is_the_stages_in_order(spark, small, steps):
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    rows = sorted(map(tuple, corpus_pipeline.run(spark, small).select(*columns).collect()))
    assert rows == sorted(map(tuple, steps[5].select(*columns).collect()))


def test_no_documents(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, small), name)
        assert docs.count() == 0
