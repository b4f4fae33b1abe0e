"""What a stage of the pipeline holds at a time does not grow with a batch of documents, or the square of a set's size."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from lakewarden.llm import jaccard
from lakewarden.llm.common import arrow_rows


def test_texts_are_rebuilt_without_python(spark):
    rows = [(1, "one line of words\nother\n"), (2, "other\nOne line, of words"), (3, None), (4, "new\n\none line of words\nlast\r\n")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    left = corpus_pipeline.line_dedup(spark, docs, "")
    assert {r.doc_id: r.text for r in left.collect()} == {1: rows[0][1], 3: None, 4: "new\n\nlast\r\n"}
    assert "Python" not in left._jdf.queryExecution().executedPlan().toString()


def test_tokens_are_taken_in_runs():
    sizes = [3, 0, 5, 12, 1, 1, 0]
    lists = pa.array([list(range(n)) for n in [9, *sizes]], pa.list_(pa.int64())).slice(1)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), lists], names=["id", "tokens"])
    runs = list(jaccard.sliced(batch, "tokens", 8))
    assert [x for run in runs for x in run.column("id").to_pylist()] == list(range(7))
    assert [x for run in runs for x in run.column("tokens").to_pylist()] == lists.to_pylist()
    assert all(run.num_rows == 1 or len(run.column("tokens").flatten()) <= 8 for run in runs)


def test_the_number_of_rows_is_given_back(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(KeyError), arrow_rows(spark, 7):
        assert spark.conf.get(name) == "7"
        raise KeyError
    assert spark.conf.get(name) == before


def test_pairs_of_frequent_tokens_are_bounded():
    """Long sets that have most tokens in common with many: before, all pairs of them were held."""
    draw = random.Random(5)
    common = [draw.getrandbits(60) for _ in range(5000)]
    sets = [np.array(sorted({*draw.sample(common, 4700), *(draw.getrandbits(60) for _ in range(draw.randint(0, 400)))}), np.int64) for _ in range(40)]
    tracemalloc.start()
    links = jaccard.prefix_join(sets, 0.8)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100_000_000
    forest = jaccard._Forest(len(sets))
    for x, y in links:
        forest.join(x, y)
    for x in range(len(sets)):
        for y in range(x):
            common = len(np.intersect1d(sets[x], sets[y]))
            if common >= 0.8 * (len(sets[x]) + len(sets[y]) - common):
                assert forest.root(x) == forest.root(y)
    assert links
