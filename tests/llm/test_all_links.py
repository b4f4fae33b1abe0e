"""No link is lost, neither by the stage nor by the query."""

import random

import corpus_pipeline
from lakewarden.llm.queries import QUERIES


def test_every_line_just_alike_enough_goes(spark, tmp_path):
    draw, rows = random.Random(11), []
    for n in (10, 20, 30, 60, 100) * 30:
        words = [f"w{draw.getrandbits(40)}" for _ in range(n)]
        places = set(draw.sample(range(n), n // 10))
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(f"x{draw.getrandbits(40)}" if k in places else w for k, w in enumerate(words)))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    left = {r.doc_id for r in corpus_pipeline.line_dedup(spark, docs, str(tmp_path)).collect()}
    assert left == set(range(0, len(rows), 2))
    got = {r.doc_id: r.n_removed_lines for r in QUERIES["op3_lines"](spark, str(tmp_path)).collect()}
    assert got == {n: n % 2 for n in range(len(rows))}
