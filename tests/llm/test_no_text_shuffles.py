"""Stages of the pipeline that drop a few documents do not shuffle the texts of all."""

from lakewarden.llm.decontaminate import decontaminate
from lakewarden.llm.jaccard import one_of_each


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_few_documents_are_dropped_by_a_broadcast(spark):
    """Spark takes the tables for larger than they are: at 0.5 GB all texts were shuffled and sorted to drop a thirtieth of them."""
    said = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, said), (2, said + " twelve"), (3, "else"), (None, said), (4, None)], "doc_id bigint, text string")
    bench = spark.createDataFrame([("b", said)], "item_id string, text string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clean, unlike = decontaminate(docs, bench), one_of_each(docs)
        for df in (clean, unlike):
            assert "BroadcastHashJoin" in plan_of(df) and "SortMergeJoin" not in plan_of(df)
        assert sorted(r.doc_id for r in clean.collect()) == [3, 4]
        assert sorted((r.doc_id or 0) for r in unlike.collect()) == [0, 1, 3, 4]
        shuffled = decontaminate(docs, bench, broadcast_rows=0)
        assert "SortMergeJoin" in plan_of(shuffled) and sorted(r.doc_id for r in shuffled.collect()) == [3, 4]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
