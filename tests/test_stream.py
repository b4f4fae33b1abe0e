import pytest

from lakewarden import redact, redact_stream, redact_text
from lakewarden.sources import shared_folder


def test_stream_equals_batch(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/conversations.parquet")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "conversations.parquet").parquet(small)
    renamed = {"conv_id": "session_token"}
    redact_stream(stream.withColumnsRenamed(renamed), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    expected = redact(batch.withColumnsRenamed(renamed))
    assert out.columns == expected.columns and out.count() == batch.count()
    assert out.exceptAll(expected).isEmpty() and expected.exceptAll(out).isEmpty()


def test_text_redaction_works_on_a_stream(spark, small, tmp_path):
    batch = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text")
    stream = spark.readStream.schema(batch.schema).option("pathGlobFilter", "documents.parquet").parquet(small)
    redact_stream(redact_text(stream, "text"), f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    expected = redact(redact_text(batch, "text"))
    assert out.count() == batch.count() and expected.exceptAll(out).isEmpty()


def test_restart_reads_only_what_is_new(spark, tmp_path):
    source, schema = f"{tmp_path}/in", "id bigint, email string"
    for part in range(2):
        spark.range(part * 10, part * 10 + 10).selectExpr("id", "concat(id, '@x.io') as email").write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        redact_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination()
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(r.id for r in rows) == list(range(20)) and {r.email for r in rows} == {"<redacted>"}


class Session:
    """Stands for a session of which only the settings are read."""

    def __init__(self, settings):
        self.conf = settings


def test_shared_folder_comes_from_the_session():
    folder = shared_folder(Session({"spark.checkpoint.dir": "s3a://bucket/ck/", "spark.master": "yarn"}), "a")
    assert folder.startswith("s3a://bucket/ck/a-")


def test_local_session_may_do_without(spark):
    assert shared_folder(spark, "a") != shared_folder(spark, "a")


def test_cluster_without_shared_folder_is_refused():
    with pytest.raises(RuntimeError):
        shared_folder(Session({"spark.master": "spark://host:7077"}), "a")
