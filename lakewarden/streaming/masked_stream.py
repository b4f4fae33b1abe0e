"""Anonymised SQL over streaming tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..functions.detectors import DETECTORS, Detector
from ..functions.fixed_values import PII_KEYWORDS
from ..plans.session import run_sql


def run_masked_stream(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame],
    policy: DataFrame,
    output: str,
    checkpoint: str,
    *,
    mode: str = "append",
    available_now: bool = True,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> StreamingQuery:
    """Run an anonymised statement over streaming and static tables, into parquet files.

    The statement sees masked views only, as in `run_sql`, and what it returns
    is redacted as well. A stream cannot be classified before it has come, so
    the `policy` is given: one made of what has landed before, or kept by
    `incremental_policy`. Columns sensitive by name are masked in any case.

    ``append`` adds rows as they are final, which aggregates are once a watermark
    has passed them. ``complete`` replaces `output` by the whole result with each
    batch; a batch that is done again after a failure writes the same.
    """
    if mode not in ("append", "complete"):
        raise ValueError(f"mode must be append or complete, not {mode!r}")
    if not any(df.isStreaming for df in tables.values()):
        raise ValueError("none of the tables is a stream")
    result = run_sql(spark, sql, anonymize=True, tables=tables, policy=policy, keywords=keywords, detectors=detectors)
    writer = result.writeStream.option("checkpointLocation", checkpoint).outputMode(mode)
    if mode == "append":
        writer = writer.format("parquet").option("path", output)
    else:
        writer = writer.foreachBatch(lambda batch, _: batch.write.mode("overwrite").parquet(output))
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
