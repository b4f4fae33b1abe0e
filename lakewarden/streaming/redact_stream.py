"""Redaction of a stream. It keeps no state, so it needs no watermark."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.detectors import DETECTORS, Detector
from ..functions.fixed_values import PII_KEYWORDS
from ..operators.redact import redact


def redact_stream(
    stream: DataFrame,
    output: str,
    checkpoint: str,
    *,
    available_now: bool = True,
    nested: bool = False,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> StreamingQuery:
    """Redact a streaming DataFrame into parquet files, exactly once.

    `output` and `checkpoint` belong in a folder all executors reach. With
    `available_now` the query ends when everything present has been read.
    """
    writer = (
        redact(stream, nested=nested, keywords=keywords, detectors=detectors)
        .writeStream.format("parquet")
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
