"""Sensitive values in long texts: where they are, and texts without them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.detectors import detect
from ..functions.text import (
    REDACTION_STEPS,
    WORD_DETECTORS,
    candidate_words,
    card_spans,
    phone_spans,
)


def scan_text(df: DataFrame, id_columns: Sequence[str], text_column: str) -> DataFrame:
    """Count sensitive values in whole texts: ``(ids, detector, n)``.

    Words and spans are found in the scan stage, a pattern pass each over the
    text. Only hits are exploded, and counted on the map side before the
    shuffle, so neither long texts nor many copies of an id move.
    """
    text = F.col(text_column)
    found = F.concat(candidate_words(text), phone_spans(text), card_spans(text))
    hits = df.select(*id_columns, F.explode(found).alias("value"))
    names = F.array(
        *[F.when(detect(d, F.col("value")), F.lit(d)) for d in (*WORD_DETECTORS, "phone")]
    )
    return (
        hits.select(*id_columns, F.explode(names).alias("detector"))
        .where(F.col("detector").isNotNull())
        .groupBy(*id_columns, "detector")
        .agg(F.count("*").alias("n"))
    )


def redact_text(df: DataFrame, text_column: str, output_column: str | None = None) -> DataFrame:
    """Replace sensitive values inside whole texts by ``<redacted>``.

    Row-wise: no shuffle, and usable on a stream.
    """
    target = output_column or text_column
    out = df if target == text_column else df.withColumn(target, F.col(text_column))
    for step in REDACTION_STEPS:
        out = out.withColumn(target, step(F.col(target)))
    return out
