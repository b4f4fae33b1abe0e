"""Sensitive values in a stream of texts, each text counted once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.detectors import detect
from ..functions.text import WORD_DETECTORS, candidate_words, card_spans, phone_spans


def text_hits(df: DataFrame, id_columns: Sequence[str], text_column: str, *more: str) -> DataFrame:
    """`scan_text` of rows that are one text each: counted within the row, so without a shuffle or state."""
    text = F.col(text_column)
    found = F.concat(candidate_words(text), phone_spans(text), card_spans(text))

    def count(name: str):
        return F.struct(F.lit(name).alias("detector"), F.size(F.filter("_found", lambda v: detect(name, v))).cast("bigint").alias("n"))

    counts = F.array(*[count(d) for d in (*WORD_DETECTORS, "phone")])
    rows = df.select(*id_columns, *more, found.alias("_found")).select(*id_columns, *more, F.explode(counts).alias("_hit"))
    return rows.where(F.col("_hit.n") > 0).select(*id_columns, *more, "_hit.*")


def scan_stream(
    stream: DataFrame,
    id_columns: Sequence[str],
    text_column: str,
    time_column: str,
    output: str,
    checkpoint: str,
    *,
    delay: str = "1 day",
    window: str | None = None,
    available_now: bool = True,
) -> StreamingQuery:
    """Count sensitive values in a stream of texts, into parquet files, exactly once.

    Sources deliver again what they could not confirm: of texts with the same
    ids that come within `delay` of event time the first one counts. What is
    remembered for that is dropped when the watermark passes it, so state is
    bounded by the ids of one `delay`.

    Rows are (ids, detector, n). With `window` they are (window_start, detector,
    n_texts, n) for each window of event time, given out when the watermark has
    passed it: counts are added up in state, partial before the shuffle, and a
    window's late texts are lost.
    """
    once = stream.withWatermark(time_column, delay).dropDuplicatesWithinWatermark(list(id_columns))
    if window is None:
        rows = text_hits(once, id_columns, text_column)
    else:
        hits = text_hits(once, id_columns, text_column, time_column)
        counts = hits.groupBy(F.window(time_column, window).alias("_window"), "detector").agg(
            F.count("*").alias("n_texts"), F.sum("n").alias("n")
        )
        rows = counts.select(F.col("_window.start").alias("window_start"), "detector", "n_texts", "n")
    writer = rows.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint).outputMode("append")
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()
