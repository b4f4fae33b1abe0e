"""Classification of tables that grow by files: each file is read once.

Counts of values and hits per column add up, so those of a file are kept and
joined with those of the others. A policy then reads new files only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, Detector
from ..functions.fixed_values import PII_KEYWORDS
from .redact import _counted, _judged

_FILE = ["file_path", "modified"]
_COUNTS = "file_path string, modified timestamp, column_name string, name_hit boolean, non_null bigint, hits bigint, rules string"


def _rules(keywords: tuple[str, ...], detectors: tuple[Detector, ...]) -> str:
    """What counts were made by; counts by other rules are not used."""
    said = repr((sorted(keywords), [(d.name, d.pattern) for d in detectors]))
    return hashlib.sha256(said.encode()).hexdigest()


def _files_of(table: DataFrame) -> DataFrame:
    """The files of a table; no column is read for it."""
    return table.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")).distinct()


def _kept_counts(spark: SparkSession, store: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(store)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(_COUNTS).parquet(store)


def classify_files(
    table: DataFrame,
    store: str,
    *,
    min_hits: int = 1,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """`classify_columns` of a table of files, reading those only that are not in `store` yet.

    `table` is a plain read of files, such as ``spark.read.parquet(path)``. The
    folder `store` keeps a row of counts per file and column. A file is known by
    its path and time of change: one that was written again is read again, one
    that is gone counts no more. Counts made by other keywords or detectors are
    not used; a detector that is a function is told apart by its name.

    The paths of new files come to the driver, which Spark's own listing of
    files has brought there already. Their counts are written at once, before
    the result is used. A call that fails while it writes leaves nothing in the
    store, and two calls at a time may count a file twice: make them one by one.
    """
    spark = table.sparkSession
    keywords, detectors = tuple(keywords), tuple(detectors)
    rules = _rules(keywords, detectors)
    files = _files_of(table)
    known = _kept_counts(spark, store)
    new = files
    if known is not None:
        known = known.where(F.col("rules") == rules)
        new = files.join(known.select(*_FILE).distinct(), _FILE, "left_anti")
    paths = sorted(row.file_path for row in new.select("file_path").collect())
    if paths:
        # a filter on the path leaves other files out before anything is read
        rows = table.where(F.col("_metadata.file_path").isin(paths)).select(
            "*", F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_modification_time").alias("modified")
        )
        names = {c.lower() for c in table.columns}
        if names & set(_FILE):
            raise ValueError(f"columns named {' and '.join(_FILE)} would be taken for the file's")
        _counted(rows, keywords, detectors, _FILE).withColumn("rules", F.lit(rules)).write.mode("append").parquet(store)
    if known is None and not paths:  # no file at all
        return _judged(_counted(table, keywords, detectors), min_hits)
    counts = _kept_counts(spark, store).where(F.col("rules") == rules).dropDuplicates([*_FILE, "column_name"])
    present = counts.join(files, _FILE, "left_semi")
    summed = present.groupBy("column_name").agg(
        F.bool_or("name_hit").alias("name_hit"), F.sum("non_null").alias("non_null"), F.sum("hits").alias("hits")
    )
    return _judged(summed, min_hits)


def incremental_policy(
    tables: Mapping[str, DataFrame],
    store: str,
    *,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """The `mask_policy` of tables of files; of each, new files only are read. Counts are kept under `store`, by table."""
    parts = []
    for name, df in tables.items():
        found = classify_files(df, f"{store.rstrip('/')}/{name}", keywords=keywords, detectors=detectors).where("sensitive")
        reason = F.when(F.col("name_hit"), "name").otherwise("value")
        parts.append(found.select(F.lit(name).alias("table_name"), "column_name", reason.alias("reason")))
    return reduce(DataFrame.unionByName, parts)
