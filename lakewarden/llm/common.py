"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: ASCII white space, as the members of a character class
SPACES = r"\x20\x09-\x0D"

#: Rows of a table that may be broadcast: at about 100 bytes a row some 100 MB.
#: Beyond it every operator takes a shuffled way with the same rows.
BROADCAST_ROWS = 1_000_000
#: And the bytes it may have, as files; in memory a table takes a few times as much
BROADCAST_BYTES = 64_000_000


def lower_ascii(text: Column) -> Column:
    """A-Z to lower case, all else as it is (É stays É)."""
    plain = F.octet_length(text) == F.length(text)
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words_by(text: Column, separators: str) -> Column:
    """The non-empty pieces between separators, given as a character class's members; of NULL none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"[{separators}]+", -1), "")


def grams(words: Column, size: int) -> Column:
    """A 64-bit hash of each run of ``size`` words, by position; of fewer words none."""
    return F.when(
        F.size(words) >= size,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - size),
            lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def fresh(frames: Iterable[DataFrame], name: str) -> str:
    """A column name that no frame has (names are compared without case)."""
    taken = {c.lower() for df in frames for c in df.columns}
    while name.lower() in taken:
        name = f"{name}_"
    return name


def written(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to the shared folder and read again.

    Cuts the lineage, so later steps neither recompute it nor depend on the
    executors that made it.
    """
    path = shared_folder(df.sparkSession, purpose)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame) -> None:
    """Remove tables of ``written`` that nothing reads any more, so they take no disk until the job's end."""
    for df in frames:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> bool:
    """Whether a written table has at most so many rows."""
    return df.count() <= rows


def hinted(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if its counted rows and the bytes of its files allow it."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    if size > BROADCAST_BYTES or not small(df, rows):
        return df
    out = F.broadcast(df)
    if "written_at" in vars(df):
        out.written_at = df.written_at
    return out


@contextmanager
def _at_most(spark: SparkSession, name: str, most: int) -> Iterator[None]:
    before = spark.conf.get(name)
    known = int(before.rstrip("b"))
    spark.conf.set(name, min(most, known) if known > 0 else most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def arrow_rows(spark: SparkSession, rows: int):
    """What is written inside sends at most so many rows at a time to Python: rows that hold long arrays fill its memory, and the JVM's."""
    return _at_most(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def arrow_bytes(spark: SparkSession, size: int):
    """What is written inside sends about so many bytes at a time to Python, at least a row."""
    return _at_most(spark, "spark.sql.execution.arrow.maxBytesPerBatch", size)


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def occurrences_of(text: Column, characters: str) -> Column:
    """How many characters of a class a text holds."""
    return (F.size(F.split(text, f"[{characters}]", -1)) - 1).cast("bigint")


def ship(spark: SparkSession) -> None:
    """Give this package to the executors' Python, once per session; Spark distributes the file."""
    context = spark.sparkContext
    if getattr(context, "_lakewarden_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    path = os.path.join(tempfile.mkdtemp(prefix="lakewarden-"), "lakewarden.zip")
    with zipfile.ZipFile(path, "w") as archive:
        for folder, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    archive.write(file, os.path.relpath(file, os.path.dirname(root)))
    context.addPyFile(path)
    context._lakewarden_shipped = True
