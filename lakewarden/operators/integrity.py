"""Checks of the data itself: keys, references, NULLs, column statistics, headroom."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import fixed_values as fv
from .redact import positional

# Bytes of the types stored with a fixed width.
_FIXED_WIDTH = {
    T.BooleanType: 1, T.ByteType: 2, T.ShortType: 2, T.IntegerType: 4, T.LongType: 8,
    T.FloatType: 4, T.DoubleType: 8, T.DateType: 4, T.TimestampType: 8, T.TimestampNTZType: 8,
}
_TYPE_MAX = {
    T.ShortType: fv.SMALLINT_MAX, T.IntegerType: fv.INTEGER_MAX, T.LongType: fv.BIGINT_MAX,
}


def _all_present(columns: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def validate_unique(df: DataFrame, columns: Sequence[str], *, nulls_distinct: bool = True) -> DataFrame:
    """Key values that occur more than once, with their count ``n``.

    As in SQL a key with a NULL in it equals no other; `nulls_distinct=False`
    compares NULLs as equal. Copies of a key are counted on the map side, so
    a value held by a third of all rows is one row per task in the shuffle.
    """
    rows = df.select(*columns)
    if nulls_distinct:
        rows = rows.where(_all_present(columns))
    return rows.groupBy(*columns).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def validate_not_null(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the number of rows and of NULLs; one pass, one row per task shuffled."""
    names = list(columns or df.columns)
    counts = [F.count_if(F.col(c).isNull()).alias(f"n{i}") for i, c in enumerate(names)]
    rows = [
        F.struct(F.lit(c).alias("column_name"), F.col("n").alias("n_rows"), F.col(f"n{i}").alias("n_null"))
        for i, c in enumerate(names)
    ]
    return df.agg(F.count("*").alias("n"), *counts).select(F.inline(F.array(*rows)))


def validate_foreign_key(
    child: DataFrame, columns: Sequence[str], parent: DataFrame, parent_columns: Sequence[str]
) -> DataFrame:
    """Key values of `child` missing in `parent`, with the number of child rows.

    A key with a NULL in it refers to nothing and is not checked. Child keys
    are counted before the anti-join: each distinct key takes part once,
    however many rows hold it, so no key is hot.
    """
    keys = child.select(*columns).where(_all_present(columns)).groupBy(*columns)
    counted = keys.agg(F.count("*").alias("n_rows"))
    names = [f"_parent_{i}" for i in range(len(columns))]
    # distinct needs no shuffle of its own and collapses a hot parent key
    known = parent.select(
        *[F.col(p).alias(n) for p, n in zip(parent_columns, names, strict=True)]
    ).distinct()
    same = reduce(lambda a, b: a & b, [F.col(c) == F.col(n) for c, n in zip(columns, names, strict=True)])
    return counted.join(known, same, "left_anti")


def column_stats(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Per column the share of NULLs and the average width in bytes of the rest.

    Types of a fixed width need no reading beyond their NULLs; others count
    the bytes of their text. The result feeds the index-size estimate.
    """
    plain, fields = positional(df)
    counts, rows = [], []
    for i, (f, name) in enumerate(fields):
        if columns is not None and f.name not in columns:
            continue
        col = F.col(name)
        counts.append(F.count(col).alias(f"c{i}"))
        fixed = _FIXED_WIDTH.get(type(f.dataType))
        if fixed is None:
            counts.append(F.sum(F.octet_length(_as_bytes(col, f.dataType))).alias(f"w{i}"))
            width = F.col(f"w{i}") / F.nullif(F.col(f"c{i}"), F.lit(0))
        else:
            width = F.when(F.col(f"c{i}") > 0, F.lit(float(fixed)))
        share = (F.col("n") - F.col(f"c{i}")) / F.nullif(F.col("n"), F.lit(0))
        rows.append(
            F.struct(
                F.lit(f.name).alias("column_name"),
                share.alias("null_frac"),
                width.alias("avg_width"),
            )
        )
    return plain.agg(F.count("*").alias("n"), *counts).select(F.inline(F.array(*rows)))


def _as_bytes(col: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.StringType, T.BinaryType)):
        return col
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.to_json(col)
    return col.cast("string")


def key_headroom(
    df: DataFrame, columns: Sequence[str] | None = None, *, threshold: float = fv.SEQUENCE_LIMIT
) -> DataFrame:
    """How far integer columns have used up their type's range."""
    plain, fields = positional(df)
    keys = [
        (f.name, name, float(_TYPE_MAX[type(f.dataType)]))
        for f, name in fields
        if type(f.dataType) in _TYPE_MAX and (columns is None or f.name in columns)
    ]
    highest = [F.max(name).cast("bigint").alias(f"m{i}") for i, (_, name, _) in enumerate(keys)]
    rows = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col(f"m{i}").alias("max_value"),
            F.lit(limit).alias("type_max"),
            (F.col(f"m{i}").cast("double") / F.lit(limit)).alias("used"),
            F.coalesce(F.col(f"m{i}").cast("double") / F.lit(limit) > threshold, F.lit(False)).alias("exceeded"),
        )
        for i, (c, _, limit) in enumerate(keys)
    ]
    return plain.agg(*highest).select(F.inline(F.array(*rows)))
