"""Redaction of results, masking at the source, and the policy behind it.

All of it is row-wise projection, so it needs no shuffle and works on batch
and streaming DataFrames alike. Only the classification aggregates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.detectors import (
    DETECTORS,
    Detector,
    is_pii_name,
    is_text,
    name_is_pii,
    should_redact,
    should_redact_sql,
    verdicts,
)
from ..functions.fixed_values import PII_KEYWORDS, REDACTED

# Columns whose detectors are evaluated in one pass; wider tables are read in
# several passes, each pruned to its own columns.
COLUMNS_PER_PASS = 100


def positional(df: DataFrame) -> tuple[DataFrame, list[tuple[T.StructField, str]]]:
    """The DataFrame under plain column names, and each field with its new name.

    Names may repeat in a result or hold dots and backticks; positions do not.
    """
    fields = df.schema.fields
    names = [f"c{i}" for i in range(len(fields))]
    return df.toDF(*names), list(zip(fields, names, strict=True))


def _verdict(
    field: T.StructField, column: str, keywords: tuple[str, ...], detectors: tuple[Detector, ...]
) -> Column:
    """Whether a cell of a column is sensitive, its name included."""
    if name_is_pii(field.name, keywords):
        return F.lit(True)
    if not is_text(field.dataType):
        return F.lit(False)
    if detectors == DETECTORS:
        return F.expr(should_redact_sql(column, keywords))
    return should_redact(field.name, F.col(column), keywords, detectors)


def _redacted(
    name: str,
    col: Column,
    dtype: T.DataType,
    keywords: Iterable[str],
    detectors: Iterable[Detector],
) -> Column:
    """A value inside a struct, array or map, or one of these."""
    if name_is_pii(name, keywords):
        return F.lit(REDACTED)
    if is_text(dtype):
        verdict = should_redact(name, col, keywords, detectors)
        return F.when(verdict, F.lit(REDACTED)).otherwise(col)
    if isinstance(dtype, T.StructType):
        fields = [
            _redacted(f.name, col[f.name], f.dataType, keywords, detectors).alias(f.name)
            for f in dtype.fields
        ]
        return F.when(col.isNull(), F.lit(None)).otherwise(F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(
            col, lambda x: _redacted("", x, dtype.elementType, keywords, detectors)
        )
    if isinstance(dtype, T.MapType):
        # keys are data here: a sensitive key hides its value, a key that looks
        # sensitive the whole map, as keys of a map must differ
        hidden = F.lit(REDACTED) if is_text(dtype.valueType) else F.lit(None)

        def value(k: Column, v: Column) -> Column:
            inner = _redacted("", v, dtype.valueType, keywords, detectors)
            return F.when(is_pii_name(k.cast("string"), keywords), hidden).otherwise(inner)

        values = F.transform_values(col, value)
        if not is_text(dtype.keyType):
            return values
        shown = F.exists(F.map_keys(col), lambda k: should_redact("", k, keywords, detectors))
        return F.when(shown, F.lit(None)).otherwise(values)
    return col


def _by_vectors(values: pa.Array, functions: tuple[Callable[[pa.Array], pa.Array], ...], keywords: tuple[str, ...]) -> pa.Array:
    """An array of any nesting without the texts that a function finds.

    Nested arrays are offsets over one flat array of their elements: that one is
    judged, and put back under the same offsets.
    """
    kind = values.type
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        hit = pc.and_(pc.is_valid(values), pc.not_equal(pc.fill_null(values, ""), ""))
        found = pa.array(np.zeros(len(values), bool))
        for function in functions:
            found = pc.or_(found, verdicts(function, values))
        return pc.if_else(pc.and_(hit, found), pa.scalar(REDACTED, kind), values)
    if pa.types.is_struct(kind):
        parts = [values.field(i) for i in range(kind.num_fields)] if not values.offset else values.flatten()
        fields = [
            # what is sensitive by name is hidden already
            part if name_is_pii(f.name, keywords) else _by_vectors(part, functions, keywords)
            for f, part in zip(kind, parts, strict=True)
        ]
        return pa.StructArray.from_arrays(fields, fields=list(kind), mask=pc.is_null(values))
    if pa.types.is_map(kind):
        # keys must differ, so a key that is found hides the whole map
        keys, offsets = values.keys, values.offsets
        begin, end = offsets[0].as_py(), offsets[-1].as_py()
        hidden = pc.is_null(values).to_numpy(zero_copy_only=False)
        if pa.types.is_string(kind.key_type):
            shown = pc.not_equal(_by_vectors(keys, functions, ()), keys).to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(len(values)), np.diff(offsets.to_numpy()))
            hidden[row[shown[begin:end]]] = True
        items = _by_vectors(values.items, functions, keywords)
        where = pa.array(offsets.to_numpy(), pa.int32(), mask=np.append(hidden, False))
        out = pa.MapArray.from_arrays(where, keys, items)
        return out.cast(kind)
    if pa.types.is_list(kind):
        # the offsets of a slice begin within the elements
        where = pa.array(values.offsets.to_numpy(), pa.int32(), mask=np.append(pc.is_null(values).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(where, _by_vectors(values.values, functions, keywords)).cast(kind)
    return values


def _has_text(dtype: T.DataType) -> bool:
    return is_text(dtype) or any(_has_text(kind) for _, kind, _ in _inner(dtype, ""))


def _hidden_type(name: str, dtype: T.DataType, keywords: tuple[str, ...]) -> T.DataType:
    """The type of a nested value once `_redacted` is through: what is sensitive by name is a string."""
    if name_is_pii(name, keywords):
        return T.StringType()
    if isinstance(dtype, T.StructType):
        return T.StructType([T.StructField(f.name, _hidden_type(f.name, f.dataType, keywords)) for f in dtype.fields])
    if isinstance(dtype, T.ArrayType):
        return T.ArrayType(_hidden_type("", dtype.elementType, keywords))
    if isinstance(dtype, T.MapType):
        return T.MapType(dtype.keyType, _hidden_type("", dtype.valueType, keywords))
    return dtype


def _vectors(detectors: Iterable[Detector]) -> tuple[tuple[Detector, ...], tuple[Callable[[pa.Array], pa.Array], ...]]:
    """Detectors that are expressions, and the functions of the others."""
    return tuple(d for d in detectors if d.vector is None), tuple(d.vector for d in detectors if d.vector is not None)


def redact(
    df: DataFrame,
    *,
    nested: bool = False,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """Replace every sensitive value of every column by ``<redacted>``.

    A column that is sensitive by name is replaced whatever its type, and
    becomes a string. String values are replaced by JSON key or value shape.
    Other types pass. `nested` also looks into structs, arrays and maps; what
    is hidden there and is no string becomes NULL.
    """
    keywords, detectors = tuple(keywords), tuple(detectors)
    plain, columns = positional(df)
    out = []
    for f, column in columns:
        if name_is_pii(f.name, keywords):
            col = F.lit(REDACTED)
        elif is_text(f.dataType):
            verdict = _verdict(f, column, keywords, detectors)
            col = F.when(verdict, F.lit(REDACTED)).otherwise(F.col(column))
        elif nested:
            # functions of arrays cannot stand inside Spark's lambdas: they get the nested column as a whole
            plain_detectors, functions = _vectors(detectors)
            col = _redacted(f.name, F.col(column), f.dataType, keywords, plain_detectors)
            if functions and _has_text(f.dataType):
                kind = _hidden_type(f.name, f.dataType, keywords)
                col = F.arrow_udf(lambda v, fs=functions: _by_vectors(v, fs, keywords), kind)(col)
        else:
            col = F.col(column)
        out.append(col.alias(f.name))
    return plain.select(*out)


def redaction_verdicts(
    df: DataFrame,
    *,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """For every cell whether it would be redacted, under the same column names."""
    keywords, detectors = tuple(keywords), tuple(detectors)
    plain, columns = positional(df)
    return plain.select(
        *[_verdict(f, column, keywords, detectors).alias(f.name) for f, column in columns]
    )


def _hidden(dtype: T.DataType) -> Column:
    return F.lit(REDACTED) if is_text(dtype) else F.lit(None).cast(dtype)


def _inner(dtype: T.DataType, path: str) -> list[tuple[str, T.DataType, str]]:
    """The parts of a nested type: (path, type, name). Elements and map entries have no name of their own."""
    if isinstance(dtype, T.StructType):
        return [(f"{path}.{f.name}", f.dataType, f.name) for f in dtype.fields]
    if isinstance(dtype, T.ArrayType):
        return [(f"{path}[]", dtype.elementType, "")]
    if isinstance(dtype, T.MapType):
        return [(f"{path}{{key}}", dtype.keyType, ""), (f"{path}{{}}", dtype.valueType, "")]
    return []


def _rebuilt(col: Column, dtype: T.DataType, path: str, wanted: set[str], keywords: tuple[str, ...]) -> Column:
    """A value with the wanted parts hidden, and what sensitive keys of a map point to."""
    if path.lower() in wanted:
        return _hidden(dtype)

    def touched(kind: T.DataType, at: str) -> bool:
        return at.lower() in wanted or isinstance(kind, T.MapType) or any(touched(k, p) for p, k, _ in _inner(kind, at))

    if not touched(dtype, path):
        return col
    if isinstance(dtype, T.StructType):
        fields = [_rebuilt(col[f.name], f.dataType, f"{path}.{f.name}", wanted, keywords).alias(f.name) for f in dtype.fields]
        return F.when(col.isNotNull(), F.struct(*fields))
    if isinstance(dtype, T.ArrayType):
        return F.transform(col, lambda x: _rebuilt(x, dtype.elementType, f"{path}[]", wanted, keywords))
    if f"{path}{{key}}".lower() in wanted:  # keys of a map must differ, so they cannot all be hidden alike
        return _hidden(dtype)

    def value(k: Column, v: Column) -> Column:
        inner = _rebuilt(v, dtype.valueType, f"{path}{{}}", wanted, keywords)
        return F.when(is_pii_name(k.cast("string"), keywords), _hidden(dtype.valueType)).otherwise(inner)

    return F.transform_values(col, value)


def mask_columns(df: DataFrame, columns: Iterable[str], keywords: Iterable[str] = PII_KEYWORDS) -> DataFrame:
    """Replace whole columns, or parts of nested ones, keeping their type and place.

    Strings become ``<redacted>``, NULLs included; other types become NULL. A
    part is named by its path: ``contact.email``, ``tags[]`` for the elements of
    an array, ``m{}`` for the values of a map and ``m{key}`` for its keys, which
    hides the map. In a map what a key sensitive by `keywords` points to is
    always hidden, as keys are names that only the data knows.
    """
    wanted, keywords = {c.lower() for c in columns}, tuple(keywords)
    plain, fields = positional(df)
    return plain.select(*[_rebuilt(F.col(c), f.dataType, f.name, wanted, keywords).alias(f.name) for f, c in fields])


def pii_columns(df: DataFrame, keywords: Iterable[str] = PII_KEYWORDS) -> list[str]:
    """Columns and parts of nested columns sensitive by name, read off the schema."""
    keywords = tuple(keywords)

    def within(path: str, dtype: T.DataType, name: str) -> list[str]:
        if name_is_pii(name, keywords):
            return [path]
        return [p for inner in _inner(dtype, path) for p in within(*inner)]

    return [p for f in df.schema.fields for p in within(f.name, f.dataType, f.name)]


def _texts_within(sql: str, dtype: T.DataType, path: str, name: str, keywords: tuple[str, ...], depth: int = 0):
    """(path, SQL of the array of its values) of each text inside a nested column whose names are not sensitive."""
    for at, kind, part in _inner(dtype, path):
        if part and name_is_pii(part, keywords):
            continue
        x = f"x{depth}"
        if isinstance(dtype, T.StructType):
            step = f"transform({sql}, {x} -> {x}.`{part.replace('`', '``')}`)"
        elif isinstance(dtype, T.ArrayType):
            step = f"flatten(filter({sql}, {x} -> {x} IS NOT NULL))"
        else:
            entries = "map_keys" if at.endswith("{key}") else "map_values"
            step = f"flatten(transform(filter({sql}, {x} -> {x} IS NOT NULL), {x} -> {entries}({x})))"
        if is_text(kind):
            yield at, step
        yield from _texts_within(step, kind, at, part, keywords, depth + 1)


def _hits_by_vectors(
    values: Column, detectors: tuple[Detector, ...], functions: tuple[Callable[[pa.Array], pa.Array], ...], keywords: tuple[str, ...]
) -> Column:
    """Of an array of texts those that an expression or a function finds."""

    def judge(lists: pa.Array) -> pa.Array:
        hit = pc.not_equal(_by_vectors(lists.values, functions, ()), lists.values)
        where = pa.array(lists.offsets.to_numpy(), pa.int32(), mask=np.append(pc.is_null(lists).to_numpy(zero_copy_only=False), False))
        return pa.ListArray.from_arrays(where, pc.fill_null(hit, False))

    found = F.arrow_udf(judge, "array<boolean>")(values)
    both = F.arrays_zip(values.alias("v"), found.alias("f"))
    return F.filter(both, lambda x: F.coalesce(x["f"], F.lit(False)) | should_redact("", x["v"], keywords, detectors))


def classify_columns(
    df: DataFrame,
    *,
    min_hits: int = 1,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """Per column: hit by name, non-null values, values that look sensitive, verdict.

    A column is sensitive by name or when at least `min_hits` of its values
    are. Every value counts, so the answer does not depend on which row is
    looked at. Texts inside structs, arrays and maps have a row of their own
    under their path, as have parts that are sensitive by name.

    One aggregation for all columns, partial on the map side; what is shuffled
    is one row per task.
    """
    return _judged(_counted(df, tuple(keywords), tuple(detectors)), min_hits)


def _judged(found: DataFrame, min_hits: int) -> DataFrame:
    ratio = F.col("hits") / F.nullif(F.col("non_null"), F.lit(0))
    return found.select(
        "column_name",
        "name_hit",
        "non_null",
        "hits",
        F.coalesce(ratio, F.lit(0.0)).alias("ratio"),
        (F.col("name_hit") | (F.col("hits") >= min_hits)).alias("sensitive"),
    )


def _counted(df: DataFrame, keywords: tuple[str, ...], detectors: tuple[Detector, ...], by: Sequence[str] = ()) -> DataFrame:
    """Per column, or part of a nested one: hit by name, non-null values, hits; for each value of the columns `by`, which are not judged."""
    plain, columns = positional(df)
    group = [c for f, c in columns if f.name in by]
    columns = [(f, c) for f, c in columns if f.name not in by]
    # (name, by name, what is counted, what is counted as a hit)
    found_of: list[tuple[str, bool, Column, Column | None]] = []
    for f, column in columns:
        by_name = name_is_pii(f.name, keywords)
        looks = is_text(f.dataType) and not by_name
        hits = F.count_if(_verdict(f, column, keywords, detectors)) if looks else None
        found_of.append((f.name, by_name, F.count(column), hits))
        if by_name or not _inner(f.dataType, f.name):
            continue
        named = [p for p in pii_columns(plain.select(F.col(column).alias(f.name)), keywords)]
        found_of += [(p, True, F.count(column), None) for p in named]
        for path, sql in _texts_within(f"array({column})", f.dataType, f.name, f.name, keywords):
            values = F.expr(f"filter({sql}, v -> v IS NOT NULL)")
            own, functions = _vectors(detectors)
            if functions:
                hit = _hits_by_vectors(F.expr(sql), own, functions, keywords)
            elif detectors == DETECTORS:
                hit = F.expr(f"filter({sql}, v -> {should_redact_sql('v', keywords)})")
            else:
                hit = F.filter(F.expr(sql), lambda v: should_redact("", v, keywords, detectors))
            size = [F.coalesce(F.sum(F.greatest(F.size(c), F.lit(0))), F.lit(0)).cast("bigint") for c in (values, hit)]
            found_of.append((path, False, *size))
    passes = []
    for start in range(0, len(found_of), COLUMNS_PER_PASS):
        counts, rows = [], []
        for i, (name, by_name, count, hits) in enumerate(found_of[start : start + COLUMNS_PER_PASS]):
            counts.append(count.alias(f"n{i}"))
            if hits is not None:
                counts.append(hits.alias(f"h{i}"))
            rows.append(
                F.struct(
                    F.lit(name).alias("column_name"),
                    F.lit(by_name).alias("name_hit"),
                    F.col(f"n{i}").alias("non_null"),
                    (F.lit(0).cast("bigint") if hits is None else F.col(f"h{i}")).alias("hits"),
                )
            )
        passes.append(plain.groupBy(*group).agg(*counts).select(*[F.col(c).alias(n) for n, c in zip(by, group, strict=True)], F.inline(F.array(*rows))))
    return reduce(DataFrame.unionByName, passes)


def mask_policy(
    tables: Mapping[str, DataFrame],
    *,
    classify: bool = True,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """The columns to mask, or parts of them: ``(table_name, column_name, reason)``.

    One row per column or part at most, so it may be kept as a table and
    reused: with `classify` every table is read once, and a single sensitive
    value is enough.
    """
    keywords, detectors = tuple(keywords), tuple(detectors)
    parts = []
    for name, df in tables.items():
        if classify:
            found = classify_columns(df, keywords=keywords, detectors=detectors).where("sensitive")
            reason = F.when(F.col("name_hit"), "name").otherwise("value")
            parts.append(found.select(F.lit(name).alias("table_name"), "column_name", reason.alias("reason")))
        else:
            rows = [(name, column, "name") for column in pii_columns(df, keywords)]
            schema = "table_name string, column_name string, reason string"
            parts.append(df.sparkSession.createDataFrame(rows, schema))
    return reduce(DataFrame.unionByName, parts)
