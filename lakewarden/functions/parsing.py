"""Small readers of catalog text and helpers of arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def index_columns(indexdef: Column) -> Column:
    """Column list of an index definition, as an array without outer quotes."""
    inner = F.regexp_replace(indexdef, fv.INDEX_COLUMNS, "$1")
    inner = F.regexp_replace(inner, fv.INDEX_PREDICATE, "$1 WHERE ")
    return F.transform(
        F.split(inner, ", ", -1),
        lambda c: F.regexp_replace(F.btrim(c, F.lit(fv.SPACE_CHARS)), r'^"|"\z', ""),
    )


def index_method(indexdef: Column) -> Column:
    return F.regexp_replace(indexdef, fv.INDEX_METHOD, "$1")


def sequence_name(default_value: Column) -> tuple[Column, Column]:
    """(schema, sequence) named in ``nextval('schema.sequence'::regclass)``.

    The schema is ``public`` when none is given; the sequence is empty when the
    default is something else.
    """
    quoted = F.regexp_extract(default_value, fv.SEQUENCE_DEFAULT, 1)
    parts = F.split(F.replace(quoted, F.lit('"'), F.lit("")), r"\.", -1)
    qualified = F.size(parts) > 1
    schema = F.when(qualified, parts[0]).otherwise("public")
    sequence = F.when(qualified, F.get(parts, F.lit(1))).otherwise(parts[0])
    return schema, sequence


def share(part: Column, total: Column) -> Column:
    """part / total, NULL when there is no total."""
    return part.cast("double") / F.nullif(total.cast("double"), F.lit(0.0))


def padding(size: Column, align: Column) -> Column:
    """Bytes missing to the next multiple of `align`, 0 when there are none."""
    return (align - size % align) % align


def seconds_between(later: Column, earlier: Column) -> Column:
    """Seconds between two times of the same type, with or without a time zone."""
    return (later - earlier).cast("interval second").cast("decimal(20,6)").cast("double")
