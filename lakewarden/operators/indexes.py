"""Index diagnostics over catalog snapshots of many databases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.parsing import index_columns, index_method, padding
from .skew import salted_lookup, with_schema_name


def named_classes(pg_class: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    """Tables, indexes and the like with their schema's name; NULL if the schema is not known."""
    return with_schema_name(pg_class, pg_namespace, "relnamespace", "schema", ["oid"], "left")


def _joined(pg_index: DataFrame, own: DataFrame, used: DataFrame, tables: DataFrame) -> DataFrame:
    """Indexes with their own entries, their usage and their tables' entries.

    All are about as long as the index table itself. Their files are small for
    their rows, and by the files' size Spark would broadcast each of them: a
    copy in every task and in the driver.
    """
    named = pg_index.join(own.hint("merge"), ["db_id", "indexrelid"]).join(used.hint("merge"), ["db_id", "indexrelid"])
    return named.join(tables.hint("merge"), ["db_id", "indrelid"])


def indexes_with_tables(pg_index: DataFrame, classes: DataFrame, usage: DataFrame) -> DataFrame:
    """Every used index with what its own entry and its table's entry among `classes` say."""
    own = classes.select(
        "db_id", F.col("oid").alias("indexrelid"), F.col("relname").alias("name"), F.col("schema").alias("index_schema"),
        "relam", "reltuples", "relpages",
    )
    tables = classes.select("db_id", F.col("oid").alias("indrelid"), F.col("relname").alias("table"), F.col("schema").alias("table_schema"))
    used = usage.select("db_id", "indexrelid", F.col("schemaname").alias("schema"))
    return _joined(pg_index, own, used, tables)


def inventory_of(indexes: DataFrame) -> DataFrame:
    """The inventory of `index_inventory` from rows that already have their names."""
    # the outer join plus "schema is not null" of the definition is an inner join
    return indexes.where(F.col("schema").isNotNull()).select(
        "db_id",
        "schema",
        "table",
        "name",
        index_columns(F.col("indexdef")).alias("columns"),
        index_method(F.col("indexdef")).alias("using"),
        F.col("indisunique").alias("unique"),
        F.col("indisprimary").alias("primary"),
        F.col("indisvalid").alias("valid"),
        "indexprs",
        "indpred",
        F.col("indexdef").alias("definition"),
    )


def index_inventory(pg_index: DataFrame, pg_class: DataFrame, usage: DataFrame) -> DataFrame:
    """Every index of a user table with its columns and properties."""
    names = pg_class.select("db_id", "oid", "relname")
    tables = names.select("db_id", F.col("oid").alias("indrelid"), F.col("relname").alias("table"))
    indexes = names.select("db_id", F.col("oid").alias("indexrelid"), F.col("relname").alias("name"))
    schemas = usage.select("db_id", "indexrelid", F.col("schemaname").alias("schema"))
    return inventory_of(_joined(pg_index, indexes, schemas, tables))


def invalid_indexes(inventory: DataFrame) -> DataFrame:
    return inventory.where(~F.coalesce("valid", F.lit(False))).select(
        "db_id", "schema", "table", "name"
    )


def duplicate_indexes(inventory: DataFrame, *, ordered: bool = True, collation: str | None = None) -> DataFrame:
    """Indexes another index of the same table makes unneeded, by table and name if `ordered`.

    A valid index that is neither primary nor unique is covered when its
    columns start those of another valid index with the same method,
    expressions and predicate. Between two with equal columns only the one
    later by name is unneeded, unless the other is primary or unique. Of
    several covering indexes the first by name is reported.

    No pairs are formed. Every index offers each prefix of its columns (an
    index has few), and per prefix only two names matter: the first of those
    that cover in any case and the first of those that need an earlier name.
    An index is offered with its whole columns, too, and there meets both. So
    rows are read once and sorted behind one shuffle, never in the scan, whose
    tasks are as many as the files want and not the rows.

    Names are ordered by their bytes, or by a `collation` such as ``UNICODE``,
    where a comes before B and B before c; what covers what stays the same.
    """
    group = ["db_id", "schema", "table", "using", "indexprs", "indpred"]
    valid = inventory.where("valid").withColumn("n", F.size("columns"))
    plain = ~(F.coalesce("primary", F.lit(False)) | F.coalesce("unique", F.lit(False)))
    offers = valid.select(
        *group,
        "name",
        F.col("n"),
        plain.alias("plain"),
        "columns",
        F.explode(F.sequence(F.lit(1), F.col("n"))).alias("length"),
    ).withColumn("columns", F.slice("columns", F.lit(1), F.col("length")))
    # an index longer than the prefix, primary or unique covers whatever its name
    always = (F.col("n") > F.col("length")) | ~F.col("plain")
    same = Window.partitionBy(*group, "columns")
    met = offers.withColumns({
        "always": F.min(F.when(always, F.col("name"))).over(same),
        "earlier": F.min(F.when(~always, F.col("name"))).over(same),
    })
    before = F.when(F.col("earlier") < F.col("name"), F.col("earlier"))
    out = (
        met.where(F.col("plain") & (F.col("length") == F.col("n")))
        .withColumn("covering", F.least("always", before))
        .where(F.col("covering").isNotNull())
        .select("db_id", "schema", "table", F.col("name").alias("unneeded"), "columns", "covering")
    )
    by = [F.col(c) if collation is None else F.collate(c, collation) for c in ("schema", "table", "unneeded")]
    return out.orderBy(*by, "schema", "table", "unneeded", "db_id") if ordered else out


def unused_indexes(pg_index: DataFrame, usage: DataFrame, *, ordered: bool = True) -> DataFrame:
    """Rarely scanned indexes, neither unique nor primary, largest first if `ordered`."""
    rare = usage.where(F.col("idx_scan") <= fv.MAX_RARE_SCANS)
    plain = pg_index.where(~F.col("indisunique") & ~F.coalesce("indisprimary", F.lit(False)))
    out = rare.join(plain.hint("merge"), ["db_id", "indexrelid"]).select(
        "db_id",
        F.col("schemaname").alias("schema"),
        F.col("relname").alias("table"),
        F.col("indexrelname").alias("name"),
        "size_bytes",
        F.col("idx_scan").alias("index_scans"),
        F.col("indexdef").alias("definition"),
    )
    largest_first = F.col("size_bytes").desc_nulls_first()
    return out.orderBy(largest_first, "table", "name", "db_id") if ordered else out


def bloat_estimate(
    df: DataFrame, *, block_size: int = fv.BLOCK_SIZE, max_align: int = fv.MAX_ALIGN
) -> DataFrame:
    """Add ``bloat_bytes`` and ``index_bytes`` to rows of one index each.

    Reads ``reltuples``, ``relpages``, ``amname``, ``max_null_frac`` and
    ``data_width``. What the pages hold beyond the estimated need is bloat.
    """
    align = F.lit(max_align)
    # Bytes of the tuple header with and without a NULL bitmap.
    header = F.when(F.col("max_null_frac") == 0, F.lit(2)).otherwise(F.lit(6))
    width = F.col("data_width").cast("double")
    row = F.lit(2) + padding(header, align) + width + padding(F.rint(width), align)
    pages = F.ceil(F.col("reltuples") * (F.lit(4) + row) / F.lit(float(block_size - fv.PAGE_HEADER)))
    needed = F.coalesce(
        pages + F.when(F.col("amname").isin("hash", "btree"), 1).otherwise(0), F.lit(0)
    )
    relpages = F.col("relpages")
    wasted = F.when(relpages <= needed, F.lit(0)).otherwise((relpages - needed) * block_size)
    return df.withColumn("bloat_bytes", wasted.cast("bigint")).withColumn(
        "index_bytes", (relpages * block_size).cast("bigint")
    )


def index_bloat(
    pg_index: DataFrame,
    pg_class: DataFrame,
    pg_am: DataFrame,
    pg_namespace: DataFrame,
    pg_attribute: DataFrame,
    pg_stats: DataFrame,
    usage: DataFrame,
    *,
    min_bytes: int = fv.MIN_BLOAT_BYTES,
    block_size: int = fv.BLOCK_SIZE,
    max_align: int = fv.MAX_ALIGN,
    ordered: bool = True,
) -> DataFrame:
    """B-tree indexes wasting at least `min_bytes`, most wasteful first if `ordered`."""
    classes = named_classes(pg_class, pg_namespace)
    indexes = indexes_with_tables(pg_index, classes, usage)
    return bloat_of(
        indexes, pg_am, pg_attribute, pg_stats, min_bytes=min_bytes, block_size=block_size, max_align=max_align, ordered=ordered
    )


def bloat_of(
    indexes: DataFrame,
    pg_am: DataFrame,
    pg_attribute: DataFrame,
    pg_stats: DataFrame,
    *,
    min_bytes: int = fv.MIN_BLOAT_BYTES,
    block_size: int = fv.BLOCK_SIZE,
    max_align: int = fv.MAX_ALIGN,
    ordered: bool = True,
) -> DataFrame:
    """`index_bloat` of rows that already have their names, as those of `indexes_with_tables`."""
    btree = pg_am.where(F.col("amname") == "btree").select("db_id", F.col("oid").alias("relam"), "amname")
    known = indexes.where(F.col("index_schema").isNotNull() & F.col("table_schema").isNotNull())
    indexes = salted_lookup(known, btree, ["db_id", "relam"], spread_by=["indexrelid"]).drop("schema").withColumnRenamed("index_schema", "schema")
    columns = pg_attribute.where(F.col("attnum") > 0).select(
        "db_id", F.col("attrelid").alias("indrelid"), "attnum", "attname"
    )
    stats = pg_stats.select(
        "db_id", F.col("schemaname").alias("table_schema"), F.col("tablename").alias("table"),
        "attname", "null_frac", "avg_width",
    )
    nulls = F.coalesce("null_frac", F.lit(0.0))
    width = F.coalesce("avg_width", F.lit(fv.DEFAULT_WIDTH))
    # an index appears with each of its key columns; the group is at most 32
    per_index = (
        indexes.withColumn("attnum", F.explode(F.split("indkey", " ", -1).cast("array<int>")))
        .join(columns, ["db_id", "indrelid", "attnum"])
        .join(stats, ["db_id", "table_schema", "table", "attname"])
        .groupBy(
            "db_id", "indexrelid", "schema", "table", "name",
            "reltuples", "relpages", "amname", "indisprimary", "indexdef",
        )
        .agg(
            F.max(nulls).alias("max_null_frac"),
            F.sum((F.lit(1) - nulls) * width).alias("data_width"),
        )
    )
    out = (
        bloat_estimate(per_index, block_size=block_size, max_align=max_align)
        .where(F.col("bloat_bytes") >= min_bytes)
        .select(
            "db_id", "schema", "table", "name", "bloat_bytes", "index_bytes",
            F.col("indexdef").alias("definition"),
            F.col("indisprimary").alias("primary"),
        )
    )
    return out.orderBy(F.col("bloat_bytes").desc(), "name", "db_id") if ordered else out

