"""Health checks over statistics snapshots, and the report that joins them."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.parsing import seconds_between, sequence_name
from ..sources.shared import shared_folder
from . import indexes as ix
from .skew import id_or_none, with_schema_name

# The kinds of checks.
HEALTH_TYPES: tuple[str, ...] = (
    "index", "connection", "vacuum", "sequence", "replication", "buffer", "constraint",
)


def _every(databases: DataFrame | None, found: DataFrame) -> DataFrame:
    """A row for every database, with NULLs for those without findings."""
    if databases is None:
        return found
    return databases.select("db_id").distinct().join(found, "db_id", "left")


def connection_health(activity: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Connections per database; too many in total is said before too many idle.

    With `databases` (column ``db_id``) those without a connection have a row, too.
    """
    total, idle = F.col("total"), F.col("idle_in_transaction")
    verdict = (
        F.when(total > fv.MAX_CONNECTIONS, "too many connections")
        .when(idle > fv.MAX_IDLE_IN_TRANSACTION, "too many idle in transaction")
        .otherwise("healthy")
    )
    found = activity.groupBy("db_id").agg(
        F.count("*").alias("total"),
        F.count_if(F.col("state") == "idle in transaction").alias("idle_in_transaction"),
    )
    return _every(databases, found).fillna(0, ["total", "idle_in_transaction"]).withColumn("verdict", verdict)


def wraparound_headroom(
    pg_class: DataFrame, pg_namespace: DataFrame, *, threshold: int = fv.MIN_XID_LEFT,
    ordered: bool = True,
) -> DataFrame:
    """Ordinary tables with few transaction ids left, their overflow table counted in.

    The worst come first if `ordered`.
    """
    out = _wraparound(ix.named_classes(pg_class, pg_namespace), threshold)
    return out.orderBy("transactions_left", "schema", "table", "db_id") if ordered else out


def _wraparound(classes: DataFrame, threshold: int) -> DataFrame:
    toast = classes.select("db_id", F.col("oid").alias("_toast"), F.col("xid_age").alias("toast_age"))
    # greatest() skips a missing overflow table
    left = F.lit(fv.MAX_XID) - F.greatest("xid_age", "toast_age")
    return (
        classes.where((F.col("relkind") == "r") & F.col("schema").isNotNull())
        .withColumn("_toast", id_or_none("reltoastrelid", "oid"))
        .join(toast, ["db_id", "_toast"], "left")
        .withColumn("transactions_left", left)
        .where(F.col("transactions_left") < threshold)
        .select("db_id", "schema", F.col("relname").alias("table"), "transactions_left")
    )


def sequence_discovery(
    pg_attribute: DataFrame, pg_class: DataFrame, pg_namespace: DataFrame, pg_attrdef: DataFrame
) -> DataFrame:
    """Columns filled from a sequence, with the sequence they name."""
    return _sequences_of(pg_attribute, ix.named_classes(pg_class, pg_namespace), pg_attrdef)


def _sequences_of(pg_attribute: DataFrame, classes: DataFrame, pg_attrdef: DataFrame) -> DataFrame:
    defaults = pg_attrdef.where(F.col("default_value").like("nextval%")).select(
        "db_id", F.col("adrelid").alias("attrelid"), F.col("adnum").alias("attnum"), "default_value"
    )
    columns = pg_attribute.where(~F.col("attisdropped") & (F.col("attnum") > 0))
    # tables of temporary schemas, and those of none that is known, are left out
    tables = classes.where(~F.col("schema").like(r"pg\_temp\_%")).select(
        "db_id", F.col("oid").alias("attrelid"), F.col("relname").alias("table"), F.col("schema").alias("table_schema")
    )
    schema, sequence = sequence_name(F.col("default_value"))
    fed = columns.join(defaults, ["db_id", "attrelid", "attnum"]).join(tables, ["db_id", "attrelid"])
    return fed.select(
        "db_id", "table_schema", "table", F.col("attname").alias("column"), "column_type",
        schema.alias("sequence_schema"), sequence.alias("sequence_name"),
    ).where(F.col("sequence_name") != "")


def sequence_limit(column_type: Column, strict_types: bool = False) -> Column:
    """Largest value the column can hold, as a double.

    Everything but ``integer`` is judged as bigint; `strict_types` also knows
    ``smallint``.
    """
    limit = F.when(column_type == "integer", F.lit(float(fv.INTEGER_MAX)))
    if strict_types:
        limit = limit.when(column_type == "smallint", F.lit(float(fv.SMALLINT_MAX)))
    return limit.otherwise(F.lit(float(fv.BIGINT_MAX)))


def sequence_headroom(
    discovered: DataFrame,
    sequences: DataFrame,
    *,
    threshold: float = fv.SEQUENCE_LIMIT,
    strict_types: bool = False,
    ordered: bool = True,
) -> DataFrame:
    """Sequences that used more than `threshold` of their column's range.

    Those with the least left come first if `ordered`.
    """
    state = sequences.where("readable").select(
        "db_id", F.col("schemaname").alias("sequence_schema"),
        F.col("sequencename").alias("sequence_name"), "last_value",
    )
    used = F.coalesce("last_value", F.lit(0)).cast("double")
    out = (
        discovered.join(state, ["db_id", "sequence_schema", "sequence_name"])
        .withColumn("max_value", sequence_limit(F.col("column_type"), strict_types))
        .withColumn("used", used / F.col("max_value"))
        .withColumn("remaining", F.col("max_value") - used)
        .where(F.col("used") > threshold)
        .select(
            "db_id", "sequence_schema", "sequence_name", "table", "column", "column_type",
            "last_value", "max_value", "used", "remaining",
        )
    )
    return out.orderBy("remaining", "sequence_schema", "sequence_name", "db_id") if ordered else out


def replication_lag(state: DataFrame, as_of: Column) -> DataFrame:
    """Role, connection and lag of every server at the time `as_of`.

    `as_of` has the type of ``last_replay_at``, with or without a time zone.
    The lag is 0 on a primary and when all that was received is replayed.
    """
    role = F.when(F.col("in_recovery"), "replica").otherwise("primary")
    behind = seconds_between(as_of, F.col("last_replay_at"))
    caught_up = ~F.col("in_recovery") | (F.col("receive_lsn") == F.col("replay_lsn"))
    lag = F.coalesce(F.when(caught_up, F.lit(0.0)).otherwise(behind), F.lit(0.0))
    return state.select(
        "db_id",
        role.alias("role"),
        (F.col("senders") > 0).alias("replicating"),
        F.when(F.col("in_recovery"), lag).alias("lag_seconds"),
    )


def replication_slots(slots: DataFrame) -> DataFrame:
    """Replication slots with their state in words."""
    return slots.select(
        "db_id", "slot_name", "database",
        F.when(F.col("active"), "active").otherwise("inactive").alias("status"),
    )


def _hit_rate(statio: DataFrame, prefix: str, databases: DataFrame | None) -> DataFrame:
    hit, read = F.col(f"{prefix}_blks_hit"), F.col(f"{prefix}_blks_read")
    verdict = (
        F.when(F.col("rate").isNull(), "no statistics")
        .when(F.col("rate") >= fv.HIT_RATE_LIMIT, "above threshold")
        .otherwise("below threshold")
    )
    found = statio.groupBy("db_id").agg((F.sum(hit) / F.nullif(F.sum(hit + read), F.lit(0))).alias("rate"))
    return _every(databases, found).withColumn("verdict", verdict)


def index_hit_rate(statio: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Share of index blocks found in cache; of `databases` without statistics NULL."""
    return _hit_rate(statio, "idx", databases)


def table_hit_rate(statio: DataFrame, databases: DataFrame | None = None) -> DataFrame:
    """Share of table blocks found in cache; of `databases` without statistics NULL."""
    return _hit_rate(statio, "heap", databases)


def unvalidated_constraints(
    pg_constraint: DataFrame, pg_class: DataFrame, pg_namespace: DataFrame
) -> DataFrame:
    """Constraints never checked against the rows already there."""
    return _unvalidated(pg_constraint, ix.named_classes(pg_class, pg_namespace), pg_namespace)


def _unvalidated(pg_constraint: DataFrame, classes: DataFrame, pg_namespace: DataFrame) -> DataFrame:
    tables = classes.select("db_id", F.col("oid").alias("conrelid"), F.col("relname").alias("table"))
    referenced = classes.select(
        "db_id", F.col("oid").alias("_referenced"), F.col("relname").alias("referenced_table"),
        F.col("schema").alias("referenced_schema"),
    )
    unchecked = (
        pg_constraint.where(~F.col("convalidated"))
        .withColumn("_referenced", id_or_none("confrelid", "oid"))
        .join(tables, ["db_id", "conrelid"])
        .join(referenced, ["db_id", "_referenced"], "left")
    )
    unchecked = with_schema_name(unchecked, pg_namespace, "connamespace", "schema", ["oid"], "left")
    return unchecked.select("db_id", "schema", "table", F.col("conname").alias("name"), "referenced_schema", "referenced_table")


# ---- report -----------------------------------------------------------------


def parse_health_types(types: str) -> list[str]:
    """Names of a comma-separated list; ``all`` stands for every type."""
    names = [t.strip() for t in types.split(",")]
    unknown = [t for t in names if t not in HEALTH_TYPES and t != "all"]
    if unknown:
        raise ValueError(
            f"invalid health types: {', '.join(unknown)}; valid are {', '.join(HEALTH_TYPES)}, all"
        )
    return [t for t in HEALTH_TYPES if "all" in names or t in names]


def dotted(*names: str) -> Column:
    return F.concat_ws(".", *names)


def _finding(
    df: DataFrame, check: str, obj: Column, metric: str | Column, value: Column,
    threshold: float | Column | None, status: Column, detail: Column | None = None,
) -> DataFrame:
    return df.select(
        "db_id",
        F.lit(check).alias("check"),
        obj.alias("object"),
        F.lit(metric).alias("metric"),
        value.cast("double").alias("value"),
        F.lit(threshold).cast("double").alias("threshold"),
        status.alias("status"),
        (F.lit(None) if detail is None else detail).cast("string").alias("detail"),
    )


def _kept(df: DataFrame, purpose: str) -> DataFrame:
    """The frame, written to the shared folder, so that several checks read it and none makes it again."""
    path = shared_folder(df.sparkSession, f"health-{purpose}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def health_report(
    snapshots: Mapping[str, DataFrame], as_of: Column, types: str = "all"
) -> DataFrame:
    """Run the chosen checks and stack their findings.

    One row per finding: ``db_id, check, object, metric, value, threshold,
    status, detail``. Checks of tables and indexes give rows only for what
    fails, checks of a whole server one row each. The result is one plan, so
    Spark runs the checks side by side; names of tables and the inventory of
    indexes, which several checks need, are written first, in two jobs. If the snapshots hold `databases`, as those
    of `read_snapshots` do, each of them has its rows for connections and cache,
    with or without statistics. `as_of` is the time of the snapshot: a
    report over landed data is the same whenever it is run.
    """
    s = snapshots
    warn = F.lit("warning")
    found: list[DataFrame] = []
    chosen = parse_health_types(types)
    classes = indexes = None
    if {"index", "vacuum", "sequence", "constraint"} & set(chosen):
        # what several checks read is made once
        classes = _kept(ix.named_classes(s["pg_class"], s["pg_namespace"]), "classes")
    if "index" in chosen:
        indexes = _kept(ix.indexes_with_tables(s["pg_index"], classes, s["pg_stat_user_indexes"]), "indexes")
        inventory = ix.inventory_of(indexes)
        name = dotted("schema", "table", "name")
        found.append(
            _finding(ix.invalid_indexes(inventory), "invalid_index", name, "valid", F.lit(0), None, warn)
        )
        found.append(
            _finding(
                ix.duplicate_indexes(inventory, ordered=False), "duplicate_index", dotted("schema", "table", "unneeded"),
                "columns", F.size("columns"), None, warn, F.col("covering"),
            )
        )
        bloat = ix.bloat_of(indexes, s["pg_am"], s["pg_attribute"], s["pg_stats"], ordered=False)
        found.append(
            _finding(bloat, "index_bloat", name, "bloat_bytes", F.col("bloat_bytes"), fv.MIN_BLOAT_BYTES, warn)
        )
        unused = ix.unused_indexes(s["pg_index"], s["pg_stat_user_indexes"], ordered=False)
        found.append(
            _finding(unused, "unused_index", name, "index_scans", F.col("index_scans"), fv.MAX_RARE_SCANS, warn)
        )
    if "connection" in chosen:
        idle = F.col("verdict") == "too many idle in transaction"
        found.append(
            _finding(
                connection_health(s["pg_stat_activity"], s.get("databases")), "connection", F.lit("connections"),
                F.when(idle, "idle_in_transaction").otherwise("total"),
                F.when(idle, F.col("idle_in_transaction")).otherwise(F.col("total")),
                F.when(idle, fv.MAX_IDLE_IN_TRANSACTION).otherwise(fv.MAX_CONNECTIONS),
                F.when(F.col("verdict") == "healthy", "ok").otherwise("warning"),
                F.col("verdict"),
            )
        )
    if "vacuum" in chosen:
        found.append(
            _finding(
                _wraparound(classes, fv.MIN_XID_LEFT), "vacuum", dotted("schema", "table"),
                "transactions_left", F.col("transactions_left"), fv.MIN_XID_LEFT, warn,
            )
        )
    if "sequence" in chosen:
        discovered = _sequences_of(s["pg_attribute"], classes, s["pg_attrdef"])
        found.append(
            _finding(
                sequence_headroom(discovered, s["pg_sequences"], ordered=False), "sequence",
                dotted("sequence_schema", "sequence_name"), "used", F.col("used"), fv.SEQUENCE_LIMIT,
                warn, dotted("table", "column"),
            )
        )
    if "replication" in chosen:
        state = replication_lag(s["replication_state"], as_of)
        late = (F.col("role") == "replica") & ((F.col("lag_seconds") > 0) | ~F.col("replicating"))
        found.append(
            _finding(
                state, "replication", F.col("role"), "lag_seconds", F.col("lag_seconds"), 0.0,
                F.when(late, "warning").otherwise("ok"),
                F.when(F.col("replicating"), "replicating").otherwise("not replicating"),
            )
        )
        slots = replication_slots(s["pg_replication_slots"])
        found.append(
            _finding(
                slots, "replication_slot", F.col("slot_name"), "active",
                (F.col("status") == "active").cast("int"), None,
                F.when(F.col("status") == "active", "ok").otherwise("warning"), F.col("database"),
            )
        )
    if "buffer" in chosen:
        for check, df in (
            ("index_hit_rate", index_hit_rate(s["pg_statio_user_indexes"], s.get("databases"))),
            ("table_hit_rate", table_hit_rate(s["pg_statio_user_tables"], s.get("databases"))),
        ):
            status = F.when(F.col("verdict") == "below threshold", "warning").otherwise("ok")
            found.append(
                _finding(df, check, F.lit("cache"), "rate", F.col("rate"), fv.HIT_RATE_LIMIT, status, F.col("verdict"))
            )
    if "constraint" in chosen:
        found.append(
            _finding(
                _unvalidated(s["pg_constraint"], classes, s["pg_namespace"]),
                "constraint", dotted("schema", "table", "name"), "validated", F.lit(0), None, warn,
                F.when(F.col("referenced_table").isNotNull(), dotted("referenced_schema", "referenced_table")),
            )
        )
    return reduce(DataFrame.unionByName, found)
