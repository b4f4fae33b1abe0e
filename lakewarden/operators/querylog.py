"""Statement logs: which statements are safe, which ones cost most."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fv
from ..functions.parsing import share
from ..functions.text import mask_credentials
from .skew import salted_lookup, top_per_group

_SPACE = f"[{fv.SPACE_CLASS}]"
# ASCII word limits, whatever \b means to the engine
_WORD_START, _WORD_END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
_FORBIDDEN = (
    rf"{_WORD_START}(?:(?:{'|'.join(fv.FORBIDDEN_WORDS)}){_WORD_END}"
    rf"|create{_SPACE}+(?!extension))"
)

ALLOWED = "allowed"
WRONG_TYPE = "statement type not allowed"
FORBIDDEN = "forbidden operation"


# One pass that knows what it is in: comments, and literals that may hold comment signs.
# Group 1 to 3 is the opening sign of what is kept as an empty literal.
_TOKENS = (
    r"(?s)--[^\n]*+|/\*.*?(?:\*/|\z)"
    r"|(?<![A-Za-z0-9_$])[eE](')(?:[^'\\]|\\.|'')*+(?:'|\z)"
    r"|(')(?:[^']|'')*+(?:'|\z)"
    r'|(")(?:[^"]|"")*+(?:"|\z)'
    r"|(?<![A-Za-z0-9_$])(\$(?:[A-Za-z_][A-Za-z0-9_]*+)?\$).*?(?:\4|\z)"
)


def _without_literals(statement: Column) -> Column:
    """The statement with a blank for each comment and an opening sign for each literal or quoted name."""
    return F.lower(F.btrim(F.regexp_replace(statement, _TOKENS, " $1$2$3$4 "), F.lit(fv.SPACE_CHARS)))


def _bare_statement(statement: Column) -> Column:
    bare = F.regexp_replace(statement, fv.BLOCK_COMMENT, "")
    bare = F.regexp_replace(bare, fv.LINE_COMMENT, "")
    return F.lower(F.btrim(bare, F.lit(fv.SPACE_CHARS)))


def classify_statements(df: DataFrame, column: str, *, strict: bool = False) -> DataFrame:
    """Add ``allowed`` and ``reason`` to a log of SQL texts.

    Read-only statements are allowed: comments left out, the text must start
    with a known word and contain no word that writes, not even in a literal.
    Comments are taken out wherever their signs stand, so a sign inside a
    literal hides what follows it.

    `strict` reads the text once from its start and knows what it is in. Comment
    signs inside literals, quoted names and dollar quotes hide nothing, and
    words inside them do not count. What is not closed reaches to the end; a
    comment inside a comment ends with the first closing sign, so at most too
    much is read as statement.
    """
    bare = df.withColumn("_bare", (_without_literals if strict else _bare_statement)(F.col(column)))
    text = F.col("_bare")
    starts = text.rlike("^(?:" + "|".join(fv.ALLOWED_PREFIXES) + ")")
    writes = text.rlike(_FORBIDDEN)
    reason = (
        F.when(~F.coalesce(starts, F.lit(False)), WRONG_TYPE)
        .when(writes, FORBIDDEN)
        .otherwise(ALLOWED)
    )
    return (
        bare.withColumn("reason", reason)
        .withColumn("allowed", F.col("reason") == ALLOWED)
        .drop("_bare")
    )


def mask_log_credentials(df: DataFrame, column: str) -> DataFrame:
    """Mask passwords of connection strings in a log column."""
    return df.withColumn(column, mask_credentials(F.col(column)))


def normalize_query_stats(df: DataFrame) -> DataFrame:
    """Give statistics of any server version the newer column names.

    Versions before 13 call the times ``total_time``, ``mean_time`` and
    ``stddev_time`` and have no ``wal_bytes``, which is then 0.
    """
    out = df
    for word in ("total", "mean", "stddev"):
        if f"{word}_exec_time" not in out.columns and f"{word}_time" in out.columns:
            out = out.withColumnRenamed(f"{word}_time", f"{word}_exec_time")
    if "wal_bytes" not in out.columns:
        out = out.withColumn("wal_bytes", F.lit(0).cast("decimal(38,0)"))
    return out


def top_queries(df: DataFrame, sort_by: str = "resources", limit: int = fv.TOP_N) -> DataFrame:
    """The slowest or most demanding statements of every database.

    ``total_time`` and ``mean_time`` give the first `limit` statements per
    database, NULL times first. ``resources`` gives all statements with more
    than 5 % of any resource of their database.
    """
    stats = normalize_query_stats(df)
    if sort_by == "resources":
        return _resource_hogs(stats)
    if sort_by not in ("total_time", "mean_time"):
        raise ValueError(f"sort_by must be total_time, mean_time or resources, not {sort_by!r}")
    if limit < 1:
        raise ValueError("limit must be positive")
    time = "total_exec_time" if sort_by == "total_time" else "mean_exec_time"
    order = [F.col(time).desc_nulls_first(), F.col("query")]
    top = top_per_group(stats, ["db_id"], order, limit, spread_by=["query", "calls", time])
    columns = ["db_id", "query", "calls", "total_exec_time", "mean_exec_time", "rows"]
    return top.select(*columns).orderBy("db_id", *order)


def _resource_hogs(stats: DataFrame) -> DataFrame:
    parts = {
        "total_exec_time_frac": F.col("total_exec_time"),
        "shared_blks_accessed_frac": F.col("shared_blks_hit") + F.col("shared_blks_read"),
        "shared_blks_read_frac": F.col("shared_blks_read"),
        "shared_blks_dirtied_frac": F.col("shared_blks_dirtied"),
        "total_wal_bytes_frac": F.col("wal_bytes"),
    }
    # totals by aggregation, not by a window: a window would bring all
    # statements of a database into one task
    totals = stats.groupBy("db_id").agg(*[F.sum(p).alias(f"_{n}") for n, p in parts.items()])
    shares = salted_lookup(stats, totals, ["db_id"], spread_by=["query", "total_exec_time"])
    for name, part in parts.items():
        shares = shares.withColumn(name, share(part, F.col(f"_{name}")))
    exceeds = F.lit(False)
    for name in parts:
        exceeds = exceeds | (F.col(name) > fv.SHARE_LIMIT)
    return (
        shares.where(exceeds)
        .select(
            "db_id", "query", "calls", "rows",
            "total_exec_time", "mean_exec_time", "stddev_exec_time",
            *parts,
            "shared_blks_hit", "shared_blks_read", "shared_blks_dirtied", "wal_bytes",
        )
        .orderBy("db_id", F.col("total_exec_time").desc_nulls_first(), "query")
    )


def query_stats(
    log: DataFrame,
    *,
    keys: tuple[str, ...] = ("db_id", "query"),
    time: str = "exec_time",
    rows: str = "rows",
    sums: tuple[str, ...] = (),
) -> DataFrame:
    """Statement statistics from a raw log of executions, one row per key.

    Calls, total, mean and population deviation of the time, rows, and sums of
    further counters, in the shape `top_queries` reads.
    """
    return log.groupBy(*keys).agg(
        F.count("*").alias("calls"),
        F.sum(time).alias("total_exec_time"),
        F.avg(time).alias("mean_exec_time"),
        F.stddev_pop(time).alias("stddev_exec_time"),
        F.sum(rows).alias("rows"),
        *[F.sum(c).alias(c) for c in sums],
    )


# Running counters: how statistics of a server add up, and which may come from older versions.
_COUNTERS = ("rows", "shared_blks_hit", "shared_blks_read", "shared_blks_dirtied", "wal_bytes")


def counter_increments(
    landed: DataFrame, *, keys: tuple[str, ...] = ("db_id", "query"), at: str = "snapshot_at", counters: tuple[str, ...] = _COUNTERS
) -> DataFrame:
    """What running statistics gained between one landing and the next, one row per key and landing.

    `landed` holds ``calls``, ``mean_exec_time``, ``stddev_exec_time`` (of the
    population) and `counters`, all since the server last reset them, once per
    key and landing time. Reset since the landing before: ``stats_reset``, if
    the rows have it, differs; or calls or total time went down. Then, and at a
    key's first landing, all that is counted is new.

    Times are moments: number, mean, and ``m2``, the sum of squared
    differences from the mean. Of two landings of one run the later moments are
    those of the earlier joined with the increment, which so is their difference.
    """
    stats = normalize_query_stats(landed)
    stats = stats.withColumns({
        "_n": F.col("calls").cast("double"),
        "_m2": F.col("stddev_exec_time").cast("double") * F.col("stddev_exec_time") * F.col("calls"),
        "_total": F.col("mean_exec_time").cast("double") * F.col("calls"),
    })
    order = Window.partitionBy(*keys).orderBy(at)
    marks = ["_n", "_m2", "_total", *counters, *(["stats_reset"] if "stats_reset" in stats.columns else [])]
    both = stats.select("*", *[F.lag(c).over(order).alias(f"_was_{c}") for c in marks], F.lag(at).over(order).alias("since"))
    again = (F.col("_n") < F.col("_was__n")) | (F.col("_total") < F.col("_was__total") * (1 - 1e-12))
    if "stats_reset" in stats.columns:
        again = again | ~F.col("stats_reset").eqNullSafe(F.col("_was_stats_reset"))
    fresh = F.col("_was__n").isNull() | F.coalesce(again, F.lit(False))

    def gained(name: str) -> Column:
        return F.when(fresh, F.col(name)).otherwise(F.col(name) - F.col(f"_was_{name}"))

    n, total = gained("_n"), gained("_total")
    apart = total / F.nullif(n, F.lit(0.0)) - F.col("_was__total") / F.nullif(F.col("_was__n"), F.lit(0.0))
    between = apart * apart * F.col("_was__n") * n / F.nullif(F.col("_n"), F.lit(0.0))
    m2 = F.when(fresh, F.col("_m2")).otherwise(F.greatest(F.col("_m2") - F.col("_was__m2") - F.coalesce(between, F.lit(0.0)), F.lit(0.0)))
    return both.select(
        *keys, "since", F.col(at), n.cast("bigint").alias("calls"), total.alias("total_exec_time"), m2.alias("m2"),
        *[gained(c).alias(c) for c in counters], fresh.alias("reset"),
    )


def merge_moments(parts: DataFrame, keys: tuple[str, ...], sums: tuple[str, ...] = ()) -> DataFrame:
    """One row per key from rows of ``calls``, ``total_exec_time`` and ``m2``, in any order and grouping.

    Only sums are taken, so they are partial before the shuffle: squared
    differences from the common mean are those from each part's own mean and
    those of the parts' means.
    """
    n, total = F.col("calls").cast("double"), F.col("total_exec_time")
    square = F.coalesce(total * total / F.nullif(n, F.lit(0.0)), F.lit(0.0))
    grouped = parts.select(*keys, "calls", "total_exec_time", "m2", square.alias("_square"), *sums).groupBy(*keys).agg(
        F.sum("calls").alias("calls"), F.sum("total_exec_time").alias("total_exec_time"), F.sum("m2").alias("_m2"),
        F.sum("_square").alias("_square"), *[F.sum(c).alias(c) for c in sums],
    )
    mean = F.col("total_exec_time") / F.nullif(F.col("calls"), F.lit(0))
    m2 = F.greatest(F.col("_m2") + F.col("_square") - F.col("total_exec_time") * F.coalesce(mean, F.lit(0.0)), F.lit(0.0))
    return grouped.select(
        *keys, "calls", "total_exec_time", mean.alias("mean_exec_time"),
        F.sqrt(m2 / F.nullif(F.col("calls"), F.lit(0))).alias("stddev_exec_time"), *sums,
    )


def counter_stats(
    landed: DataFrame, *, keys: tuple[str, ...] = ("db_id", "query"), at: str = "snapshot_at", counters: tuple[str, ...] = _COUNTERS
) -> DataFrame:
    """Statement statistics over all landings of running counters, resets counted in, as `query_stats` has them of a log."""
    gained = counter_increments(landed, keys=keys, at=at, counters=counters)
    return merge_moments(gained, keys, counters)
