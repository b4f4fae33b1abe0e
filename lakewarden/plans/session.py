"""SQL over named tables, as they are or with sensitive columns masked."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.detectors import DETECTORS, Detector
from ..functions.fixed_values import PII_KEYWORDS
from ..operators.redact import mask_columns, mask_policy, pii_columns, redact
from .statements import bare_statement, check_read_only, named_parameters, without_tail

_HANDOFF = "lakewarden_handoff_"


class UnmaskedAccess(PermissionError):
    """An anonymised statement reaches for something that is not a masked view."""


def run_sql(
    spark: SparkSession,
    sql: str,
    args: list | dict | None = None,
    *,
    anonymize: bool = False,
    restricted: bool = True,
    tables: Mapping[str, DataFrame] | None = None,
    policy: DataFrame | None = None,
    classify: bool = True,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """Run a statement over the session's views; lazy, like ``spark.sql``.

    `restricted` lets only read statements through. Positional parameters are
    written ``$1, $2`` (or ``?``), named ones ``:name``.

    With `anonymize` the statement sees nothing but masked views of `tables`
    under their own names, and its result is redacted as well. Columns are
    masked by name and by `policy`; without one, with `classify`, by value,
    for which the columns the statement uses are read once. To run many
    statements keep a `mask_policy` or a `masked_session`.

    A restricted statement may call nothing in the engine's process and read no
    file by its path.
    """
    if isinstance(args, (list, tuple)):
        sql, args = named_parameters(sql, list(args))
    if restricted or anonymize:
        check_read_only(sql)
    if not anonymize:
        if restricted and bare_statement(sql).startswith(_QUERY):
            _refuse_unsafe(_as_query(spark, sql, args)._jdf.queryExecution().analyzed())
        return _sql(spark, sql, args)
    tables, keywords, detectors = tables or {}, tuple(keywords), tuple(detectors)
    session = masked_session(spark, tables, policy=policy, classify=False, keywords=keywords)
    views = _views_named(session, sql, args)
    if policy is None and classify:
        named = {}
        for name, df in tables.items():
            used = views.get(name.lower(), set())
            columns = [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() in used]
            if columns:
                named[name] = df.select(*columns)
        if named:
            found = mask_policy(named, keywords=keywords, detectors=detectors)
            whole = {name: tables[name] for name in named}
            _register(spark, session, whole, found, keywords)
    return redact(_sql(session, sql, args), nested=True, keywords=keywords, detectors=detectors)


def masked_session(
    spark: SparkSession,
    tables: Mapping[str, DataFrame],
    *,
    policy: DataFrame | None = None,
    classify: bool = True,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> SparkSession:
    """A session whose only views are `tables` with sensitive columns masked.

    Masking happens in the views, below any predicate, join or aggregate of a
    later statement; Catalyst then prunes masked columns from the scans.
    Columns sensitive by name are always masked, and those `policy` lists.
    Without a policy `classify` finds them by `mask_policy`, which reads the
    tables once; keep its result to save that.
    """
    keywords = tuple(keywords)
    if policy is None and classify and tables:
        policy = mask_policy(tables, keywords=keywords, detectors=tuple(detectors))
    session = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.sql.") and session.conf.isModifiable(key):
            session.conf.set(key, value)
    session.conf.set("spark.sql.runSQLOnFiles", "false")
    _register(spark, session, tables, policy, keywords)
    return session


def _register(
    spark: SparkSession,
    session: SparkSession,
    tables: Mapping[str, DataFrame],
    policy: DataFrame | None,
    keywords: Iterable[str],
) -> None:
    """Put masked views of `tables` into `session`.

    The policy has at most one row per column and is the only thing collected.
    """
    masked = {name.lower(): pii_columns(df, keywords) for name, df in tables.items()}
    listed = [] if policy is None else policy.select("table_name", "column_name").collect()
    for row in listed:
        masked.setdefault(row.table_name.lower(), []).append(row.column_name)
    for name, df in tables.items():
        # sessions share global views only; the view is dropped as soon as the
        # masked one stands, and its name cannot be guessed meanwhile
        handoff = _HANDOFF + uuid.uuid4().hex
        df.createOrReplaceGlobalTempView(handoff)
        try:
            source = session.table(f"global_temp.{handoff}")
            mask_columns(source, masked[name.lower()], keywords).createOrReplaceTempView(name)
        finally:
            spark.catalog.dropGlobalTempView(handoff)


def run_masked(
    session: SparkSession,
    sql: str,
    args: dict | list | None = None,
    *,
    keywords: Iterable[str] = PII_KEYWORDS,
    detectors: Iterable[Detector] = DETECTORS,
) -> DataFrame:
    """Run a query in a masked session and redact what it returns."""
    _views_named(session, sql, args)
    return redact(_sql(session, sql, args), nested=True, keywords=keywords, detectors=detectors)


_QUERY = ("select", "with ")


def _sql(session: SparkSession, sql: str, args: dict | list | None) -> DataFrame:
    return session.sql(sql, args=args) if args else session.sql(sql)


def _as_query(session: SparkSession, sql: str, args: dict | list | None) -> DataFrame:
    """The statement as a subquery, where Spark's grammar takes nothing but queries.

    The guard reads text, which a comment sign inside a literal can mislead;
    the parser cannot be. Nothing is executed.
    """
    return _sql(session, f"SELECT * FROM (\n{without_tail(sql)}\n)", args)


def _views_named(session: SparkSession, sql: str, args: dict | list | None) -> dict[str, set[str]]:
    """The masked views a statement reads, if it is a query and reads nothing else, each with the columns it uses."""
    check_read_only(sql)
    if not bare_statement(sql).startswith(_QUERY):
        raise UnmaskedAccess("only queries may be anonymised")
    views, references = [], []
    _read_below(_as_query(session, sql, args)._jdf.queryExecution().analyzed(), views, references)
    found: dict[str, set[str]] = {}
    for name, attributes in views:
        used = {a.name().lower() for a in attributes if any(r.contains(a) for r in references)}
        found.setdefault(name, set()).update(used)
    return found


# Plan nodes that read nothing but the statement itself.
_OWN_LEAVES = {"LocalRelation", "OneRowRelation", "Range", "CTERelationRef", "UnionLoopRef"}


def _read_below(plan, views: list, references: list) -> None:
    """Collects the masked views a plan reads, and what its nodes refer to; fails if it reads anything else.

    Subqueries are looked into as well. The masked views are the only views of
    the session without a database. Other views are refused, and so is any
    leaf that is a catalog table or a file.
    """
    name = plan.nodeName()
    children = plan.children()
    if name == "View":
        identifier = plan.desc().identifier()
        foreign = not identifier.database().isEmpty()
        if not foreign:
            views.append((identifier.table().lower(), _items(plan.output())))
            return
    else:
        foreign = children.isEmpty() and name not in _OWN_LEAVES
    if foreign:
        raise UnmaskedAccess("the statement reads a relation that is not a masked view")
    references.append(plan.references())
    for expression in _items(plan.expressions()):
        _refuse_reflection(expression)
    for below in (*_items(children), *_items(plan.subqueries())):
        _read_below(below, views, references)


def _refuse_unsafe(plan) -> None:
    """For statements that read unmasked: no call into the engine's process, no file by its path."""
    name = plan.nodeName()
    if name == "View":
        return
    if name == "LogicalRelation" and plan.catalogTable().isEmpty():
        raise UnmaskedAccess("files are read through views or tables only")
    for expression in _items(plan.expressions()):
        _refuse_reflection(expression)
    for below in (*_items(plan.children()), *_items(plan.subqueries())):
        _refuse_unsafe(below)


def _refuse_reflection(expression) -> None:
    """Functions that call into the engine's process could read around the views."""
    if expression.getClass().getSimpleName() == "CallMethodViaReflection":
        raise UnmaskedAccess("function not allowed")
    for child in _items(expression.children()):
        _refuse_reflection(child)


def _items(sequence) -> list:
    return [sequence.apply(i) for i in range(sequence.length())]
