"""Run a read-only SELECT over registered views and return a bounded, displayable result."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.errors import ParseException
from pyspark.sql import DataFrame, SparkSession

from nearfield.errors import UnsafeQueryError
from nearfield.functions.text import display_value

# Rows returned at most, and width of a shown value.
MAX_ROWS = 100
VALUE_WIDTH = 500
# Expressions that call any Java method, and plans that run a program.
REFLECTIVE, NAMES = frozenset(["CallMethodViaReflection", "TryReflect"]), frozenset(["reflect", "java_method", "try_reflect"])
PROGRAMS = frozenset(["ScriptTransformation"])


@dataclass(frozen=True)
class BoundedResult:
    columns: list[str]
    rows: list[dict]
    row_count: int
    truncated: bool


def check_select(spark: SparkSession, sql: str) -> None:
    """An error unless the text is one query that reads registered tables and views and starts nothing else.

    What counts is the plan that Spark makes of it, views and subqueries included, not the words it is written in.
    """
    state = spark._jsparkSession.sessionState()
    try:
        parsed = state.sqlParser().parsePlan(sql.strip().rstrip(";"))
    except ParseException as error:
        raise UnsafeQueryError(f"only one query is allowed: {error.getCondition()}") from error
    if parsed.nodeName() == "UnresolvedWith":
        raise UnsafeQueryError("only queries that start with SELECT are allowed")
    # statements of other kinds and functions by name first, since the analysis looks tables and classes up
    logical = "org.apache.spark.sql.catalyst.plans.logical"
    kinds = [spark._jvm.java.lang.Class.forName(f"{logical}.{name}") for name in ("Command", "ParsedStatement")]
    for node in _nodes(parsed):
        if any(kind.isInstance(node) for kind in kinds):
            raise UnsafeQueryError("only SELECT queries are allowed")
        for expression in _all(node.expressions()):
            if expression.nodeName() == "UnresolvedFunction" and expression.nameParts().last().lower() in NAMES:
                raise UnsafeQueryError(f"forbidden function {expression.nameParts().last()}")
        # files that nobody registered are not even opened
        if node.nodeName() == "UnresolvedRelation" and node.multipartIdentifier().size() > 1:
            first = node.multipartIdentifier().apply(0)
            if not spark.catalog.databaseExists(first):
                raise UnsafeQueryError(f"only registered tables are allowed, not {first}")
    # skipped: a command is analysed, but not run
    skip = spark._jvm.org.apache.spark.sql.execution.CommandExecutionMode.SKIP()
    analysed = state.executePlan(parsed, skip).analyzed()
    for node in _nodes(analysed):
        if kinds[0].isInstance(node) or node.nodeName() in PROGRAMS:
            raise UnsafeQueryError("only SELECT queries are allowed")
        for expression in _all(node.expressions()):
            if expression.getClass().getSimpleName() in REFLECTIVE:
                raise UnsafeQueryError(f"forbidden function {expression.prettyName()}")


def _each(found) -> Iterator:
    """The elements of a Scala sequence."""
    return (found.apply(i) for i in range(found.size()))


def _all(expressions) -> Iterator:
    todo = list(_each(expressions))
    while todo:
        one = todo.pop()
        yield one
        todo += _each(one.children())


def _nodes(plan) -> Iterator:
    """All nodes of a plan, with those of its subqueries and common table expressions."""
    todo = [plan]
    while todo:
        node = todo.pop()
        yield node
        todo += _each(node.children())
        todo += _each(node.subqueries())
        todo += (one for one in _each(node.innerChildren()) if _is_plan(one))


def _is_plan(one) -> bool:
    return hasattr(one, "getClass") and one.getClass().getName().startswith("org.apache.spark.sql.catalyst.plans.logical")


def bounded_query(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> DataFrame:
    """The checked query as text columns, with one row more than shown so that a cut is noticed."""
    check_select(spark, sql)
    result = spark.sql(sql.strip().rstrip(";"))
    # the limit comes last, so that Spark stops reading once it has enough rows
    return result.select(*[display_value(f, VALUE_WIDTH) for f in result.schema.fields]).limit(max_rows + 1)


def run_bounded(spark: SparkSession, sql: str, max_rows: int = MAX_ROWS) -> BoundedResult:
    shown = bounded_query(spark, sql, max_rows)
    rows = shown.collect()  # at most max_rows + 1
    kept = [r.asDict() for r in rows[:max_rows]]
    return BoundedResult(shown.columns, kept, len(kept), len(rows) > max_rows)
