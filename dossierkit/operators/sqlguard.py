"""Guarded read-only SQL over the archive's tables.

The statement is parsed, not run, and its plan is walked whole: expressions,
common table expressions and what EXPLAIN hides included. Only node classes on
the list of permitted ones pass, relations must be the registered tables, and
functions that reach into the JVM or the file system are refused.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Logical plan nodes a read-only query may consist of.
PERMITTED = {
    "Project", "Filter", "Aggregate", "Sort", "GlobalLimit", "LocalLimit", "Limit", "Offset", "Distinct", "Union", "Intersect", "Except", "Join", "LateralJoin", "SubqueryAlias", "UnresolvedSubqueryColumnAliases",
    "UnresolvedRelation", "UnresolvedInlineTable", "LocalRelation", "OneRowRelation", "UnresolvedWith", "CTERelationDef", "WithCTE", "UnresolvedHaving", "Generate", "WithWindowDefinition", "Window", "Pivot",
    "Unpivot", "Sample", "UnresolvedHint", "Range", "UnresolvedTVFAliases", "ExplainCommand", "UnresolvedWithinGroup", "Tail", "UnresolvedOrdinal", "ResolvedInlineTable", "UnresolvedPivot", "UnresolvedTransposeRelation",
}
REFUSED_FUNCTIONS = {"reflect", "java_method", "try_reflect", "input_file_name", "input_file_block_start", "input_file_block_length", "current_user", "session_user", "user", "version", "sleep", "raise_error"}
TABLES = ("documents", "artifacts", "chunks")


class Refused(ValueError):
    """Why a statement may not run."""


def _items(scala) -> list:  # noqa: ANN001
    it, out = scala.iterator(), []
    while it.hasNext():
        out.append(it.next())
    return out


def validate(spark: SparkSession, sql: str, tables: tuple[str, ...] | list[str]) -> None:
    """Raise Refused unless ``sql`` is one read-only statement over ``tables``."""
    if not sql or not sql.strip():
        raise Refused("the statement is empty")
    text = sql.strip()
    while text.endswith(";"):
        text = text[:-1].rstrip()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    except (Py4JJavaError, PySparkException) as e:
        raise Refused(f"not one readable statement: {str(e).splitlines()[0][:200]}") from None
    logical, holds_plan = (spark._jvm.java.lang.Class.forName(f"org.apache.spark.sql.catalyst.{c}") for c in ("plans.logical.LogicalPlan", "expressions.PlanExpression"))
    names: set[str] = set()
    relations: set[str] = set()
    seen: list = [plan]
    while seen:
        node = seen.pop()
        kind = node.getClass().getSimpleName()
        is_plan = logical.isInstance(node)
        if is_plan:
            if kind not in PERMITTED:
                raise Refused(f"only queries may run, not {kind}")
            if kind == "UnresolvedRelation":
                relations.add(".".join(_items(node.multipartIdentifier())).lower())
            if kind == "UnresolvedWith":
                for pair in _items(node.cteRelations()):
                    names.add(pair._1().lower())
                    seen.append(pair._2())
            if kind == "ExplainCommand":
                seen.append(node.logicalPlan())
            seen += _items(node.expressions())
        else:
            if kind == "UnresolvedFunction":
                called = ".".join(_items(node.nameParts())).lower()
                if called.split(".")[-1] in REFUSED_FUNCTIONS:
                    raise Refused(f"the function {called} may not be called")
            if kind == "UnresolvedTableValuedFunction":
                raise Refused("table functions may not be called")
            if holds_plan.isInstance(node):
                seen.append(node.plan())
        seen += _items(node.children())
        seen += [x for x in _items(node.innerChildren()) if kind not in ("UnresolvedWith",)]
    unknown = relations - names - {t.lower() for t in tables}
    if unknown:
        raise Refused(f"no such table: {', '.join(sorted(unknown))}")


@dataclass(frozen=True)
class SqlResult:
    columns: list[str] = field(default_factory=list)
    rows: list[dict] = field(default_factory=list)
    row_count: int = 0
    truncated: bool = False
    error: str | None = None


def isolated(spark: SparkSession, tables: dict[str, DataFrame]) -> SparkSession:
    """A session with nothing but the given tables as views, in which paths are no relations."""
    child = spark.newSession()
    child.conf.set("spark.sql.runSQLOnFiles", "false")
    for name, df in tables.items():
        # the plan moves over as it is; nothing is computed
        child_df = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(child._jsparkSession, df._jdf.queryExecution().logical()), child)
        child_df.createOrReplaceTempView(name)
    return child


def frame(spark: SparkSession, sql: str, tables: dict[str, DataFrame]) -> DataFrame:
    """The validated query as a DataFrame of an isolated session."""
    child = isolated(spark, tables)
    validate(child, sql, list(tables))
    return child.sql(sql.strip().rstrip(";"))


def run_sql(spark: SparkSession, sql: str, tables: dict[str, DataFrame], max_rows: int = 200) -> SqlResult:
    """At most ``max_rows`` rows as JSON objects, nulls kept; whatever goes wrong comes back as ``error``."""
    try:
        df = frame(spark, sql, tables)
        names = [F.struct(*[F.col(f"`{c}`") for c in df.columns])] if df.columns else []
        found = [r[0] for r in df.select(F.to_json(names[0], {"ignoreNullFields": "false"})).limit(max_rows + 1).collect()] if names else []
        rows = [json.loads(x) for x in found[:max_rows]]
        return SqlResult(df.columns, rows, len(rows), len(found) > max_rows)
    except Exception as e:  # noqa: BLE001
        return SqlResult(error=str(e).splitlines()[0][:500] if str(e) else type(e).__name__)


def describe_schema(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, position, column_name, type, nullable) of the given tables."""
    rows = [(t, i, f.name, f.dataType.simpleString(), f.nullable) for t, df in sorted(tables.items()) for i, f in enumerate(df.schema.fields)]
    return spark.createDataFrame(rows, "table_name string, position int, column_name string, type string, nullable boolean")
