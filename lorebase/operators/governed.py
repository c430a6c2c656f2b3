"""Governed read-only SQL: statements see only tenant-scoped views.

Isolation comes from the views, not from rewriting text: each view filters the tenant below any
aggregation and projects the allowed columns, in a session of its own that cannot open files.
Spark's own parser supplies the statement tree for the remaining rules.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# fixed values: permitted functions and the row limit
FUNCTIONS = ("avg", "coalesce", "count", "date_trunc", "lower", "max", "min", "sum", "upper")
MAX_ROWS = 200
PLAN_NODES = (
    "UnresolvedWith", "SubqueryAlias", "Project", "Aggregate", "Filter", "Join", "Sort",
    "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Union", "UnresolvedHaving",
)


class StatementDenied(ValueError):
    """A statement outside the rules; ``code`` says which rule."""

    def __init__(self, code: str, detail: str = "") -> None:
        super().__init__(f"{code}: {detail}" if detail else code)
        self.code = code


@dataclass(frozen=True)
class ScopedTable:
    """How to open a table, which columns may be read, and which column holds the tenant."""

    open: Callable[[SparkSession], DataFrame]
    columns: tuple[str, ...]
    tenant_column: str = "tenant_id"


def _nodes(value) -> Iterator[dict]:
    if isinstance(value, list):
        for item in value:
            yield from _nodes(item)
    elif isinstance(value, dict):
        if "class" in value:
            yield value
        for item in value.values():
            yield from _nodes(item)


@dataclass
class GovernedSql:
    spark: SparkSession
    tables: dict[str, ScopedTable]
    functions: tuple[str, ...] = FUNCTIONS
    max_rows: int = MAX_ROWS
    _sessions: dict[str, SparkSession] = field(default_factory=dict)

    def _session(self, tenant: str) -> SparkSession:
        if tenant not in self._sessions:
            session = self.spark.newSession()
            session.conf.set("spark.sql.runSQLOnFiles", "false")
            for name, scoped in self.tables.items():
                source = scoped.open(session)
                source.filter(F.col(scoped.tenant_column) == F.lit(tenant)).select(
                    *scoped.columns
                ).createOrReplaceTempView(name)
            self._sessions[tenant] = session
        return self._sessions[tenant]

    def check(self, statement: str) -> None:
        try:
            plan = self.spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
        except Exception as error:  # the parser raises Py4J-wrapped errors
            raise StatementDenied("sql_invalid", str(error).splitlines()[0]) from error
        if plan.getClass().getSimpleName() not in PLAN_NODES:
            raise StatementDenied("sql_not_read_only", plan.getClass().getSimpleName())
        nodes = list(_nodes(json.loads(plan.toJSON())))
        named = set()
        relations = set()
        for node in nodes:
            kind = node["class"].rsplit(".", 1)[-1]
            if ".plans.logical." in node["class"] and kind not in PLAN_NODES:
                raise StatementDenied("sql_not_read_only", kind)
            if kind == "SubqueryAlias":
                named.add(node["identifier"]["name"].lower())
            elif kind == "UnresolvedRelation":
                relations.add(node["multipartIdentifier"].strip("[]").lower())
            elif kind == "UnresolvedStar":
                raise StatementDenied("sql_column_denied", "*")
            elif kind in ("ListQuery", "ScalarSubquery", "Exists", "InSubquery"):
                raise StatementDenied("sql_not_read_only", "subquery expressions")
            elif kind in ("UnresolvedInlineTable", "UnresolvedTableValuedFunction", "Cast", "CaseWhen"):
                raise StatementDenied("sql_function_denied", kind)
            elif kind == "UnresolvedFunction":
                name = node["nameParts"].strip("[]").lower()
                if name not in self.functions:
                    raise StatementDenied("sql_function_denied", name)
            elif kind == "Literal" and str(node.get("dataType", "")).startswith("string"):
                raise StatementDenied("sql_parameter_required")
        if not relations & {name.lower() for name in self.tables}:
            raise StatementDenied("sql_table_denied", "no allowed table")
        unknown = relations - {name.lower() for name in self.tables} - named
        if unknown:
            raise StatementDenied("sql_table_denied", sorted(unknown)[0])

    def run(self, statement: str, tenant: str, *, flag: str | None = None, **parameters) -> DataFrame:
        """Check, then run for one tenant with bound parameters and the row limit.

        Over the limit the first rows by all columns are returned, so the result repeats; with ``flag`` a
        boolean column of that name tells whether rows were left out.
        """
        self.check(statement)
        try:
            result = self._session(tenant).sql(statement, args=parameters)
        except Exception as error:
            if "UNRESOLVED_COLUMN" in str(error):
                raise StatementDenied("sql_column_denied", str(error).splitlines()[0]) from error
            raise
        ordered = result.orderBy(*[F.col(f"`{name}`") for name in result.columns])
        if flag is None:
            return ordered.limit(self.max_rows)
        every = Window.partitionBy(F.lit(1))  # of at most max_rows + 1 rows
        place = Window.partitionBy(F.lit(1)).orderBy(*[F.col(f"`{name}`") for name in result.columns])
        held = ordered.limit(self.max_rows + 1).withColumn(flag, F.count(F.lit(1)).over(every) > self.max_rows)
        return held.withColumn("_place", F.row_number().over(place)).filter(F.col("_place") <= self.max_rows).drop("_place")
