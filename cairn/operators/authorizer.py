"""Who may read and write what: decided on the analysed plan of a statement, before it runs.

A statement is parsed and analysed over empty tables of the same columns; nothing is
executed. Then every node and every expression of the plan is looked at, those of
subqueries and views included: nodes and functions by their class and name,
columns by the table that they come from. What isn't listed is denied, and a denial names its rule.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

# What a query may be made of: nodes of a parsed and of an analysed plan.
PARSED = set(
    "Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias UnresolvedSubqueryColumnAliases WithWindowDefinition "
    "UnresolvedRelation UnresolvedWith UnresolvedHaving UnresolvedInlineTable LocalRelation OneRowRelation UnresolvedOrdinal".split()
)
ANALYSED = set("Project Filter Aggregate Sort GlobalLimit LocalLimit Offset Distinct Union Intersect Except Join SubqueryAlias View LocalRelation OneRowRelation Window WithCTE CTERelationDef CTERelationRef LogicalRDD".split())
# Expressions that only hold others together.
SHAPES = set(
    "Alias AttributeReference OuterReference Literal Cast EqualTo EqualNullSafe LessThan LessThanOrEqual GreaterThan GreaterThanOrEqual And Or Not In InSubquery ListQuery Exists ScalarSubquery "
    "CaseWhen If IsNull IsNotNull IsNaN Like RLike ILike LikeAll LikeAny Add Subtract Multiply Divide IntegralDivide Remainder UnaryMinus UnaryPositive Concat SortOrder "
    "With CommonExpressionDef CommonExpressionRef TypedNullLiteral AggregateExpression WindowExpression WindowSpecDefinition SpecifiedWindowFrame Between StringTrimBoth".split()
) | {"UnboundedPreceding$", "UnboundedFollowing$", "CurrentRow$", "RowFrame$", "RangeFrame$", "UnspecifiedFrame$"}
FUNCTIONS = set(
    "abs avg cast ceil ceiling char_length character_length coalesce concat concat_ws contains count count_if date_add date_format date_sub datediff day dayofmonth dayofweek dense_rank endswith "
    "floor greatest hour if ifnull instr lag lcase lead least left length locate lower lpad ltrim max median min minute month nullif nvl percent_rank position rank regexp_replace replace right "
    "round row_number rpad rtrim sign split_part sqrt startswith stddev stddev_samp substr substring sum to_date to_timestamp trim try_cast try_to_timestamp ucase upper weekday year between".split()
)


@dataclass
class Log:
    denials: list[str] = field(default_factory=list)

    def deny(self, rule: str) -> str:
        self.denials.append(f"rule: {rule}")
        return self.denials[-1]


def _each(seq: Any) -> Iterator[Any]:
    for k in range(seq.size()):
        yield seq.apply(k)


def _kind(x: Any) -> str:
    return x.getClass().getSimpleName()


def _nodes(plan: Any) -> Iterator[Any]:
    """A plan's nodes, with those of its subqueries and of what a WITH names; what is inside a view is its own."""
    ahead = [plan]
    while ahead:
        node = ahead.pop()
        yield node
        if _kind(node) == "View":
            continue
        ahead += [*_each(node.children()), *_each(node.subqueries())]
        if _kind(node) == "UnresolvedWith":
            ahead += [pair._2() for pair in _each(node.cteRelations())]
        elif _kind(node) == "WithCTE":
            ahead += list(_each(node.cteDefs()))


def _expressions(node: Any) -> Iterator[Any]:
    """All expressions of a node, in order, from the outside in."""
    ahead = list(_each(node.expressions()))[::-1]
    while ahead:
        e = ahead.pop()
        yield e
        ahead += list(_each(e.children()))[::-1]


def _in_one_line(e: Exception) -> str:
    return " ".join(str(e).split())


class Authorizer:
    """Reads of listed columns of listed tables. ``tables`` are frames with all columns, ``allow`` the columns that may be read."""

    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame], allow: dict[str, set[str]], log: Log | None = None):
        self.log = log or Log()
        self.allow = {t.lower(): {c.lower() for c in columns} for t, columns in allow.items()}
        self.known = {t.lower() for t in tables}
        self._empty = spark.newSession()
        self._empty.conf.set("spark.sql.runSQLOnFiles", "false")
        for name, frame in tables.items():
            self._empty.createDataFrame([], frame.schema).createOrReplaceTempView(name)

    def denial(self, statement: str) -> str | None:
        """Why a statement may not run; None if it may."""
        state = self._empty._jsparkSession.sessionState()
        try:
            parsed = state.sqlParser().parsePlan(statement)
        except PySparkException as e:
            return self.log.deny(f"only SELECT is allowed (not a query: {_in_one_line(e)})")
        if why := self._parsed(parsed):
            return self.log.deny(why)
        try:
            analysed = self._analysed(state, parsed)
        except PySparkException as e:
            return self.log.deny(_in_one_line(e))
        why = self._plan(analysed)
        return self.log.deny(why) if why else None

    def _analysed(self, state: Any, parsed: Any) -> Any:
        plan = state.analyzer().execute(parsed)
        state.analyzer().checkAnalysis(plan)
        return plan

    def _parsed(self, plan: Any) -> str | None:
        """Before analysis: only queries, only tables by plain names, no functions that aren't listed."""
        named = set()
        for node in _nodes(plan):
            if _kind(node) == "UnresolvedWith":
                named |= {pair._1().lower() for pair in _each(node.cteRelations())}
        for node in _nodes(plan):
            if _kind(node) not in PARSED:
                return f"only SELECT is allowed (statement tried {_kind(node)})"
            if _kind(node) == "UnresolvedRelation":
                table = ".".join(_each(node.multipartIdentifier())).lower()
                if table not in self.allow and table not in named:
                    return f"table '{table}' is not on the read allow-list"
            for e in _expressions(node):
                if _kind(e) == "UnresolvedFunction":
                    name = ".".join(_each(e.nameParts())).lower()
                    if name not in FUNCTIONS:
                        return f"function '{name}' is denied"
        return None

    def _plan(self, plan: Any) -> str | None:
        """After it: every node, function and column by what it has become."""
        origin: dict[int, tuple[str, str]] = {}
        nodes = list(_nodes(plan))
        for node in nodes:
            if _kind(node) == "SubqueryAlias" and _kind(node.child()) in ("View", "LocalRelation", "LogicalRDD") and node.alias().lower() in self.known:
                for a in _each(node.child().output()):
                    origin[a.exprId().id()] = (node.alias().lower(), a.name().lower())
        for node in nodes:
            if _kind(node) not in ANALYSED:
                return f"{_kind(node)} is not allowed"
            for e in [] if _kind(node) == "View" else _expressions(node):
                if _kind(e) == "AttributeReference" and e.exprId().id() in origin:
                    table, column = origin[e.exprId().id()]
                    if column not in self.allow.get(table, ()):
                        return f"column '{table}.{column}' is not on the read allow-list"
                elif _kind(e) not in SHAPES and e.prettyName().lower() not in FUNCTIONS:
                    return f"function '{e.prettyName().lower()}' is denied"
        return None


# What a write may be: the nodes of its statement, and the tables that it may name.
WRITES = {"InsertIntoStatement": "table", "UpdateTable": "table"}


def write_denial(spark: SparkSession, statement: str, tables: set[str], readable: set[str], log: Log | None = None) -> str | None:
    """Why a statement may not write: only INSERT into and UPDATE of listed tables, from readable ones. It is only parsed."""
    log = log or Log()
    try:
        plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(statement)
    except PySparkException as e:
        return log.deny(f"write connection allows only INSERT/UPDATE (not a statement: {_in_one_line(e)})")
    if _kind(plan) not in WRITES:
        return log.deny(f"write connection allows only INSERT/UPDATE (tried {_kind(plan)})")
    table = ".".join(_each(plan.table().multipartIdentifier())).lower()
    if table not in tables:
        return log.deny(f"writes are allowed only on {sorted(tables)}, not '{table}'")
    rest = [plan.query()] if _kind(plan) == "InsertIntoStatement" else []
    for node in [n for p in [plan, *rest] for n in _nodes(p)]:
        if _kind(node) == "UnresolvedRelation" and (name := ".".join(_each(node.multipartIdentifier())).lower()) not in readable | tables:
            return log.deny(f"table '{name}' is not readable")
        for e in _expressions(node):
            if _kind(e) == "UnresolvedFunction" and (name := ".".join(_each(e.nameParts())).lower()) not in FUNCTIONS:
                return log.deny(f"function '{name}' is denied")
    return None
