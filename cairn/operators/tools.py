"""A registry of named query functions with checked arguments, and read access to listed columns only."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.operators.authorizer import Authorizer


@dataclass(frozen=True)
class Tool:
    name: str
    about: str
    run: Callable[..., DataFrame]
    args: dict[str, type]
    required: tuple[str, ...] = ()
    writes: bool = False


@dataclass
class Registry:
    """Errors come back as text; the account is bound by the caller, never an argument."""

    account: str
    allow_writes: bool = False
    tools: dict[str, Tool] = field(default_factory=dict)

    def add(self, tool: Tool) -> None:
        self.tools[tool.name] = tool

    def run(self, name: str, **args: Any) -> tuple[DataFrame | None, str]:
        tool = self.tools.get(name)
        if tool is None:
            return None, f"unknown tool {name}"
        if tool.writes and not self.allow_writes:
            return None, f"{name} writes, which is switched off"
        unknown = [a for a in args if a not in tool.args]
        missing = [a for a in tool.required if args.get(a) is None]
        wrong = [a for a, v in args.items() if a in tool.args and v is not None and not isinstance(v, tool.args[a])]
        if unknown or missing or wrong:
            return None, "; ".join(f"{what}: {', '.join(names)}" for what, names in (("unknown", unknown), ("missing", missing), ("of another type", wrong)) if names)
        try:
            return tool.run(account=self.account, **args), ""
        except (PySparkException, ValueError) as e:
            return None, str(e)


@dataclass(frozen=True)
class Sandbox:
    """A session that sees listed columns only, and who decides what may run in it."""

    session: SparkSession
    authorizer: Authorizer


def sandbox(spark: SparkSession, load: Callable[[SparkSession], dict[str, DataFrame]], columns: dict[str, list[str]]) -> Sandbox:
    """A sandbox whose views hold the listed columns of the listed tables and nothing else; files can't be queried by path.

    ``load`` reads the tables in the session it is given. Views of other sessions don't show here.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.runSQLOnFiles", "false")
    tables = load(own)
    for name, allowed in columns.items():
        tables[name].select(*allowed).createOrReplaceTempView(name)
    return Sandbox(own, Authorizer(spark, tables, {t: set(c) for t, c in columns.items()}))


STRINGS = re.compile(r"'(?:[^'\\]|\\.|'')*'|\"(?:[^\"\\]|\\.)*\"", re.DOTALL)


def _in_one_line(e: Exception) -> str:
    return " ".join(str(e).split())


def refusal(box: Sandbox, statement: str) -> str | None:
    """Why a statement may not run: the authorizer's rule, or, as a second line, what is hard to read for people."""
    if (why := box.authorizer.denial(statement)) is not None:
        return why
    if any(mark in STRINGS.sub("''", statement) for mark in ("`", "--", "/*")):
        return box.authorizer.log.deny("quoted names and comments are not allowed")
    return None


def run_sql(box: Sandbox, statement: str, cap: int = 50) -> tuple[list, bool, str | None]:
    """Rows of a query in the sandbox, whether there were more than ``cap``, and why it was refused, if it was."""
    if (why := refusal(box, statement)) is not None:
        return [], False, why
    try:
        return *capped(box.session.sql(statement), cap), None
    except PySparkException as e:
        return [], False, _in_one_line(e)


def capped(rows: DataFrame, cap: int = 50) -> tuple[list, bool]:
    """At most ``cap`` rows, and whether there were more."""
    some = rows.limit(cap + 1).collect()
    return some[:cap], len(some) > cap


def question_sql(question: Column) -> Column:
    """A statement for a question by its words: loans, rooms, deadlines, a course's sessions, else the next events. It still has to pass the sandbox."""
    q = F.lower(question)
    first = lambda pattern: F.upper(F.nullif(F.regexp_extract(q, pattern, 1), F.lit("")))
    course, account = first(r"\b([a-z]{4}\d{3})\b"), first(r"\b(a\d{4})\b")
    where = lambda column, value: F.coalesce(F.concat(F.lit(f" WHERE {column} = '"), value, F.lit("'")), F.lit(""))
    has = lambda *words: F.rlike(q, F.lit("|".join(words)))
    return (
        F.when(has("loan"), F.concat(F.lit("SELECT isbn, due_date FROM loans"), where("account_id", account)))
        .when(has("room"), F.lit("SELECT id, capacity, has_projector FROM rooms WHERE has_projector = 1"))
        .when(has("deadline", "due"), F.concat(F.lit("SELECT course_code, title, due_at FROM assignments"), where("course_code", course), F.lit(" ORDER BY due_at")))
        .when(course.isNotNull(), F.concat(F.lit('SELECT weekday, start, "end", room_id, kind FROM sessions'), where("course_code", course)))
        .otherwise(F.lit("SELECT title, date FROM events ORDER BY date LIMIT 10"))
    )
