"""Windows over conversations: rows of thread, turn, role, text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_messages(rows: DataFrame, turns: int, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The last 2 * turns messages of each thread that aren't the system's; of no turns none."""
    newest = Window.partitionBy(thread).orderBy(F.desc(turn))
    return rows.where(F.col("role") != "system").withColumn("age", F.row_number().over(newest)).where(F.col("age") <= 2 * max(turns, 0))


def token_budget_suffix(rows: DataFrame, budget: int, tokens: Column, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The longest newest part of each thread of at most ``budget`` tokens, four more per message, from a user's message on."""
    back = Window.partitionBy(thread).orderBy(F.desc(turn)).rowsBetween(Window.unboundedPreceding, 0)
    kept = rows.withColumn("tokens", tokens).withColumn("used", F.sum(F.col("tokens") + 4).over(back)).where(F.col("used") <= budget)
    first_user = F.min(F.when(F.col("role") == "user", F.col(turn))).over(Window.partitionBy(thread))
    return kept.withColumn("from_turn", first_user).where(F.col(turn) >= F.col("from_turn")).drop("from_turn")


def previous_user_text(rows: DataFrame, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each row with the text of the user's message before it."""
    before = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("last_user", F.last(F.when(F.col("role") == "user", F.col("text")), ignorenulls=True).over(before))


def slot(rows: DataFrame, value: Column, name: str, thread: str = "conv_id", turn: str = "turn") -> DataFrame:
    """The newest value that isn't null, up to each row."""
    upto = Window.partitionBy(thread).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(upto))


def bounded_plan(calls: DataFrame, limit: int, thread: str = "conv_id", order: str = "turn", call: tuple[str, ...] = ("tool", "args")) -> DataFrame:
    """The first ``limit`` different calls of each thread, in order."""
    first = Window.partitionBy(thread, *call).orderBy(order)
    new = calls.withColumn("again", F.row_number().over(first)).where(F.col("again") == 1).drop("again")
    return new.withColumn("step", F.row_number().over(Window.partitionBy(thread).orderBy(order))).where(F.col("step") <= limit)
