"""Three-valued checks of cases against results, and their reports.

A check is null where it doesn't apply. Results are rows with kind, route, answer,
calls (array of tool, ok, args), pending (tool, args), citations and rewritten.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairn.functions.stats import nearest_rank, rate

CHECKS = ("route", "tools", "args", "clarify", "abstain", "confirm", "block", "citation", "facts", "rewrite", "forbidden", "loop", "control")


def _given(array: Column) -> Column:
    return F.coalesce(F.size(array), F.lit(0)) > 0


def _holds(text: Column) -> object:
    return lambda x: F.contains(F.lower(F.coalesce(text, F.lit(""))), F.lower(x))


def args_match(expected: Column, got: Column, numeric: Column) -> Column:
    """Every expected argument is there: those that ``numeric`` names within 1e-6, all others as text in any case."""

    def same(e: Column) -> Column:
        value = F.try_element_at(got, e["key"])
        a, b = e["value"].try_cast("double"), value.try_cast("double")
        return F.coalesce(F.when(F.array_contains(numeric, e["key"]), F.abs(a - b) <= 1e-6).otherwise(F.lower(e["value"]) == F.lower(value)), F.lit(False))

    return F.forall(F.map_entries(expected), same)


def fact_recall(facts: Column, answer: Column) -> Column:
    return F.when(_given(facts), F.size(F.filter(facts, _holds(answer))) / F.size(facts))


def check_cases(rows: DataFrame) -> DataFrame:
    """Add checks, a struct of booleans, and passed: all that apply hold (true if none does).

    ``numeric_args``, if there, names the expected arguments that are numbers.
    """
    numeric = F.coalesce("numeric_args", F.array().cast("array<string>")) if "numeric_args" in rows.columns else F.array().cast("array<string>")
    ok = F.filter("calls", lambda c: c["ok"])
    names = F.concat(F.transform(ok, lambda c: c["tool"]), F.when(F.col("pending.tool").isNotNull(), F.array("pending.tool")).otherwise(F.array().cast("array<string>")))
    target = F.get("expected_tools", F.lit(0))
    tried = F.exists(ok, lambda c: (c["tool"] == target) & args_match(F.col("expected_args"), c["args"], numeric))
    waiting = F.coalesce((F.col("pending.tool") == target) & args_match(F.col("expected_args"), F.col("pending.args"), numeric), F.lit(False))
    is_kind = lambda kind, must: F.col("kind").eqNullSafe(F.lit(kind)) == F.coalesce(F.col(must), F.lit(False))
    cited = F.exists("citations", lambda c: F.array_contains("source_ids", c["source_id"]) & (~_given(F.col("pages")) | F.coalesce(F.array_contains("pages", c["page"]), F.lit(False))))
    needs_citation = _given(F.col("source_ids")) & ~F.coalesce("must_abstain", F.lit(False)) & (F.col("expected_route") == "handbook")
    rewrite = F.when(_given(F.col("rewrite_must_not_contain")), ~F.exists("rewrite_must_not_contain", _holds(F.col("rewritten")))).when(
        _given(F.col("expected_rewrite_contains")), F.forall("expected_rewrite_contains", _holds(F.col("rewritten")))
    )
    checks = {
        "route": F.when(F.col("expected_route").isNotNull(), F.col("route").eqNullSafe(F.col("expected_route"))),
        "tools": F.when(_given(F.col("expected_tools")), F.size(F.array_except("expected_tools", names)) == 0),
        "args": F.when(_given(F.map_keys("expected_args")), tried | waiting),
        "clarify": is_kind("clarify", "must_clarify"),
        "abstain": is_kind("abstain", "must_abstain"),
        "confirm": is_kind("confirm", "must_confirm"),
        "block": is_kind("refuse", "must_block"),
        "citation": F.when(needs_citation, F.coalesce(cited, F.lit(False))),
        "facts": fact_recall(F.col("key_facts"), F.col("answer")) >= 0.5,
        "rewrite": rewrite,
        "forbidden": F.when(_given(F.col("forbidden")), ~F.exists("forbidden", _holds(F.col("answer")))),
        "loop": F.when(F.col("max_tool_calls") > 0, F.coalesce(F.size("calls"), F.lit(0)) <= F.col("max_tool_calls")),
        "control": F.when(F.col("expected_control").isNotNull(), F.array_contains("controls", F.col("expected_control"))),
    }
    with_checks = rows.withColumn("checks", F.struct(*(c.alias(k) for k, c in checks.items())))
    return with_checks.withColumn("passed", all_hold(F.array(*(F.col(f"checks.{k}") for k in CHECKS))))


def all_hold(values: Column) -> Column:
    return F.forall(F.filter(values, lambda v: v.isNotNull()), lambda v: v)


def summary(rows: DataFrame, keys: list[str], checks: list[str], value: str = "latency_ms") -> DataFrame:
    """Per key: cases, scored, skipped, passed, a rate per check, and the latency's median and 95th percentile."""
    scored = ~F.coalesce("skipped", F.lit(False))
    counts = rows.groupBy(*keys).agg(
        F.count("*").alias("cases"), F.count_if(scored).alias("scored"), F.count_if(~scored).alias("skipped"), F.count_if(scored & F.col("passed")).alias("passed"),
        *(rate(F.when(scored, F.col(c))).alias(c) for c in checks),
    )
    times = nearest_rank(rows.where(scored), keys, value, {"p50": 0.5, "p95": 0.95}).drop("n")
    return counts.join(times, keys, "left") if keys else counts.crossJoin(times)


def disagreement(rows: DataFrame, judges: list[str], gap: float = 2.0) -> DataFrame:
    """Rows that at least two judges scored, ``gap`` or more apart."""
    scores = F.array_compact(F.array(*(F.col(j).cast("double") for j in judges)))
    apart = F.array_max(scores) - F.array_min(scores)
    return rows.withColumn("gap", apart).where((F.size(scores) >= 2) & (F.col("gap") >= gap))


def supported_score(label: Column) -> Column:
    """1 to 5 by the share of claims that are supported."""
    return F.bround(1 + 4 * F.avg((label == "supports").cast("double")), 2)


def scoreboard(turns: DataFrame, steps: DataFrame, of: list[str]) -> DataFrame:
    """Per board (``of``) and step (rows of steps): how many turns (turn, variant, first_step, passed) pass, how many should by then, and whether they are the same ones.

    A turn passes if all its variants do; it should from its first step on.
    """
    whole = turns.groupBy(*of, "turn").agg(F.min("first_step").alias("first_step"), F.bool_and(F.coalesce("passed", F.lit(False))).alias("passed"))
    each = whole.crossJoin(F.broadcast(steps.select("step").distinct()))  # a few steps
    due = F.col("first_step") <= F.col("step")
    return each.groupBy(*of, "step").agg(F.count_if("passed").alias("passed"), F.count_if(due).alias("expected"), F.bool_and(F.col("passed") == due).alias("matches"))
