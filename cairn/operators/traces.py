"""Trace spans: usage, costs that keep unknown prices unknown, latency by node."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairn.functions.stats import nearest_rank


def usage(spans: DataFrame) -> DataFrame:
    """trace_id, provider, calls, tokens_in, tokens_out of the spans that used a provider."""
    used = F.coalesce("tokens_in", "tokens_out", "calls").isNotNull()
    rows = spans.where(F.col("provider").isNotNull() & used)
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    return rows.groupBy("trace_id", "provider").agg(total("calls"), total("tokens_in"), total("tokens_out"))


def cost(used: DataFrame, prices: DataFrame) -> DataFrame:
    """trace_id, known_usd, unknown_calls. Prices (provider, input, output) are per million tokens; a null price is unknown, never zero."""
    priced = used.join(prices, "provider", "left")
    known = F.col("input").isNotNull() & F.col("output").isNotNull()
    usd = (F.col("tokens_in") * F.col("input") + F.col("tokens_out") * F.col("output")) / 1e6
    return priced.groupBy("trace_id").agg(
        F.bround(F.coalesce(F.sum(F.when(known, usd)), F.lit(0.0)), 8).alias("known_usd"),
        F.coalesce(F.sum(F.when(~known, F.col("calls"))), F.lit(0)).cast("long").alias("unknown_calls"),
    )


def with_turn(spans: DataFrame) -> DataFrame:
    """Spans of traces that have a turn."""
    return spans.join(spans.where(F.col("span") == "turn").select("trace_id").distinct(), "trace_id", "left_semi")


def latency_by_node(spans: DataFrame) -> DataFrame:
    """span, n, p50, p95, mean."""
    rows = with_turn(spans)
    mean = rows.groupBy("span").agg(F.bround(F.avg("ms"), 1).alias("mean"))
    return nearest_rank(rows, ["span"], "ms", {"p50": 0.5, "p95": 0.95}).join(mean, "span")


def last_traces(spans: DataFrame, n: int) -> DataFrame:
    """Spans of the n traces that started last."""
    starts = spans.groupBy("trace_id").agg(F.min("start").alias("first"))
    return spans.join(starts.orderBy(F.desc("first"), F.desc("trace_id")).limit(n).select("trace_id"), "trace_id", "left_semi")


def slowest(spans: DataFrame, n: int = 5) -> DataFrame:
    return spans.orderBy(F.desc("ms"), "span_id").limit(n)


def total_ms(spans: DataFrame) -> DataFrame:
    """trace_id, ms: of root spans."""
    return spans.where(F.col("parent").isNull()).groupBy("trace_id").agg(F.bround(F.sum("ms"), 1).alias("ms"))


def timeline(spans: DataFrame) -> DataFrame:
    """Spans with their place within their trace, by start."""
    return spans.withColumn("place", F.row_number().over(Window.partitionBy("trace_id").orderBy("start", "span_id")))


# What a span's line shows, in this order.
LINE_KEYS = "route action confidence tool model tokens_in tokens_out mode hits kind gate query.rewritten kept dropped reused stub error".split()


def span_line(columns: list[str]) -> Column:
    """One line for a log of a span with the given columns: its name, its time, and those of LINE_KEYS that hold something."""
    shown = [F.when(F.coalesce(F.col(f"`{k}`").cast("string"), F.lit("")).isin("", "[]", "{}"), None).otherwise(F.concat(F.lit(f"{k}="), F.col(f"`{k}`").cast("string"))) for k in LINE_KEYS if k in columns]
    extras = F.array_join(F.array_compact(F.array(*shown)), " ") if shown else F.lit("")
    return F.concat(F.format_string("span %-16s %8.1f ms  ", F.col("span"), F.col("ms").cast("double")), extras)


def deltas(readings: DataFrame, counters: list[str], of: str = "trace_id", order: str = "start") -> DataFrame:
    """Readings of running totals with what each adds to the one before it; the first adds its whole, and so does one that is below the one before, as after a restart."""
    before = Window.partitionBy(of).orderBy(order)
    added = {f"{c}_added": F.when(F.coalesce(F.lag(c).over(before), F.lit(0)) <= F.col(c), F.col(c) - F.coalesce(F.lag(c).over(before), F.lit(0))).otherwise(F.col(c)) for c in counters}
    return readings.withColumns(added)
