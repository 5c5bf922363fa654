"""Aggregates with the definitions that evaluation reports use."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def nearest_rank(rows: DataFrame, keys: list[str], value: str, quantiles: dict[str, float], digits: int = 1) -> DataFrame:
    """Per key, n and for each name the value at index round(q (n - 1)), halves to even.

    Equal values are counted before the shuffle, and a running sum over the
    counts finds the ranks, so a large group is sorted, spilling if it must, and
    never collected.
    """
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("equal_values"))
    group = Window.partitionBy(*keys)
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    ranked = counted.withColumn("upto", F.sum("equal_values").over(upto)).withColumn("n", F.sum("equal_values").over(group))
    picked = [
        F.bround(F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0), F.col(value))), digits).alias(name) for name, q in quantiles.items()
    ]
    return ranked.groupBy(*keys).agg(F.max("n").alias("n"), *picked)


def rate(value: Column) -> Column:
    """'k/n' of a three-valued check; '-' if it never applies."""
    return F.when(F.count(value) == 0, "-").otherwise(F.concat(F.sum(value.cast("int")).cast("string"), F.lit("/"), F.count(value).cast("string")))


def spread(value: Column) -> list[Column]:
    """n, min, median, max and mean to one decimal."""
    return [F.count(value).alias("n"), F.min(value).alias("min"), F.median(value).alias("median"), F.max(value).alias("max"), F.round(F.avg(value), 1).alias("mean")]
