"""Connected components of a table of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairn.llm.shared import save


def _minimum(links: DataFrame) -> DataFrame:
    """u, m: the smallest neighbour. Aggregated before the shuffle, so a hub is no hot key."""
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node ties its larger neighbours to the smallest of its neighbours and itself. Links have u > v."""
    both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    centre = _minimum(both).select("u", F.least("u", "m").alias("m"))
    return both.where(F.col("v") > F.col("u")).join(centre, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """Each node ties its smaller neighbours and itself to the smallest of them."""
    tied = links.join(_minimum(links), "u")
    return tied.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v")).distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node), for each node that has a link to another node."""
    ends = links.where(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
    table, before = save(ends.distinct(), "links"), None
    while True:
        state = table.df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            break
        before, old = state, table
        table = save(_small_star(_large_star(old.df)), "links")
        old.drop()
    roots = table.df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return table.df.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
