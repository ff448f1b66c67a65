"""Connected components of a table of links, by rounds of star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scale import Scratch


def _stars(links: DataFrame) -> DataFrame:
    """Large step, then small step: every node moves its neighbours to the least one it knows."""
    both = links.select("u", "v").unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = large.groupBy("u").agg(F.min("v").alias("m"))
    moved = large.join(least, "u")
    return (
        moved.filter("v <> m")
        .select(F.col("v").alias("u"), F.col("m").alias("v"))
        .unionByName(least.select("u", F.col("m").alias("v")))
        .distinct()
    )


def components(links: DataFrame, a: str, b: str, scratch: Scratch) -> DataFrame:
    """``node`` and ``component``, its least reachable node, for every linked node but the least.

    No step holds the neighbours of a node together: each is a minimum and a join, so a node with
    very many links is combined before the shuffle and split by the skewed join after it.  The
    rounds grow with the logarithm of the number of nodes.  Links with a null end or of a node
    with itself are ignored; no links give an empty table.
    """
    named = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u > v").distinct()
    mark = (F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    table, state = scratch.write_counted(named, *mark)
    while state[0]:
        after, new = scratch.write_counted(_stars(table), *mark)
        scratch.drop(table)
        table, done, state = after, new == state, new
        if done:
            break
    return table.select(F.col("u").alias("node"), F.col("v").alias("component"))
