"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one partial-aggregated minimum per node and one join, so a node with very many links never meets in a
single task: the minimum combines before the shuffle, and the adaptive skew join splits what is left.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stash, stash


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"))


def _large_star(links: DataFrame) -> DataFrame:
    both = links.select("u", "v").union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = _least(both).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small_star(links: DataFrame) -> DataFrame:
    down = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = _least(down)
    moved = down.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u <> v")


def components(links: DataFrame, a: str, b: str, tag: str = "links") -> DataFrame:
    """(node, root) for every node that has a link to another one; root is the smallest node it reaches.

    links: any table with the id columns a and b; direction, repeats, self links and nulls don't matter.
    An empty table gives an empty result.
    """
    now = stash(links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct(), tag)
    seen = None
    while True:
        nxt = stash(_small_star(_large_star(now)).distinct(), tag)
        # a star forest that a round leaves alone is the answer
        mark = tuple(nxt.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.sum(F.col("v").cast("decimal(38,0)"))).first())
        drop_stash(now)
        now = nxt
        if mark == seen:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen = mark
