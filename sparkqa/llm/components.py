"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two aggregations and joins on the link table; a hub's minimum is combined map-side
and its links are an ordinary skewed join side that AQE splits. Rounds are written tables, so
lineage stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def _small_star(links: DataFrame) -> DataFrame:
    least = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(least, "a").where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (two long columns a, b; a > b) but the roots:
    the root is the smallest node that can be reached. Links repeated are one link; an empty
    table gives an empty result. Ends when a round changes nothing."""
    links = materialize(links.distinct(), "links")
    before = _state(links)
    while before[0]:
        links = materialize(_small_star(_large_star(links)), "links")
        now = _state(links)
        if now == before:
            break
        before = now
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
