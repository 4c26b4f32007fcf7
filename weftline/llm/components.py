"""Connected components of a link table, on the cluster."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def _both_ways(links: DataFrame) -> DataFrame:
    return links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _large_star(links: DataFrame) -> DataFrame:
    """Each node links its larger neighbours to the smallest of itself and its neighbours."""
    near = _both_ways(links)
    least = near.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    return (
        near.where("b > a").join(least, "a").where("b <> m")
        .select(F.col("b").alias("a"), F.col("m").alias("b"))
    )


def _small_star(links: DataFrame) -> DataFrame:
    """Each node links itself and its smaller neighbours to the smallest of those."""
    down = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def _are_stars(links: DataFrame) -> bool:
    """Whether every node links down once at most, and then to one that links no further: nothing is left to do."""
    ends = links.select(F.col("a").alias("node"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionAll(links.select(F.col("b").alias("node"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    return ends.groupBy("node").agg(F.sum("down").alias("down"), F.max("up").alias("up")).where((F.col("down") > 1) | ((F.col("down") > 0) & (F.col("up") > 0))).isEmpty()


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of links(a, b), whose ids are longs; component is the smallest id reachable.

    Alternating large-star and small-star rounds: every round is a join and a partial aggregation, so a hub with a
    third of all links is pre-aggregated, and Spark may split its join partition. Rounds end when the links are stars,
    after a number that grows with the logarithm of the largest component. One row at most reaches the driver a round.
    An empty table has no components. Links of a node to itself and null ids are ignored.
    """
    now = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    for _ in range(max_rounds):
        if _are_stars(now):
            break
        now = cut(_small_star(_large_star(now)))
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionAll(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
