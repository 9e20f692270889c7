"""Connected components of a distributed edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronofid.session import checkpointed


#: Edges that one task handles in a round, about.
TASK_EDGES = 200_000


def _large_star(edges: DataFrame, parts: int) -> DataFrame:
    """Every neighbour above a node is tied to the smallest node around it."""
    both = edges.select("u", "v").union(edges.select("v", "u"))
    least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("least")).coalesce(parts)
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v")).where("u <> v").coalesce(parts).distinct()


def _small_star(edges: DataFrame, parts: int) -> DataFrame:
    """A node and all its smaller neighbours are tied to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").coalesce(parts)
    least = down.groupBy("u").agg(F.min("v").alias("least")).coalesce(parts)
    moved = down.join(least, "u").where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).coalesce(parts)
    return moved.union(least.select("u", F.col("least").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """``node, component`` (its smallest node) for every node of ``edges`` (``u``, ``v``) but the smallest itself.

    Alternating stars: the number of rounds grows with the logarithm of the longest path, and no neighbourhood is ever
    collected. The number of tasks follows the number of edges.
    """
    now, before = checkpointed(edges.select("u", "v").where("u <> v").distinct()), None
    parts = 1 + now.count() // TASK_EDGES
    for _ in range(rounds):
        now = checkpointed(_small_star(_large_star(now.coalesce(parts), parts), parts).coalesce(parts))
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = mark
    raise RuntimeError("components did not settle")
