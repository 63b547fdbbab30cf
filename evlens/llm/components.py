"""Connected components of a large edge list by alternating star contraction.

Each round hangs the larger neighbours of every node on its smallest one (large star),
then the smaller neighbours (small star). Both keep the components and end in stars
whose centre is the smallest node. Neighbour minima are pre-aggregated before each
shuffle, and no neighbourhood is ever gathered. Each round is written to the shared
folder, so a lost executor costs at most one round.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evlens.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges`` (columns u, v: long) that is not itself a root.

    ``root`` is the smallest node reachable. Self-links are ignored; an empty edge
    list gives no rows. Raises if the contraction has not settled after ``max_rounds``.
    """
    now = stored(edges.select("u", "v").where("u != v").distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        now = stored(_small_star(_large_star(now)), "stars")
        seen = now.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
        if seen == mark or seen[0] == 0:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = seen
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
