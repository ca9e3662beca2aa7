"""Connected components of an edge table by alternating large-star and small-star rounds.

Labels stay in tables: nothing but one row of totals per round reaches the driver. A round's
smallest neighbours come from an aggregation that combines before its exchange and counts each
node's edges, so that the join back can keep the edges of a node with many out of one task. Every
round is written to the shared folder, so a lost executor costs at most the current round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import spread_join, written


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _lowest(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _lowest(both).withColumn("m", F.least("u", "m"))
    return spread_join(both.filter("v > u"), low, ["u"], "n", 2 * n).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    # every edge points from the larger to the smaller node here
    low = _lowest(edges)
    moved = spread_join(edges, low, ["u"], "n", n).filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node that has an edge; root is the smallest node reachable.

    ``edges`` has two columns of one orderable type; loops and repeated edges are harmless, and an
    empty table gives an empty result.
    """
    a, b = edges.columns
    now = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct()
    now = written(now, "edges")
    seen = _state(now)
    while seen[0]:
        large = written(_large_star(now, seen[0]), "stars")
        now = written(_small_star(large, seen[0]), "stars")
        if (state := _state(now)) == seen:
            break
        seen = state
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("root"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
