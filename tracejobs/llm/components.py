"""Connected components by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracejobs.llm.common import drop, store


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, component) for every node of ``edges``; component: the smallest node that it reaches.

    Edges with a null end and loops link nothing; repeated edges count once; other columns are ignored. Each
    step lets a node's minimum travel by an aggregate and an equi-join, so that a node with very many
    neighbours is never gathered, and each round is written to the shared folder, so that lost executors cost
    one round at most.
    """
    spark = edges.sparkSession
    x, y = F.col(a), F.col(b)
    links, path = store(edges.where(x != y).select(F.greatest(x, y).alias("u"), F.least(x, y).alias("v")).distinct(), "links")
    for _ in range(max_rounds):
        if _is_stars(links):
            break
        both = links.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(links.select(F.col("v").alias("x"), F.col("u").alias("y")))
        low = both.groupBy("x").agg(F.least(F.min("y"), F.first("x")).alias("m"))
        large = both.where("y > x").join(low, "x").select(F.col("y").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        moved = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        rest, new = store(moved.unionByName(low.withColumnRenamed("m", "v")).distinct(), "links")
        drop(spark, path)
        links, path = rest, new
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return links.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        links.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )


def _is_stars(links: DataFrame) -> bool:
    """Whether each node is either a root or has one link, to a root."""
    ends = links.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(
        links.select(F.col("v").alias("n"), F.lit(0).alias("up"), F.lit(1).alias("down"))
    )
    odd = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
    return odd.limit(1).count() == 0
