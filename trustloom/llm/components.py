"""Connected components by alternating large-star and small-star rounds, all as joins and minima."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from trustloom.llm.common import dropped, stored


def _digest(edges: DataFrame):
    return edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of the links ``u, v`` (bigint): root is the smallest node of the component.

    Null ends and self links are ignored; a table without links gives no rows. Each round needs only the smallest neighbour
    of a node (a map-side minimum) and a join that may be split, so a node with very many neighbours is no hot group. The
    number of rounds grows with the logarithm of the longest path; each round's links are a written table.
    """
    edges = stored(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(),
                   "links")
    before = _digest(edges)
    while before[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        mid = stored(large.distinct(), "large")
        low = mid.groupBy("u").agg(F.min("v").alias("m"))
        new = mid.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            low.select("u", F.col("m").alias("v")))
        new = stored(new.distinct(), "small")
        now = _digest(new)
        dropped(mid, edges)
        edges = new
        if now == before:
            break
        before = now
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
