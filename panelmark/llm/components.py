"""Connected components by alternating large and small stars, without gathering a node's neighbours."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmark.llm.common import dropped, saved


def components(edges: DataFrame) -> DataFrame:
    """edges: (a, b) longs in any direction. Returns (node, root): root is the smallest node of the component.

    Only nodes with an edge come back; loops are ignored. Minima are taken by partial aggregation and joined
    to the edges again, so a node with very many edges is neither collected nor held by one task.
    """
    now = saved(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        size = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(size) == seen:
            break
        seen = tuple(size)
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", "m")).distinct()
        small = small.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
        old, now = now, saved(small)
        dropped(old)
    return now.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "node").union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
