"""Connected components by large and small stars, as DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import cut, tidy


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the edges (a, b): root is the smallest node of its component.

    Each round joins every node's neighbours to the smallest one. Nothing is gathered on the driver but a
    count and a checksum, and no group is gathered into one task: minima are combined before the shuffle.
    """
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.expr("sum(cast(xxhash64(u, v) as decimal(38,0)))")).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m")).withColumnRenamed("u", "of")
        # large star: neighbours above a node go to its smallest neighbour
        large = both.where("v > u").join(low, F.col("u") == F.col("of")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        # small star: neighbours below a node, and the node, go to the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        hop = large.withColumnRenamed("u", "w").join(least.withColumnRenamed("u", "of"), F.col("w") == F.col("of"))
        small = hop.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v")))
        now = cut(small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        tidy(now.sparkSession)
    roots = now.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    tops = now.select(F.col("v").alias("node")).distinct().join(roots.select("node"), "node", "left_anti")
    return cut(roots.select("node", "root").union(tops.select("node", F.col("node").alias("root"))))
