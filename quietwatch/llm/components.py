"""Connected components of a list of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from quietwatch.llm.common import checkpointed


def connected(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, root``: the smallest node that each node of ``links`` can reach.  Nodes without links have no row.

    Every step links neighbours to the smallest node near them.  A step is one plan with three shuffles and no join, so
    the driver plans and tracks little; the links of a node meet in one task as rows of two numbers, which Spark spills.
    The number of steps grows with the logarithm of the longest path.
    """
    near = Window.partitionBy("u")
    edges, mark = _kept(links.select(F.col(a).alias("u"), F.col(b).alias("v")))
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.withColumn("low", F.least(F.min("v").over(near), "u"))
        # larger neighbours go to the smallest node, and so does the node itself
        large = low.filter("v > u OR v = low").select(F.greatest("u", "v").alias("u"), F.col("low").alias("v"))
        least = large.withColumn("least", F.min("v").over(near))
        small = least.select(F.when(F.col("v") > F.col("least"), F.col("v")).otherwise(F.col("u")).alias("u"), F.col("least").alias("v"))
        edges, now = _kept(small)
        if now == mark:
            break
        mark = now
    roots = edges.groupBy("u").agg(F.min("v").alias("root"))
    return roots.select(F.col("u").alias("node"), "root").unionByName(
        roots.select(F.col("root").alias("node"), "root").distinct()
    )


def _tidy(edges: DataFrame) -> DataFrame:
    """Each pair once, the larger node first."""
    return edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _kept(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges, each pair once and cut from their lineage, and a mark that changes when they do."""
    seen = Observation()
    mark = F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")
    edges = checkpointed(_tidy(edges).observe(seen, *mark))
    return edges, (seen.get["n"], seen.get["h"])
