"""Exact nearest-rank percentiles without holding a population in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RANKS = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def nearest_rank(
    df: DataFrame,
    value: Column,
    by: Sequence[str] = (),
    bucket_width: float = 60.0,
) -> DataFrame:
    """One row per group: ``count, p50, p95, p99, min, max``; groups with no value are absent.

    Values are counted before they move (partial aggregation), cumulated inside value buckets, and
    each bucket is lifted by the total of the lower buckets.  No task sees more than one bucket of
    distinct values plus the list of bucket totals.
    """
    by = list(by)
    counted = (
        df.select(*by, value.cast("double").alias("_v"))
        .filter(F.col("_v").isNotNull())
        .groupBy(*by, "_v")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_b", F.floor(F.col("_v") / F.lit(bucket_width)))
    )
    inside = Window.partitionBy(*by, "_b").orderBy("_v")
    lower = Window.partitionBy(*by).orderBy("_b")
    buckets = (
        counted.groupBy(*by, "_b")
        .agg(F.sum("_n").alias("_bucket_n"))
        .withColumn("_base", F.sum("_bucket_n").over(lower) - F.col("_bucket_n"))
        .withColumn("_total", F.sum("_bucket_n").over(Window.partitionBy(*by)))
        .drop("_bucket_n")
    )
    same = F.col("c._b") == F.col("b._b")
    for name in by:
        same = same & F.col(f"c.{name}").eqNullSafe(F.col(f"b.{name}"))
    ranked = (
        counted.withColumn("_cum", F.sum("_n").over(inside))
        .alias("c")
        .join(buckets.alias("b"), same)
        .select(
            *[F.col(f"c.{name}").alias(name) for name in by],
            "_v",
            "_n",
            "_total",
            (F.col("_cum") + F.col("_base")).alias("_cum"),
        )
    )
    at = [
        F.min(F.when(F.col("_cum") >= F.ceil(F.lit(p) * F.col("_total")), F.col("_v"))).alias(name)
        for name, p in RANKS.items()
    ]
    return ranked.groupBy(*by).agg(
        F.sum("_n").cast("bigint").alias("count"),
        *at,
        F.min("_v").alias("min"),
        F.max("_v").alias("max"),
    )


def nearest_rank_struct(df: DataFrame, value: Column, bucket_width: float = 60.0) -> DataFrame:
    """The same over the whole frame as one row with one struct; zero count when there is none."""
    whole = nearest_rank(df, value, (), bucket_width)
    return whole.groupBy().agg(
        F.struct(
            F.coalesce(F.max("count"), F.lit(0)).cast("bigint").alias("count"),
            *[F.max(n).alias(n) for n in ("p50", "p95", "p99", "min", "max")],
        ).alias("percentiles")
    )
