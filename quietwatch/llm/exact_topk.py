"""Exact top-k by inner product over an index of pivots and distances.

Largest inner product becomes nearest neighbour when every vector x gets one more component sqrt(M^2 - |x|^2), M the
largest norm: then |q - x|^2 = |q|^2 + M^2 - 2 q.x.  Each vector is filed under its nearest pivot and the annulus of
its distance to it.  By the triangle inequality no vector of an annulus is nearer to a query than the gap between the
annulus and the query's own distance to the pivot.  Annuli are visited from the smallest gap; once k vectors are
found, those whose bound lies below the k-th score are never read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm import vectors
from quietwatch.llm.common import checkpointed, map_batches

#: Room for rounding when a bound is compared with a score, as a share of the largest possible score.
SLACK = 1e-9


@dataclass(frozen=True)
class PivotOptions:
    """Pivots are spread out among ``sample`` vectors chosen by a hash of the id; every vector is indexed."""

    pivots: int = 16
    annuli: int = 32
    sample: int = 512
    first_annuli: int = 3


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Farthest-first choice of rows, from the first row on; repeated rows are chosen once."""
    chosen = [0]
    away = ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < count and away.max() > 0:
        chosen.append(int(away.argmax()))
        away = np.minimum(away, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


def exact_top_k(
    rows: DataFrame, is_query, k: int, options: PivotOptions = PivotOptions(), scale: int | None = None
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` largest inner products of each query with all other vectors.

    ``rows`` has ``vec_id`` and ``vector`` as ``vectors.usable`` gives them; ``is_query`` picks the queries.  With
    ``scale`` each component becomes floor(scale * x) first.  Scores are exact while the sums stay below 2**53.
    Ties go to the smaller id; with fewer than ``k`` other vectors all are returned; an empty table gives no rows.
    """
    scaled = rows
    if scale is not None:
        scaled = rows.withColumn("vector", F.transform("vector", lambda x: F.floor(x * F.lit(float(scale))).cast("double")))
    base = checkpointed(scaled)
    square = F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)
    totals = base.agg(F.count("*").alias("n"), F.max(square).alias("m")).first()
    spark = base.sparkSession
    if not totals["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    top, blocks = float(totals["m"]), max(1, -(-totals["n"] // vectors.BLOCK_ROWS))
    drawn = base.orderBy(F.xxhash64(F.lit(5), "vec_id"), "vec_id").limit(options.sample).select("vector").collect()
    pivots = spread_out(np.array([r["vector"] for r in drawn]), options.pivots)
    lifted = np.c_[pivots, np.sqrt(np.maximum(0.0, top - (pivots**2).sum(1)))]
    width = (2.0 * np.sqrt(top) or 1.0) / options.annuli

    def file(batch):
        x = np.array(batch["vector"], dtype=np.float64)
        norms = (x**2).sum(1)
        y = np.c_[x, np.sqrt(np.maximum(0.0, top - norms))]
        away = np.sqrt(np.maximum(0.0, (y**2).sum(1)[:, None] + (lifted**2).sum(1)[None] - 2.0 * y @ lifted.T))
        nearest = away.argmin(1)
        distance = away[np.arange(len(x)), nearest]
        annulus = np.minimum((distance / width).astype(np.int64), options.annuli)
        return {
            "bucket": nearest * (options.annuli + 1) + annulus,
            "distance": distance,
            "vec_id": batch["vec_id"],
            "vec": vectors.packed(x),
        }

    index = checkpointed(map_batches(base, file, "bucket long, distance double, vec_id long, vec binary"))
    # at most pivots * (annuli + 1) rows
    edges = index.groupBy("bucket").agg(
        F.min("distance").alias("low"), F.max("distance").alias("high"), F.count("*").alias("n")
    ).orderBy("bucket").collect()
    bucket = np.array([r["bucket"] for r in edges])
    low, high = (np.array([r[c] for r in edges]) for c in ("low", "high"))
    counts = np.array([r["n"] for r in edges])
    pivot_of = bucket // (options.annuli + 1)
    slack = SLACK * (top + 1.0)

    def bounds(x: np.ndarray) -> np.ndarray:
        """The largest product that a vector of each annulus can have with each query."""
        norms = (x**2).sum(1)
        to_pivot = np.sqrt(np.maximum(0.0, norms[:, None] + top - 2.0 * x @ pivots.T))[:, pivot_of]
        gap = np.maximum(0.0, np.maximum(to_pivot - high[None], low[None] - to_pivot))
        return (norms[:, None] + top - gap**2) / 2.0

    def visit(batch, first: bool):
        out = {"query_id": [], "bucket": []}
        x = np.array([np.frombuffer(v, "<f8") for v in batch["vec"]])
        for query, least, bound in zip(batch["query_id"], batch["least"], bounds(x), strict=True):
            order = np.argsort(-bound, kind="stable")
            n_first = max(options.first_annuli, int(np.searchsorted(np.cumsum(counts[order]), k + 1)) + 1)
            if first:
                order = order[:n_first]
            else:
                rest = order[n_first:]
                order = rest[bound[rest] >= least - slack - SLACK * abs(least)]
            out["query_id"] += [query] * len(order)
            out["bucket"] += bucket[order].tolist()
        return out

    queries = index.filter(is_query).select(
        F.col("vec_id").alias("query_id"), "vec", F.lit(float("-inf")).alias("least")
    )
    sizes = vectors.bucket_sizes(index)
    home = vectors.placed(index, sizes, blocks)

    def search(asked: DataFrame, first: bool) -> DataFrame:
        visits = map_batches(asked, lambda b: visit(b, first), "query_id long, bucket long")
        return vectors.scan(home, vectors.addressed(visits, sizes, asked, blocks), k)

    near = checkpointed(vectors.ranked(search(queries, True), k).drop("rank"))
    asked = checkpointed(vectors.thresholds(queries, near, k))
    return vectors.ranked(near.unionByName(search(asked, False)), k)
