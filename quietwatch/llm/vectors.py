"""What both vector searches share: clean vectors, blocks of bounded size, and the scan of visited buckets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.llm.common import arrow_schema, batch_of

#: Vectors of one bucket that share a block; a fuller bucket is spread over several.
BLOCK_ROWS = 4_096
#: Found rows that a task keeps before it hands them over.
HELD = 200_000


def usable(rows: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``vec_id`` and ``vector`` (doubles) of the rows that take part in a search.

    Out: null ids, null or empty vectors, vectors with null or non-finite components, and vectors whose length is
    not the most common one (of equally common lengths the smaller counts).  Of rows with one id the smallest vector
    stays.
    """
    number = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    clean = (
        rows.select(
            F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector")
        )
        .filter("vec_id IS NOT NULL AND size(vector) > 0")
        .filter(F.forall("vector", number))
        .groupBy("vec_id")
        .agg(F.min("vector").alias("vector"))
    )
    lengths = clean.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    common = lengths.collect()
    return clean.filter(F.size("vector") == (common[0]["n"] if common else 0))


def packed(vectors: np.ndarray) -> list[bytes]:
    return [row.tobytes() for row in np.ascontiguousarray(vectors, dtype="<f8")]


def bucket_sizes(index: DataFrame) -> DataFrame:
    """How many vectors each bucket holds (``held``), and over how many blocks they are spread (``salts``)."""
    count = F.count("*")
    return index.groupBy("bucket").agg(count.alias("held"), F.ceil(count / BLOCK_ROWS).cast("int").alias("salts"))


def _block(blocks: int) -> Column:
    return F.pmod(F.xxhash64("bucket", "salt"), F.lit(blocks))


def placed(index: DataFrame, sizes: DataFrame, blocks: int) -> DataFrame:
    """``index`` (bucket, vec_id, vec) with the block of each row; hot buckets are salted by the id."""
    salted = index.join(sizes, "bucket").withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.col("salts")).cast("int"))
    return salted.select(_block(blocks).alias("block"), "bucket", "vec_id", "vec")


def addressed(visits: DataFrame, sizes: DataFrame, queries: DataFrame, blocks: int) -> DataFrame:
    """One row per query and block it visits: the query's vector, its threshold and the buckets to look into.

    ``visits`` (query_id, bucket) may name buckets that hold nothing; those go.
    """
    every_salt = F.explode(F.sequence(F.lit(0), F.col("salts") - 1))
    cells = visits.join(sizes, "bucket").select("query_id", "bucket", every_salt.alias("salt"))
    by_block = (
        cells.select("query_id", _block(blocks).alias("block"), "bucket")
        .groupBy("query_id", "block")
        .agg(F.collect_set("bucket").alias("buckets"))
    )
    return by_block.join(queries.select("query_id", "vec", "least"), "query_id")


_ROW = "block long, kind int, id long, vec binary, bucket long, buckets array<long>, least double"
_FOUND = "query_id long, vec_id long, score double"


def scan(index: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The best products of each query at or above its threshold, ties to the smaller id: its ``k`` best are among them.

    A block streams through one task: its vectors, of bounded number, and then its visits one by one.  Only the
    vectors of the buckets a visit names are compared with it; the query itself is not.  A task hands over the ``k``
    best of a query from all its blocks, as far as ``HELD`` rows hold them.
    """
    left = index.select(
        "block", F.lit(0).alias("kind"), F.col("vec_id").alias("id"), "vec", "bucket",
        F.lit(None).cast("array<long>").alias("buckets"), F.lit(None).cast("double").alias("least"),
    )
    right = visits.select(
        "block", F.lit(1).alias("kind"), F.col("query_id").alias("id"), "vec", F.lit(None).cast("long").alias("bucket"),
        "buckets", "least",
    )
    both = left.unionByName(right).repartition("block").sortWithinPartitions("block", "kind", "bucket")
    target = arrow_schema(index.sparkSession, _FOUND)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, ids, raw, buckets = None, [], [], []
        vectors = places = keys = None
        found: list[tuple[np.ndarray, ...]] = []
        held = 0
        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != at:
                    at, ids, raw, buckets, vectors = row["block"], [], [], [], None
                if row["kind"] == 0:
                    ids.append(row["id"])
                    raw.append(row["vec"])
                    buckets.append(row["bucket"])
                    continue
                if not ids:
                    continue
                if vectors is None:
                    vectors = np.frombuffer(b"".join(raw), "<f8").reshape(len(raw), -1)
                    keys, places = np.array(ids), _runs(buckets)
                spans = [places[b] for b in row["buckets"] if b in places]
                if not spans:
                    continue
                chosen = np.concatenate([np.arange(a, b) for a, b in spans])
                scores = np.einsum("ij,j->i", vectors[chosen], np.frombuffer(row["vec"], "<f8"))
                good = (scores >= row["least"]) & (keys[chosen] != row["id"])
                own, once = np.unique(keys[chosen][good], return_index=True)  # several tables may share a block
                scores = scores[good][once]
                best = np.lexsort((own, -scores))[:k]
                found.append((np.full(len(best), row["id"], np.int64), own[best], scores[best]))
                held += len(best)
                if held > HELD:
                    found = [_best(found, k)]
                    held = len(found[0][0])
                    if 2 * held > HELD:
                        yield batch_of(dict(zip(target.names, found.pop(), strict=True)), target)
                        held = 0
        if held:
            yield batch_of(dict(zip(target.names, _best(found, k), strict=True)), target)

    return both.mapInArrow(run, _FOUND)


def _best(found: list[tuple[np.ndarray, ...]], k: int) -> tuple[np.ndarray, ...]:
    """The ``k`` best different vectors of each query: ids of queries, of vectors, scores."""
    queries, ids, scores = (np.concatenate(part) for part in zip(*found, strict=True))
    order = np.lexsort((-scores, ids, queries))
    queries, ids, scores = queries[order], ids[order], scores[order]
    new = np.concatenate([[True], (queries[1:] != queries[:-1]) | (ids[1:] != ids[:-1])])
    order = np.flatnonzero(new)[np.lexsort((ids[new], -scores[new], queries[new]))]
    queries, ids, scores = queries[order], ids[order], scores[order]
    first = np.searchsorted(queries, queries)
    best = np.arange(len(queries)) - first < k
    return queries[best], ids[best], scores[best]


def _runs(buckets: list[int]) -> dict[int, tuple[int, int]]:
    """Start and end of each bucket in a sorted list."""
    values, starts = np.unique(np.array(buckets), return_index=True)
    ends = [*starts[1:], len(buckets)]
    return {int(v): (int(a), int(b)) for v, a, b in zip(values, starts, ends, strict=True)}


def ranked(found: DataFrame, k: int) -> DataFrame:
    """``rank`` from 1 for the ``k`` best different vectors of each query."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.dropDuplicates(["query_id", "vec_id"])
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


def thresholds(queries: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``queries`` with ``least``: the score of the k-th vector found so far, or minus infinity."""
    kth = ranked(found, k).filter(F.col("rank") == k).select("query_id", F.col("score").alias("kth"))
    least = F.coalesce("kth", F.lit(float("-inf")))
    return queries.drop("least").join(kth, "query_id", "left").withColumn("least", least).drop("kth")
