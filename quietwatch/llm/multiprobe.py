"""Approximate nearest neighbours: p-stable hashing, several tables, several buckets of each.

A table hashes a vector by ``projections`` Gaussian directions, each cut into cells of one width.  Besides its own
bucket a query visits neighbouring ones, in the order of their estimated success: the sum of squared distances from
the query's projections to the cells.  All tables' candidates are scored exactly on the original vectors.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quietwatch.llm import vectors
from quietwatch.llm.common import checkpointed, map_batches


@dataclass(frozen=True)
class HashOptions:
    """The cell width is ``width`` times the spread of the projections, measured on ``sample`` vectors.

    Without ``projections`` their number is half the binary logarithm of the number of vectors, at least ``fewest``, and
    without ``probes`` a table is probed 50 * 1.5 ** projections times: buckets become finer as the table grows and a
    query looks at a falling share of all vectors, by one rule at every size.
    """

    tables: int = 3
    projections: int | None = None
    fewest: int = 4
    width: float = 1.5
    probes: int | None = None
    first_probes: int = 40
    reach: int = 3
    sample: int = 2_048
    seed: int = 17


def probe_order(position: np.ndarray, probes: int, reach: int) -> list[tuple[int, ...]]:
    """The ``probes`` cells nearest to a position (in cell widths), the own cell first.

    Per direction the shifts up to ``reach`` cells are sorted by squared distance; a heap joins one shift of each
    direction, so cells come out in the order of the sum.
    """
    shifts = range(-reach, reach + 1)
    part = position - np.floor(position)
    base = np.floor(position).astype(int)
    options = []
    for f in part:
        cost = sorted((max(0.0, s - f, f - s - 1) ** 2, abs(s), s) for s in shifts)
        options.append([(c, s) for c, _, s in cost])
    n = len(options)
    heap, out = [(0.0, (0,) * n, 0)], []
    while heap and len(out) < probes:
        cost, ranks, last = heapq.heappop(heap)
        out.append(tuple(int(b + options[d][r][1]) for d, (b, r) in enumerate(zip(base, ranks, strict=True))))
        for d in range(last, n):  # raising only this direction or later ones reaches each combination once
            r = ranks[d] + 1
            if r < len(options[d]):
                more = cost - options[d][r - 1][0] + options[d][r][0]
                heapq.heappush(heap, (more, (*ranks[:d], r, *ranks[d + 1 :]), d))
    return out


def bucket_id(table: int, cell) -> int:
    """A 63-bit name of a cell; two cells that share a name would only add candidates."""
    return xxhash.xxh3_64_intdigest(np.array([table, *cell], "<i4").tobytes()) >> 1


def search(rows: DataFrame, is_query, k: int, options: HashOptions = HashOptions()) -> DataFrame:
    """``query_id, rank, vec_id, score``: up to ``k`` vectors with the largest inner product among the candidates.

    ``rows`` has ``vec_id`` and ``vector`` as ``vectors.usable`` gives them; zero vectors must be gone.  Every vector
    is indexed.  Buckets of any size are searched whole.  A query whose buckets hold fewer than ``k`` other vectors is
    compared with all vectors, so it gets its full number.  Hashing uses unit vectors, scores the original ones.
    """
    base = checkpointed(rows)
    spark = base.sparkSession
    n = base.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    drawn = base.orderBy(F.xxhash64(F.lit(3), "vec_id"), "vec_id").limit(options.sample).select("vector").collect()
    sample = np.array([r["vector"] for r in drawn])
    rng = np.random.default_rng(options.seed)
    projections = options.projections or max(options.fewest, (n.bit_length() - 1) // 2)
    probes = options.probes or round(50 * 1.5**projections)
    directions = rng.standard_normal((options.tables, projections, sample.shape[1]))
    unit = lambda x: x / (np.sqrt((x**2).sum(1))[:, None])
    width = options.width * (float((unit(sample) @ directions.reshape(-1, sample.shape[1]).T).std()) or 1.0)
    offsets = rng.uniform(0.0, 1.0, (options.tables, projections))

    def positions(x: np.ndarray) -> np.ndarray:
        """By table, row and direction, in cell widths."""
        u = unit(x)
        return np.stack([u @ directions[t].T / width + offsets[t] for t in range(options.tables)])

    def file(batch):
        x = np.array(batch["vector"], dtype=np.float64)
        cells = np.floor(positions(x)).astype(int)
        raw = vectors.packed(x)
        return {
            "bucket": [bucket_id(t, c) for t in range(options.tables) for c in cells[t]],
            "vec_id": batch["vec_id"] * options.tables,
            "vec": raw * options.tables,
        }

    blocks = max(1, -(-n * options.tables // vectors.BLOCK_ROWS))
    index = checkpointed(map_batches(base, file, "bucket long, vec_id long, vec binary"))
    sizes = checkpointed(vectors.bucket_sizes(index))
    home = vectors.placed(index, sizes, blocks)
    queries = map_batches(
        base.filter(is_query),
        lambda b: {"query_id": b["vec_id"], "vec": vectors.packed(np.array(b["vector"])), "least": [float("-inf")] * len(b["vec_id"])},
        "query_id long, vec binary, least double",
    )

    def probe(batch):
        out = {"query_id": [], "bucket": [], "step": []}
        place = positions(np.array([np.frombuffer(v, "<f8") for v in batch["vec"]]))
        for i, query in enumerate(batch["query_id"]):
            for t in range(options.tables):
                cells = probe_order(place[t, i], probes, options.reach)
                out["query_id"] += [query] * len(cells)
                out["bucket"] += [bucket_id(t, c) for c in cells]
                out["step"] += range(len(cells))
        return out

    visits = checkpointed(map_batches(queries, probe, "query_id long, bucket long, step int"))
    early = F.col("step") < options.first_probes

    def look(chosen: DataFrame, asked: DataFrame) -> DataFrame:
        return vectors.scan(home, vectors.addressed(chosen.select("query_id", "bucket"), sizes, asked, blocks), k)

    near = checkpointed(vectors.ranked(look(visits.filter(early), queries), k).drop("rank"))
    asked = checkpointed(vectors.thresholds(queries, near, k))
    found = checkpointed(vectors.ranked(near.unionByName(look(visits.filter(~early), asked)), k))
    # queries in regions with fewer vectors than they ask for see every vector once
    full = found.filter(F.col("rank") == min(k, n - 1)).select("query_id")
    thin = checkpointed(queries.join(full, "query_id", "left_anti"))
    if thin.isEmpty():
        return found
    first = map_batches(base, lambda b: _first_table(b, file), "bucket long, vec_id long, vec binary")
    whole = first.withColumn("bucket", F.pmod(F.xxhash64("vec_id"), F.lit(blocks)))
    spread = vectors.bucket_sizes(whole)
    every = thin.select("query_id").withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    rest = vectors.scan(
        vectors.placed(whole, spread, blocks), vectors.addressed(every, spread, thin, blocks), k
    )
    return found.join(thin.select("query_id"), "query_id", "left_anti").unionByName(vectors.ranked(rest, k))


def _first_table(batch, file):
    rows = file(batch)
    n = len(batch["vec_id"])
    return {name: values[:n] for name, values in rows.items()}
