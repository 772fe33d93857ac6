"""What the operators of this folder share: sessions, tables, Arrow maps and word hashes."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from quietwatch.session import checkpoint_dir, configure, scratch_path

#: Texts may be long, so a batch holds few of them.
BATCH_ROWS = 512

#: What each kind of work keeps in a Python worker, by how to drop it, and the kind that was done last.
KEPT: dict[str, Callable[[], None]] = {}
_LAST: list[str] = [""]


def give_back() -> None:
    """Return freed memory to the system: an idle worker would hold what its largest task took."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it, others need not
    if trim is not None:
        trim(0)


def working_as(kind: str) -> None:
    """Drop what other kinds of work have left in this worker; workers outlive their stage."""
    if _LAST[0] != kind:
        for other, drop in KEPT.items():
            if other != kind:
                drop()
        give_back()
        _LAST[0] = kind


def prepare(spark: SparkSession) -> SparkSession:
    """Settings of this folder.  Shuffle files go when the action that made them ends: checkpoints hold what is used again."""
    configure(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return spark


def bounded_batches(spark: SparkSession, size: str = "4m") -> SparkSession:
    """Settings of this folder, and Arrow batches that end at a number of bytes, however long their texts are."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the cluster's shared folder: lineage ends here."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def checkpointed(df: DataFrame) -> DataFrame:
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def map_batches(
    df: DataFrame,
    function: Callable[[dict[str, list]], dict[str, list]],
    schema: str,
) -> DataFrame:
    """``function`` turns the columns of one batch, as lists, into output columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield _batch(function(batch.to_pydict()), target)
        give_back()

    target = arrow_schema(df.sparkSession, schema)
    return df.mapInArrow(run, schema)


def arrow_schema(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = (columns[f.name] for f in schema)
    arrays = [a if isinstance(a, pa.Array) else pa.array(a, type=f.type) for a, f in zip(arrays, schema, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, schema=schema)


batch_of = _batch


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes of words; to hash a word anew costs less than to look it up among very many."""
    working_as("words")
    return np.frombuffer(b"".join(map(xxhash.xxh3_64_digest, words)), ">u8").astype(np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def gram_hashes(words: np.ndarray, n: int, multiplier: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of ``n`` consecutive words, none if there are fewer."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    size = len(words) - n + 1
    h = words[:size].copy()
    k = np.uint64(multiplier)
    for i in range(1, n):
        h = h * k + words[i : i + size]
    return mixed(h)
