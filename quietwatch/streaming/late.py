"""Late reports revise episodes; the truth stays in tables, so a stream equals a batch."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quietwatch.operators.lifecycle import (
    VERSION_COLUMNS,
    apply_verdicts,
    current_versions,
    late_data_verdicts,
)
from quietwatch.streaming.tables import buckets_of, put_keyed, read_keyed, read_table


def revise_epoch(
    batch: DataFrame,
    epoch: int,
    base: str,
    required: int,
    interval_s: float,
    at: datetime,
    now: datetime,
) -> None:
    """Judge the episodes a micro-batch of late reports touches, on all reports seen so far.

    Versions and late reports lie in hash buckets of their episode; only the buckets of this batch are
    read.  Every epoch owns a partition and reads only earlier epochs, so a repeated epoch writes the
    same rows again.
    """
    spark = batch.sparkSession
    incoming = batch.select("episode_id", "at", "valid").persist()
    try:
        buckets = buckets_of(incoming, "episode_id")
        versions = read_keyed(spark, base, "versions", buckets, epoch)
        past = read_keyed(spark, base, "late_reports", buckets, epoch)
        reports = incoming if past is None else incoming.unionByName(past.select(*incoming.columns))
        touched = incoming.select("episode_id").distinct()
        current = current_versions(versions.join(touched, "episode_id", "left_semi"))
        actions = read_table(spark, base, "actions")
        if actions is None:
            actions = spark.createDataFrame([], "episode_id string")
        verdicts = late_data_verdicts(
            current, reports.join(touched, "episode_id", "left_semi"), required, interval_s
        )
        revised = apply_verdicts(
            current, verdicts, actions, F.lit(at).cast("timestamp"), F.lit(now).cast("timestamp")
        )
        applied = revised.filter(F.col("status") == "applied").select(*VERSION_COLUMNS)
        put_keyed(applied, base, "versions", "episode_id", epoch)
        put_keyed(incoming, base, "late_reports", "episode_id", epoch)
    finally:
        incoming.unpersist()


def stream_late_reports(
    reports: DataFrame,
    base: str,
    checkpoint: str,
    at: datetime,
    now: datetime,
    required: int = 3,
    interval_s: float = 300.0,
) -> StreamingQuery:
    """Run the revision for every micro-batch.  The base versions are epoch -1."""
    return (
        reports.writeStream.foreachBatch(
            lambda batch, epoch: revise_epoch(batch, epoch, base, required, interval_s, at, now)
        )
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def store_versions(spark: SparkSession, versions: DataFrame, base: str) -> None:
    """Write the opening versions before the stream starts."""
    put_keyed(versions.select(*VERSION_COLUMNS), base, "versions", "episode_id", -1)
