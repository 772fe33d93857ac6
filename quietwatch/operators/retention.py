"""Retention plans with legal holds, and deletion that leaves a tombstone."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms, ms

DAY_MS = 86_400_000

# Days each data class is kept (None: while needed for reproduction), and the caps.
RETENTION_DAYS: dict[str, int | None] = {
    "quarantined_payload": 14,
    "raw_receipt": 30,
    "normalized_telemetry": 90,
    "episode_evidence": 730,
    "decision_outcome": 730,
    "sla_aggregate": 1095,
    "audit_metadata": 730,
    "map_snapshot": None,
}
BACKUP_WINDOW_DAYS = 35
MAX_BACKUP_WINDOW_DAYS = 35
MAX_TELEMETRY_DAYS = 180
TOMBSTONE_SCHEMA = (
    "ref string, data_class string, deleted_at timestamp, run_id string, policy_version string,"
    " purged_from_backups_by timestamp"
)


def check_policy(days: Mapping[str, int | None], backup_days: int = BACKUP_WINDOW_DAYS) -> None:
    if backup_days > MAX_BACKUP_WINDOW_DAYS:
        raise ValueError(f"backup window of {backup_days} days is too long")
    telemetry = days.get("normalized_telemetry")
    if telemetry is not None and telemetry > MAX_TELEMETRY_DAYS:
        raise ValueError(f"normalized telemetry for {telemetry} days is too long")
    short = [c for c, d in days.items() if d is not None and d <= 0]
    if short:
        raise ValueError(f"kept for less than a day: {short}")


def active_holds(holds: DataFrame, now: Column) -> DataFrame:
    """A hold is active until its release."""
    return holds.filter(F.col("released_at").isNull() | (ms(now) < ms("released_at")))


def match_holds(items: DataFrame, holds: DataFrame) -> DataFrame:
    """Add ``hold_id`` of the first active hold (by ``ord``) that covers an item.

    ``holds``: ord, hold_id, tenant_id, entire_tenant, episode_ids, device_refs.  Each kind of
    selector becomes an equi-join against at most one row per key.
    """
    first = F.min(F.struct("ord", "hold_id"))
    whole = (
        holds.filter(F.coalesce("entire_tenant", F.lit(False)))
        .groupBy("tenant_id")
        .agg(first.alias("_by_tenant"))
    )

    def selector(array: str, key: str, name: str) -> DataFrame:
        return (
            holds.select("ord", "hold_id", "tenant_id", F.explode(array).alias(key))
            .groupBy("tenant_id", key)
            .agg(first.alias(name))
        )

    joined = (
        items.join(whole, "tenant_id", "left")
        .join(selector("episode_ids", "episode_id", "_by_episode"), ["tenant_id", "episode_id"], "left")
        .join(selector("device_refs", "device_ref", "_by_device"), ["tenant_id", "device_ref"], "left")
    )
    matches = F.array_compact(F.array("_by_tenant", "_by_episode", "_by_device"))
    return joined.withColumn("hold_id", F.array_min(matches)["hold_id"]).drop(
        "_by_tenant", "_by_episode", "_by_device"
    )


def read_tombstones(spark: SparkSession, path: str) -> DataFrame:
    """The tombstone table; no rows where no run has deleted anything yet."""
    try:
        return spark.read.parquet(path)
    except Exception as error:  # noqa: BLE001  the table begins with the first deletion
        if "PATH_NOT_FOUND" not in str(error):
            raise
    return spark.createDataFrame([], TOMBSTONE_SCHEMA)


def without_tombstones(items: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Items not yet deleted."""
    return items.join(tombstones.select("ref").distinct(), "ref", "left_anti")


def plan_retention(
    items: DataFrame,
    holds: DataFrame,
    now: Column,
    days: Mapping[str, int | None] = RETENTION_DAYS,
    backup_days: int = BACKUP_WINDOW_DAYS,
) -> DataFrame:
    """Decide every item: ``delete`` with its dates, or ``keep`` with the reason.

    A tombstone outranks a hold, and a hold outranks the due date.
    ``items``: ref, data_class, tenant_id, created_at, episode_id, device_ref, tombstoned_at,
    needed_for_reproduction.
    """
    check_policy(days, backup_days)
    limits = F.create_map(*[x for c, d in days.items() if d is not None for x in (F.lit(c), F.lit(d))])
    limit = F.try_element_at(limits, F.col("data_class"))
    due = ms("created_at") + limit.cast("bigint") * DAY_MS
    held = match_holds(items, active_holds(holds, now))
    reason = (
        F.when(F.col("tombstoned_at").isNotNull(), F.lit("already_tombstoned"))
        .when(F.col("hold_id").isNotNull(), F.lit("legal_hold"))
        .when(limit.isNull() & F.coalesce("needed_for_reproduction", F.lit(False)), F.lit("needed_for_reproduction"))
        .when(limit.isNotNull() & (due > ms(now)), F.lit("not_due"))
    )
    delete = reason.isNull()
    return held.select(
        "ref",
        "data_class",
        "tenant_id",
        F.when(delete, F.lit("delete")).otherwise(F.lit("keep")).alias("decision"),
        reason.alias("reason"),
        F.when(reason == "legal_hold", F.col("hold_id")).alias("hold_id"),
        F.when(delete, F.when(limit.isNull(), now).otherwise(from_ms(due))).alias("due_at"),
        F.when(delete, from_ms(ms(now) + backup_days * DAY_MS)).alias("purged_from_backups_by"),
    )


def kept_by_reason(plan: DataFrame) -> DataFrame:
    return plan.filter(F.col("decision") == "keep").groupBy("reason").agg(
        F.count(F.lit(1)).alias("items")
    )


def tombstones_for(plan: DataFrame, run_id: str, deleted_at: Column, policy_version: str) -> DataFrame:
    return plan.filter(F.col("decision") == "delete").select(
        "ref",
        "data_class",
        deleted_at.alias("deleted_at"),
        F.lit(run_id).alias("run_id"),
        F.lit(policy_version).alias("policy_version"),
        "purged_from_backups_by",
    )


def apply_retention(
    spark: SparkSession,
    plan: DataFrame,
    data_path: str,
    tombstone_path: str,
    staging_path: str,
    partition_column: str,
    run_id: str,
    deleted_at: Column,
    policy_version: str,
) -> int:
    """Delete due rows of a partitioned table and record a tombstone for each.

    Tombstones are written first: a crash in between leaves rows that the next run removes, never
    rows that vanished without a record.  Only partitions that hold due rows are rewritten, from a
    staged copy, and running again with the same plan changes nothing.  Returns rows deleted.
    """
    data = spark.read.parquet(data_path)
    due = plan.filter(F.col("decision") == "delete").select("ref").distinct()
    present = data.join(due, "ref", "left_semi")
    touched = present.groupBy(partition_column).agg(F.count(F.lit(1)).alias("_due")).checkpoint()
    deleted = touched.agg(F.coalesce(F.sum("_due"), F.lit(0))).first()[0]
    if not deleted:
        return 0
    marks = tombstones_for(plan, run_id, deleted_at, policy_version)
    marks = without_tombstones(marks, read_tombstones(spark, tombstone_path))
    marks.join(present.select("ref").distinct(), "ref", "left_semi").write.mode("append").parquet(
        tombstone_path
    )
    affected = data.join(F.broadcast(touched.select(partition_column)), partition_column, "left_semi")
    affected.join(due, "ref", "left_anti").write.mode("overwrite").partitionBy(partition_column).parquet(
        staging_path
    )
    # A partition may lose every row; dynamic overwrite would then leave it as it was.
    emptied = touched.select(partition_column).join(
        spark.read.schema(data.schema).parquet(staging_path).select(partition_column).distinct(),
        partition_column,
        "left_anti",
    )
    kept = spark.read.schema(data.schema).parquet(staging_path)
    (
        kept.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(partition_column)
        .parquet(data_path)
    )
    _drop_partitions(spark, data_path, partition_column, [r[0] for r in emptied.collect()])
    return int(deleted)


def _drop_partitions(spark: SparkSession, path: str, column: str, values: list) -> None:
    """Remove partition folders that hold no row any more (one entry per folder, not per row)."""
    jvm = spark._jvm
    for value in values:
        folder = jvm.org.apache.hadoop.fs.Path(f"{path}/{column}={value}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
