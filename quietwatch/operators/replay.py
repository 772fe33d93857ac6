"""Bounded replay: contiguous windows, one job per window, a checkpoint after each."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms, ms

WINDOW_HOURS = 24
MAX_INTERVAL_DAYS = 90


def plan_windows(scopes: DataFrame, window_hours: int = WINDOW_HOURS) -> DataFrame:
    """Half-open windows covering ``[from_at, to_at)`` of every scope; the last may be short."""
    step = window_hours * 3_600_000
    start, end = ms("from_at"), ms("to_at")
    begins = F.when(end > start, F.sequence(start, end - 1, F.lit(step))).otherwise(
        F.array().cast("array<bigint>")
    )
    return scopes.select("*", F.posexplode(begins).alias("window_index", "_begin")).select(
        *[c for c in scopes.columns if c not in ("from_at", "to_at")],
        "window_index",
        from_ms("_begin").alias("window_from"),
        from_ms(F.least(F.col("_begin") + step, end)).alias("window_to"),
    )


def remaining_windows(windows: DataFrame, checkpoint_at: Column) -> DataFrame:
    """Windows that end after the checkpoint; a half-done window is redone whole."""
    return windows.filter(checkpoint_at.isNull() | (ms("window_to") > ms(checkpoint_at)))


@dataclass(frozen=True)
class ReplayScope:
    run_id: str
    tenant_id: str
    source: str
    from_at: datetime
    to_at: datetime
    approved_by: str
    reason: str


@dataclass(frozen=True)
class ReplayOutcome:
    status: str
    windows_processed: int
    checkpoint_at: datetime | None


def check_scope(scope: ReplayScope, now: datetime, max_days: int = MAX_INTERVAL_DAYS) -> list[str]:
    rejections = []
    if scope.to_at <= scope.from_at:
        rejections.append("inverted")
    if scope.to_at - scope.from_at > timedelta(days=max_days):
        rejections.append("too_long")
    if scope.from_at > now:
        rejections.append("future_interval")
    if not scope.approved_by:
        rejections.append("missing_approval")
    if not scope.reason:
        rejections.append("missing_reason")
    return rejections


_RUN_SCHEMA = (
    "run_id string, seq int, action string, status string, windows_total int, windows_done int,"
    " checkpoint_at timestamp, approved_by string, reason string"
)


def last_checkpoint(spark: SparkSession, run_path: str, run_id: str) -> datetime | None:
    try:
        runs = spark.read.schema(_RUN_SCHEMA).parquet(run_path)
        row = runs.filter(F.col("run_id") == run_id).agg(F.max("checkpoint_at")).first()
    except Exception as error:  # noqa: BLE001  no run was recorded yet
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    return row[0]


def run_replay(
    spark: SparkSession,
    scope: ReplayScope,
    source_rows: DataFrame,
    process: Callable[[DataFrame, datetime, datetime], None],
    run_path: str,
    at: str = "received_at",
    window_hours: int = WINDOW_HOURS,
    should_cancel: Callable[[], bool] = lambda: False,
) -> ReplayOutcome:
    """Process the remaining windows of a run in order.

    ``process`` receives the rows of one window and must write idempotently (for example with
    dynamic partition overwrite), since a failed window is run again whole.  The run table is the
    separate audit stream; it is append-only and also holds the checkpoint to resume from.
    """
    step = timedelta(hours=window_hours)
    windows, begin = [], scope.from_at
    while begin < scope.to_at:
        windows.append((begin, min(begin + step, scope.to_at)))
        begin = windows[-1][1]
    checkpoint = last_checkpoint(spark, run_path, scope.run_id)
    todo = [w for w in windows if checkpoint is None or w[1] > checkpoint]
    done = len(windows) - len(todo)
    seq = 0

    def record(action: str, status: str) -> None:
        nonlocal seq
        row = (
            scope.run_id, seq, action, status, len(windows), done, checkpoint, scope.approved_by, scope.reason,
        )
        seq += 1
        spark.createDataFrame([row], _RUN_SCHEMA).coalesce(1).write.mode("append").parquet(run_path)

    record("replay.started" if checkpoint is None else "replay.resumed", "running")
    for begin, end in todo:
        if should_cancel():
            record("replay.cancelled", "cancelled")
            return ReplayOutcome("cancelled", done, checkpoint)
        try:
            process(source_rows.filter((F.col(at) >= begin) & (F.col(at) < end)), begin, end)
        except Exception:  # noqa: BLE001  the window is reported and the checkpoint stays
            record("replay.failed", "failed")
            return ReplayOutcome("failed", done, checkpoint)
        done, checkpoint = done + 1, end
        record("replay.window", "running")
    record("replay.completed", "completed")
    return ReplayOutcome("completed", done, checkpoint)
