"""Reporting policies: intervals by motion state, deadlines and suppression windows."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators.quality import asleep

MOTION_STATES = ("moving", "ignition_on", "parked", "sleep", "exception")

POLICY_SCHEMA = (
    "cohort string, moving double, ignition_on double, parked double, sleep double,"
    " exception double, provenance string, sleep_after_stationary_s double,"
    " grace_factor double, version string, valid_from timestamp, valid_to timestamp"
)


@dataclass(frozen=True)
class ReportingPolicy:
    """One policy that applies to every event of a run."""

    moving: float = 60
    ignition_on: float = 120
    parked: float = 300
    sleep: float = 3600
    exception: float = 30
    provenance: str = "declared"
    grace_factor: float = 1.5
    version: str = "1.0.0"
    sleep_after_stationary_s: float | None = field(default=900)

    def column(self) -> Column:
        return F.struct(
            *[F.lit(float(getattr(self, s))).alias(s) for s in MOTION_STATES],
            F.lit(self.provenance).alias("provenance"),
            F.lit(float(self.grace_factor)).alias("grace_factor"),
            F.lit(self.version).alias("version"),
        )


def policy_struct() -> Column:
    """The policy fields of a policy table row as one struct."""
    return F.struct(*MOTION_STATES, "provenance", "grace_factor", "version")


def motion_state() -> Column:
    """State a report was made in; ``exception`` is never inferred."""
    return (
        F.when(asleep(), F.lit("sleep"))
        .when(F.col("motion.motion_state") == "moving", F.lit("moving"))
        .when(F.col("motion.ignition") == "on", F.lit("ignition_on"))
        .otherwise(F.lit("parked"))
    )


def interval_for(policy: Column, state: Column) -> Column:
    chosen = F.when(state == MOTION_STATES[0], policy[MOTION_STATES[0]])
    for name in MOTION_STATES[1:]:
        chosen = chosen.when(state == name, policy[name])
    return chosen


def deadline_ms(last_ms: Column, interval_s: Column, grace: Column, lag_p95_s: float) -> Column:
    """When silence becomes an episode: grace multiplies the interval, platform lag is added."""
    return (
        F.floor(last_ms + interval_s * grace * F.lit(1000.0) + F.lit(float(lag_p95_s) * 1000.0))
    ).cast("bigint")


def weak_basis(state: Column, provenance: Column) -> Column:
    return (state == "sleep") & (provenance != "declared")


def expected_next_report(
    reports: DataFrame,
    policy: Column,
    last_report_at: str = "last_report_at",
    state: str = "state",
    lag_p95_s: float = 0.0,
) -> DataFrame:
    """Add due time, deadline, interval, provenance and whether the basis is weak."""
    interval = interval_for(policy, F.col(state))
    last = ms(last_report_at)
    return reports.withColumns(
        {
            "due_at": from_ms(F.floor(last + interval * F.lit(1000.0)).cast("bigint")),
            "deadline_at": from_ms(
                deadline_ms(last, interval, policy["grace_factor"], lag_p95_s)
            ),
            "interval_s": interval,
            "policy_version": policy["version"],
            "provenance": policy["provenance"],
            "weak_basis": weak_basis(F.col(state), policy["provenance"]),
        }
    )


def suppression_windows(spark: SparkSession, windows: list[tuple]) -> DataFrame:
    """``(reason, from, to, approved_by)`` in priority order as a small dimension."""
    return spark.createDataFrame(
        [(i, *w) for i, w in enumerate(windows)],
        "ord int, reason string, from_at timestamp, to_at timestamp, approved_by string",
    )


# Lists of up to this many windows are broadcast, flattened to disjoint segments.
MAX_BROADCAST_WINDOWS = 100_000


def suppressed_by(rows: DataFrame, at: str, windows: DataFrame, name: str) -> DataFrame:
    """Reason of the first window (list order) that contains the instant; NULL when none does.

    The windows are flattened to disjoint segments, so a row searches its instant among them, whatever
    their number.  Segments of a checked number travel in a one-row broadcast; more are merged with the
    rows in time order.
    """
    from quietwatch.operators import segments, temporal

    listed = windows.filter(F.col("from_at") < F.col("to_at")).select(
        F.lit(0).alias("_all_rows"),
        ms("from_at").alias(segments.START),
        ms("to_at").alias(segments.END),
        (-F.col("ord").cast("bigint")).alias(segments.RANK),
        F.col("ord").alias(segments.ORDER),
        F.struct(F.col("reason")).alias(segments.VALUE),
    )
    flat = segments.disjoint(listed, ["_all_rows"])
    keyed = rows.withColumn("_all_rows", F.lit(0))
    if windows.limit(MAX_BROADCAST_WINDOWS + 1).count() <= MAX_BROADCAST_WINDOWS:
        found = temporal.look_up(keyed, flat, ["_all_rows"], ms(at), "_window_found")
    else:
        found = temporal.merge_up(keyed, flat, ["_all_rows"], ms(at), "_window_found")
    return found.withColumn(name, F.col("_window_found.reason")).drop("_all_rows", "_window_found")
