"""The full audit: files in, a checked findings bundle out."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.percentiles import nearest_rank_struct
from quietwatch.operators import episodes, quality, temporal
from quietwatch.operators.policy import ReportingPolicy
from quietwatch.operators.redact import Bundle, emit_bundle
from quietwatch.session import checkpoint_dir
from quietwatch.sources.ingest import Imported, ImportRun, import_rows, in_file_order
from quietwatch.sources.readers import read_batch


@dataclass(frozen=True)
class AuditReport:
    imported: Imported
    bundle: Bundle


def audit_sections(
    events: DataFrame,
    policy: ReportingPolicy,
    assignments: DataFrame | None = None,
    destructive: DataFrame | None = None,
    retention: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Publishable sections: aggregates with their device denominators, no rows and no identifiers."""
    devices = events.agg(
        F.count(F.lit(1)).alias("observation_count"), F.count_distinct("device_ref").alias("device_count")
    )

    lags = quality.lag_percentiles(events).groupBy().pivot(
        "lag", ["platform_lag_s", "total_lag_s", "device_to_vendor_lag_s"]
    ).agg(F.first(F.struct("count", "p50", "p95", "p99", "min", "max")))
    integrity = quality.integrity(events).select("duplicate_rate", "out_of_order_rate", "backfill_rate")
    impossible = quality.impossible_values(events).groupBy().agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "count")))).alias(
            "impossible_value_counts"
        )
    )
    samples = episodes.sample_episodes(events, policy)
    counts = samples.agg(
        F.count(F.lit(1)).alias("episode_count"),
        F.count_distinct("device_ref").alias("devices_with_episodes"),
        F.count_if(F.col("suppressed_by").isNotNull()).alias("suppressed_count"),
        F.count_if("weak_basis").alias("weak_basis_count"),
    )
    durations = nearest_rank_struct(samples, F.col("duration_s"), 3600.0).withColumnRenamed(
        "percentiles", "duration_s"
    )
    if assignments is None:
        resolved = events.select("device_ref", F.lit(None).cast("string").alias("resolved"))
    else:
        resolved = temporal.resolve_at(
            events.select("device_ref", "received_at"),
            assignments,
            ["device_ref"],
            "received_at",
            ["asset_ref"],
            "record_id",
        )
    covered = temporal.coverage(resolved).select(
        F.col("coverage").alias("assignment_coverage"), "unmapped_device_count"
    )
    sections = {
        "completeness": quality.completeness(events),
        "timing": lags.join(devices),
        "integrity": integrity.join(impossible).join(devices),
        "episodes": counts.join(durations).join(
            devices.select("device_count", F.col("device_count").alias("devices_observed"))
        ),
        "assignments": covered.join(devices.select("device_count")),
    }
    if destructive is not None and retention is not None:
        sections["platform_configuration"] = quality.platform_findings(destructive, retention).select(
            "source",
            "setting",
            "sufficient",
            F.col("blocking").alias("blocking_findings"),
        )
    return sections


SINGLE_ROW_SECTIONS = ("timing", "integrity", "episodes", "assignments")


def run_audit(
    spark: SparkSession,
    files: Sequence[str],
    run: ImportRun,
    policy: ReportingPolicy,
    manifest: dict,
    assignments: DataFrame | None = None,
    destructive: DataFrame | None = None,
    retention: DataFrame | None = None,
) -> AuditReport:
    """Import, measure, sample, suppress, check and list; refuse to publish on any violation.

    Observations are cut off by a reliable checkpoint: six sections read them, and parsing and
    deduplicating once is worth one write.
    """
    checkpoint_dir(spark)
    imported = import_rows(read_batch(spark, files), run)
    events = in_file_order(imported.observations.drop("raw", "ext")).checkpoint()
    sections = audit_sections(events, policy, assignments, destructive, retention)
    return AuditReport(imported, emit_bundle(sections, manifest, SINGLE_ROW_SECTIONS))
