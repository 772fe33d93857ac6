"""Service-level reporting: telemetry and recovery measures kept apart, with a manifest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.percentiles import nearest_rank, nearest_rank_struct
from quietwatch.functions.scalars import ms, ratio, seconds_between

DEFINITIONS_VERSION = "1.0.0"
COHORT_SAMPLE_FLOOR = 8
COHORT_DIMENSIONS = ("vendor", "model", "firmware", "installer", "sim")


def telemetry_sla(events: DataFrame, episodes: DataFrame, active_asset_hours: Column) -> DataFrame:
    """One row: delivery lag, episode rate and durations, repeats and retractions.

    ``episodes``: current episode rows with device_ref, state, start_at, end_at.
    """
    timed = seconds_between("received_at", "device_time")
    lag = nearest_rank_struct(events, timed).select(F.col("percentiles").alias("lag"))
    durations = nearest_rank_struct(
        episodes, seconds_between("end_at", "start_at"), bucket_width=3600.0
    ).select(F.col("percentiles").alias("duration"))
    devices = episodes.groupBy("device_ref").agg(
        F.count(F.lit(1)).alias("_n"), F.count_if(F.col("state") == "retracted").alias("_retracted")
    )
    counts = devices.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("opened_episodes"),
        F.coalesce(F.sum("_retracted"), F.lit(0)).alias("retracted_episodes"),
        F.count(F.lit(1)).alias("devices_with_episodes"),
        F.count_if(F.col("_n") > 1).alias("devices_with_repeats"),
    )
    return (
        counts.join(lag)
        .join(durations)
        .withColumn("active_asset_hours", active_asset_hours)
        .select(
            F.col("lag.p50").alias("delivery_lag_p50_s"),
            F.col("lag.p95").alias("delivery_lag_p95_s"),
            ratio(F.col("opened_episodes") * 1000, F.col("active_asset_hours")).alias(
                "episodes_per_1000_asset_hours"
            ),
            F.col("duration.p50").alias("episode_duration_p50_s"),
            F.col("duration.p95").alias("episode_duration_p95_s"),
            "devices_with_repeats",
            "retracted_episodes",
            F.col("lag.count").alias("accepted_events"),
            "opened_episodes",
            "active_asset_hours",
            "devices_with_episodes",
        )
    )


def backfill_completeness(late_accepted: Column, expected: Column) -> Column:
    """Late records accepted over records expected during gaps."""
    return F.struct(
        late_accepted.alias("numerator"),
        expected.alias("denominator"),
        ratio(late_accepted, expected).alias("value"),
    )


def recovery_sla(reviews: DataFrame, actions: DataFrame, aging: DataFrame) -> DataFrame:
    """One row: time to review, time to action and the aging of unresolved cases.

    ``reviews``: opened_at, first_review_at.  ``actions``: opened_at, started_at.
    ``aging``: aging_list, actions (from ``outcomes.aging_report``).
    """
    review = nearest_rank_struct(
        reviews, seconds_between("first_review_at", "opened_at"), bucket_width=3600.0
    ).select(F.col("percentiles.p50").alias("time_to_review_p50_s"))
    action = nearest_rank_struct(
        actions, seconds_between("started_at", "opened_at"), bucket_width=3600.0
    ).select(F.col("percentiles.p95").alias("time_to_action_p95_s"))
    lists = aging.groupBy().agg(
        F.map_from_entries(
            F.array_sort(F.collect_list(F.struct("aging_list", "actions")))
        ).alias("unresolved_aging")
    )
    return review.join(action).join(lists)


def cohort_comparison(devices: DataFrame) -> DataFrame:
    """Episode rate per cohort of each dimension; small cohorts carry no rate at all.

    ``devices``: device_ref, vendor, model, firmware, installer, sim, episodes, asset_hours.
    Every device counts once in each dimension it has a value for.
    """
    cells = F.explode(
        F.array(
            *[
                F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("key"))
                for d in COHORT_DIMENSIONS
            ]
        )
    ).alias("c")
    grouped = (
        devices.select("episodes", "asset_hours", cells)
        .filter(F.col("c.key").isNotNull())
        .groupBy("c.dimension", "c.key")
        .agg(
            F.count(F.lit(1)).alias("sample_size"),
            F.sum("episodes").alias("_episodes"),
            F.sum("asset_hours").alias("_hours"),
        )
    )
    enough = F.col("sample_size") >= COHORT_SAMPLE_FLOOR
    return grouped.select(
        "dimension",
        "key",
        "sample_size",
        F.when(enough, F.lit("reported")).otherwise(F.lit("insufficient")).alias("status"),
        F.when(
            enough,
            F.coalesce(ratio(F.col("_episodes") * 1000, F.col("_hours")), F.lit(0.0)),
        ).alias("episodes_per_1000_asset_hours"),
    )


def with_manifest(
    report: DataFrame,
    report_id: str,
    rule_version: str,
    fact_vocabulary_version: str,
    clock_basis: str,
) -> DataFrame:
    """Add the manifest of a one-row report, hashed over the report body."""
    body = F.struct(*report.columns)
    return report.withColumn(
        "manifest",
        F.struct(
            F.lit(report_id).alias("report_id"),
            F.lit(clock_basis).alias("clock_basis"),
            F.lit(rule_version).alias("rule_version"),
            F.lit(fact_vocabulary_version).alias("fact_vocabulary_version"),
            F.lit(DEFINITIONS_VERSION).alias("metric_definitions_version"),
            body_hash(body).alias("integrity_sha256"),
        ),
    )


def body_hash(body: Column) -> Column:
    return F.sha2(F.to_json(body, {"ignoreNullFields": "false"}), 256)


def manifest_holds(report: DataFrame) -> DataFrame:
    """Hash the body again; a reproduced report must match its manifest."""
    body = F.struct(*[c for c in report.columns if c != "manifest"])
    return report.select(
        (body_hash(body) == F.col("manifest.integrity_sha256")).alias("intact")
    )


def report_rows(report: DataFrame, cohorts: DataFrame, aging: DataFrame) -> DataFrame:
    """The report one metric per row: section, metric, value, denominator."""
    def row(section: str, metric: str, value: Column, denominator: Column | None = None) -> Column:
        return F.struct(
            F.lit(section).alias("section"),
            F.lit(metric).alias("metric"),
            F.coalesce(value.cast("string"), F.lit("")).alias("value"),
            (F.lit("") if denominator is None else denominator.cast("string")).alias("denominator"),
        )

    c = F.col
    head = report.select(
        F.inline(
            F.array(
                row("manifest", "report_id", c("manifest.report_id")),
                row("manifest", "metric_definitions_version", c("manifest.metric_definitions_version")),
                row("manifest", "integrity_sha256", c("manifest.integrity_sha256")),
                row("manifest", "clock_basis", c("manifest.clock_basis")),
                row("manifest", "rule_version", c("manifest.rule_version")),
                row("telemetry", "delivery_lag_p50_s", c("delivery_lag_p50_s"), c("accepted_events")),
                row("telemetry", "delivery_lag_p95_s", c("delivery_lag_p95_s"), c("accepted_events")),
                row(
                    "telemetry",
                    "episodes_per_1000_asset_hours",
                    c("episodes_per_1000_asset_hours"),
                    c("active_asset_hours"),
                ),
                row(
                    "telemetry",
                    "retraction_rate",
                    F.concat_ws("/", c("retracted_episodes").cast("string"), c("opened_episodes").cast("string")),
                    c("opened_episodes"),
                ),
            )
        )
    )
    compared = cohorts.select(
        F.lit("cohort").alias("section"),
        F.concat_ws(":", "dimension", "key").alias("metric"),
        F.when(c("status") == "insufficient", F.lit("insufficient sample"))
        .otherwise(c("episodes_per_1000_asset_hours").cast("string"))
        .alias("value"),
        c("sample_size").cast("string").alias("denominator"),
    )
    ages = aging.select(
        F.lit("recovery").alias("section"),
        F.concat(F.lit("unresolved_"), "aging_list").alias("metric"),
        c("actions").cast("string").alias("value"),
        F.lit("").alias("denominator"),
    )
    return head.unionByName(compared).unionByName(ages)


def lag_by_source(events: DataFrame) -> DataFrame:
    return nearest_rank(events, seconds_between("received_at", "device_time"), ["source"])


def dashboard(items: DataFrame, events: DataFrame, episodes: DataFrame) -> DataFrame:
    """One row of queue statistics; lags below zero count as zero, open gaps are not charted."""
    lag = F.greatest(F.lit(0.0), seconds_between("received_at", "device_time"))
    lags = nearest_rank_struct(events, F.when(F.col("device_time").isNotNull(), lag)).select(
        F.col("percentiles.p95").alias("delivery_lag_p95_s")
    )
    stats = items.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.col("tier") == "urgent").alias("urgent_tier"),
        F.count_if(F.col("band") == "direct").alias("direct_evidence"),
        F.count_if(F.col("band").isNull()).alias("without_band"),
        F.count_if(F.col("due_state") == "overdue").alias("overdue"),
    )
    gaps = episodes.agg(
        F.count_if(F.col("end_at").isNull()).alias("open_episodes"),
        F.coalesce(
            F.sum(F.floor((ms("end_at") - ms("start_at")) / F.lit(60000.0) + F.lit(0.5))), F.lit(0)
        )
        .cast("bigint")
        .alias("closed_gap_minutes"),
    )
    return stats.join(lags).join(gaps)


def counts_by(items: DataFrame, column: str) -> DataFrame:
    return items.groupBy(F.coalesce(F.col(column), F.lit("unknown")).alias(column)).agg(
        F.count(F.lit(1)).alias("count")
    )
