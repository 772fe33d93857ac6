"""Events to episodes to facts to classification to queue, as one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.operators import classify, episodes, facts, peers, queue
from quietwatch.operators.policy import ReportingPolicy, suppressed_by


def candidates_for(samples: DataFrame, events: DataFrame) -> DataFrame:
    """Correlation candidates: the sampled gap with its device's asset, source, network and cell.

    Placement is what the device last reported; the latest row per device is an aggregate.
    """
    placed = events.groupBy("device_ref").agg(
        F.max_by(
            F.struct(
                "tenant_id",
                "asset_ref",
                "source",
                peers.network_identity(F.col("network.mcc"), F.col("network.mnc")).alias(
                    "network_identity"
                ),
                F.concat(F.lit("cell_"), F.col("network.cell_id").cast("string")).alias("cell"),
            ),
            F.struct("received_at", "arrival"),
        ).alias("_p")
    )
    return samples.join(placed, "device_ref").select(
        "episode_id",
        "device_ref",
        "start_at",
        "_p.tenant_id",
        "_p.asset_ref",
        "_p.source",
        F.col("_p.network_identity").alias("sim_provider"),
        "_p.network_identity",
        "_p.cell",
    )


def episode_facts(
    samples: DataFrame,
    events: DataFrame,
    policy: ReportingPolicy,
    peer_rows: DataFrame | None = None,
    windows: DataFrame | None = None,
    corridor: DataFrame | None = None,
) -> DataFrame:
    """Facts per sampled episode from its shape, its device's signals and, if given, its peers.

    ``peer_rows`` has episode_id and peers; ``corridor`` has episode_id and corridor_qualified.
    """
    evidence = facts.device_evidence(events)
    inputs = (
        samples.join(evidence, "device_ref", "left")
        .withColumn(
            "episode",
            F.struct(
                "type",
                "duration_s",
                "missed_reports",
                "weak_basis",
                F.col("state_at_gap").alias("policy_state"),
                F.lit(policy.provenance).alias("sleep_provenance"),
            ),
        )
        .withColumn("recovery", F.when(F.col("end_at").isNotNull(), F.col("recovery")))
    )
    if peer_rows is not None:
        inputs = inputs.join(peer_rows, "episode_id", "left")
    if corridor is not None:
        inputs = inputs.join(corridor, "episode_id", "left")
    if windows is not None:
        inputs = suppressed_by(inputs, "start_at", windows, "_window").withColumn(
            "maintenance_active", F.col("_window").isNotNull()
        )
    return facts.derive_facts(
        inputs, ["episode_id", "device_ref", "type", "start_at", "end_at", "clock_basis"]
    )


def classified_episodes(
    events: DataFrame,
    policy: ReportingPolicy,
    at: Column,
    windows: DataFrame | None = None,
    window_s: int = peers.DEFAULT_WINDOW_S,
) -> DataFrame:
    """The whole evidence chain up to classification."""
    samples = episodes.with_episode_id(episodes.sample_episodes(events, policy, windows=windows))
    candidates = candidates_for(samples, events)
    assigned = peers.assign_clusters(peers.dimension_keys(candidates), window_s)
    found = peers.clusters(assigned)
    peer_rows = peers.peer_facts(candidates, assigned, found)
    derived = episode_facts(samples, events, policy, peer_rows, windows)
    return classify.classify(derived, at)


def review_queue(classified: DataFrame, events: DataFrame, now: Column) -> DataFrame:
    """Queue rows of classified episodes; a fired hypothesis sends an episode to review."""
    placed = events.groupBy("device_ref").agg(
        F.max_by(F.struct("asset_ref", "source"), F.struct("received_at", "arrival")).alias("_p")
    )
    state = (
        F.when(F.size("hypotheses") > 0, F.lit("review_required"))
        .when(F.col("end_at").isNotNull(), F.lit("monitoring"))
        .otherwise(F.lit("provisional"))
    )
    cases = (
        classified.join(placed, "device_ref")
        .withColumn("state", state)
        .withColumn("asset_ref", F.col("_p.asset_ref"))
        .withColumn("source", F.col("_p.source"))
        .withColumn("owner", F.lit(None).cast("string"))
        .withColumn("row_version", F.lit(1))
        .withColumn("last_defensible_observation_at", F.col("start_at"))
    )
    return queue.build_queue(cases, now)
