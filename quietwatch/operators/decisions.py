"""Controlled decisions: canonical reasons, a second person, and a fresh view of the case."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Decision:
    decision_id: str
    label: str
    to_state: str
    reasons: tuple[str, ...]
    high_impact: bool
    world_affecting: bool


# The decisions with their approved reasons.
DECISIONS = (
    Decision(
        "classify_explained",
        "Classify as explained (no further action)",
        "classified",
        (
            "documented sleep matches the gap",
            "approved maintenance window covers the gap",
            "source outage explains the gap",
            "device fault confirmed by pattern",
            "late data closed the gap",
        ),
        False,
        False,
    ),
    Decision(
        "classify_suspicious",
        "Classify as suspicious (evidence supports interference)",
        "classified",
        (
            "device telemetry supports possible tracker interference",
            "power removed without documented cause",
            "corroborated multi-family evidence with no benign explanation",
        ),
        True,
        False,
    ),
    Decision(
        "retract",
        "Retract (the gap did not occur)",
        "retracted",
        (
            "buffered records show continuous reporting",
            "episode opened on a policy misconfiguration",
            "duplicate of another episode",
        ),
        False,
        False,
    ),
    Decision(
        "authorize_field_verification",
        "Authorize field verification",
        "action_open",
        (
            "urgent-eligible evidence requires physical verification",
            "repeated qualified corridor recurrence",
        ),
        True,
        True,
    ),
    Decision(
        "authorize_recovery_action",
        "Authorize recovery action",
        "action_open",
        (
            "direct evidence with completed review and verified location",
            "contractual default confirmed with evidence pack attached",
        ),
        True,
        True,
    ),
)


def decision_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(d.decision_id, d.label, d.to_state, list(d.reasons), d.high_impact, d.world_affecting) for d in DECISIONS],
        "decision_id string, label string, decision_state string, reasons array<string>,"
        " high_impact boolean, world_affecting boolean",
    )


def suggestions(codes: Column) -> Column:
    """Rendered advice from fired hypotheses; never a decision that affects the world."""
    def advice(when: Column, basis: str) -> Column:
        return F.when(
            when,
            F.struct(F.lit("classify_explained").alias("decision_id"), F.lit(basis).alias("basis")),
        )

    return F.array_compact(
        F.array(
            advice(
                F.array_contains(codes, "H-EXPECTED"),
                "H-EXPECTED fired: the effective policy predicts this silence",
            ),
            advice(
                F.array_contains(codes, "H-VENDOR") | F.array_contains(codes, "H-NETWORK"),
                "a source-level cluster explains the gap without a device-level cause",
            ),
        )
    )


def check_proposals(proposals: DataFrame, current: DataFrame) -> DataFrame:
    """Status of a proposal when it is made: proposed, or why it is refused.

    ``proposals``: proposal_id, episode_id, decision_id, reason, proposed_by, seen_version_count.
    ``current``: current episode versions with ``version_count``.
    """
    spark = proposals.sparkSession
    joined = proposals.join(
        F.broadcast(decision_table(spark)), "decision_id", "left"
    ).join(current.select("episode_id", "version_count"), "episode_id", "left")
    status = (
        F.when(F.col("label").isNull(), F.lit("unknown_decision"))
        .when(~F.array_contains("reasons", F.col("reason")), F.lit("non_canonical_reason"))
        .when(~F.col("seen_version_count").eqNullSafe(F.col("version_count")), F.lit("stale_basis"))
        .otherwise(F.lit("proposed"))
    )
    return joined.withColumn("status", status).drop("label", "decision_state", "reasons", "version_count")


def resolve_proposals(proposals: DataFrame, resolutions: DataFrame, current: DataFrame) -> DataFrame:
    """Outcome of approvals and rejections.

    ``resolutions``: proposal_id, verdict (approve or reject), resolved_by, resolved_at.
    A machine suggestion, a settled proposal, self-approval of a high-impact decision and an episode
    that moved are each refused by name.  ``applied`` rows carry the transition to request.
    """
    spark = proposals.sparkSession
    joined = (
        proposals.join(resolutions, "proposal_id")
        .join(
            F.broadcast(decision_table(spark).withColumnRenamed("high_impact", "_high")).select(
                "decision_id", "label", "decision_state", "_high"
            ),
            "decision_id",
        )
        .join(current.select("episode_id", "version_count"), "episode_id", "left")
    )
    approve = F.col("verdict") == "approve"
    machine = F.col("kind") != "human_proposal"
    outcome = (
        F.when(approve & machine, F.lit("machine_origin"))
        .when(F.col("status") != "proposed", F.lit("not_pending"))
        .when(~approve, F.lit("rejected"))
        .when(F.col("_high") & (F.col("resolved_by") == F.col("proposed_by")), F.lit("self_approval"))
        .when(~F.col("seen_version_count").eqNullSafe(F.col("version_count")), F.lit("superseded"))
        .otherwise(F.lit("applied"))
    )
    applied = F.col("outcome") == "applied"
    return joined.withColumn("outcome", outcome).select(
        "proposal_id",
        "episode_id",
        "decision_id",
        "outcome",
        F.when(applied, F.col("decision_state")).alias("to_state"),
        F.when(applied, F.lit("human_decision")).alias("cause"),
        F.when(applied, F.col("proposed_by")).alias("actor"),
        F.when(
            applied,
            F.concat(
                "label",
                F.lit(": "),
                "reason",
                F.when(F.col("note").isNull(), F.lit("")).otherwise(F.concat(F.lit(". Note: "), "note")),
            ),
        ).alias("reason"),
        F.when(applied & F.col("_high"), F.col("resolved_by")).alias("approved_by"),
        "resolved_by",
        F.col("resolved_at").alias("at"),
    )


def apply_decisions(
    proposals: DataFrame, resolutions: DataFrame, current: DataFrame, actions: DataFrame, now: Column
) -> DataFrame:
    """Version rows that approved proposals append (see ``lifecycle.apply_transitions``)."""
    from quietwatch.operators.lifecycle import apply_transitions

    applied = resolve_proposals(proposals, resolutions, current).filter(F.col("outcome") == "applied")
    requests = applied.select("episode_id", "to_state", "cause", "actor", "reason", "at", "approved_by")
    return apply_transitions(current, requests, actions, now)
