"""Fact derivation: typed values that are present, or absent with a reason."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.scalars import ms
from quietwatch.operators.rules import FACT_TYPES, fact_field

# Reasons a fact is unavailable.
NOT_SUPPLIED = "not supplied to fact derivation"
STILL_OPEN = "episode is still open"
NO_POWER_CUT = "capability manifest marks power-cut alerts unsupported"
NO_TAMPER = "capability manifest marks tamper alerts unsupported"
ASLEEP = "jamming detectors are disabled in deep sleep"
NO_GNSS_JAMMING = "device does not report GNSS jamming"
NO_NETWORK_JAMMING = "device does not report network jamming"
NOT_RESUMED = "reporting has not resumed"
NO_MODEL_REVIEW = "no reviewed fault-pattern analysis for this model"
NO_PEERS = "peer correlation has not run for this episode"
NO_PEER_COUNT = "peer cluster count is unavailable for the observed network identity"
NO_IDENTITY = "serving network identity was not observed before the gap"
NO_CORRIDOR = "corridor baseline has not been evaluated"

SECTIONS = {
    "episode": "struct<type:string,duration_s:double,missed_reports:bigint,weak_basis:boolean,"
    "policy_state:string,sleep_provenance:string>",
    "observations": "struct<moving:boolean,external_power_state:string,sleep_state:string>",
    "alerts_seen": "struct<power_cut:boolean,tamper:boolean,gnss_jamming:boolean,"
    "network_jamming:boolean>",
    "recovery": "struct<reboot_reported:boolean,sequence_reset:boolean>",
    "peers": "struct<source_independent_devices:bigint,network_independent_devices:bigint,"
    "network_identity_known:boolean,source_health_incident:boolean>",
    "model_fault_pattern": "boolean",
    "corridor_qualified": "boolean",
    "maintenance_active": "boolean",
    "capabilities": "array<string>",
}


def derive_facts(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """Add ``facts`` (one nullable field per fact) and ``unavailable`` (name to reason).

    ``inputs`` may carry any of the columns in ``SECTIONS``; a NULL or missing section makes its
    facts unavailable.  A missing ``capabilities`` list means every capability is supported.
    """
    for name, kind in SECTIONS.items():
        if name not in inputs.columns:
            inputs = inputs.withColumn(name, F.lit(None).cast(kind))
    c = F.col
    built: dict[str, tuple[Column, Column]] = {}

    def put(name: str, value: Column, reason: Column | str) -> None:
        reason = F.lit(reason) if isinstance(reason, str) else reason
        built[name] = (value.cast(FACT_TYPES[name]), reason)

    def supports(path: str) -> Column:
        return c("capabilities").isNull() | F.array_contains("capabilities", path)

    put("episode.type", c("episode.type"), NOT_SUPPLIED)
    put(
        "episode.duration_s",
        c("episode.duration_s"),
        F.when(c("episode").isNull(), F.lit(NOT_SUPPLIED)).otherwise(F.lit(STILL_OPEN)),
    )
    put("episode.missed_reports", c("episode.missed_reports"), NOT_SUPPLIED)
    put("policy.state_at_gap", c("episode.policy_state"), NOT_SUPPLIED)
    put("policy.sleep_provenance", c("episode.sleep_provenance"), NOT_SUPPLIED)
    put("policy.weak_basis", c("episode.weak_basis"), NOT_SUPPLIED)
    put("movement.moving_before_gap", c("observations.moving"), NOT_SUPPLIED)
    put("power.external_state_before_gap", c("observations.external_power_state"), NOT_SUPPLIED)
    put("device.sleep_state_before_gap", c("observations.sleep_state"), NOT_SUPPLIED)

    unseen = c("alerts_seen").isNull()
    put(
        "power.cut_alert_present",
        F.when(supports("alerts.power_cut"), c("alerts_seen.power_cut")),
        F.when(unseen, F.lit(NOT_SUPPLIED)).otherwise(F.lit(NO_POWER_CUT)),
    )
    put(
        "tamper.alert_present",
        F.when(supports("alerts.tamper"), c("alerts_seen.tamper")),
        F.when(unseen, F.lit(NOT_SUPPLIED)).otherwise(F.lit(NO_TAMPER)),
    )
    deep = F.coalesce(c("observations.sleep_state") == "deep_sleep", F.lit(False))
    for name, reason in (("gnss", NO_GNSS_JAMMING), ("network", NO_NETWORK_JAMMING)):
        put(
            f"{name}.jamming_alert",
            F.when(~deep & supports(f"alerts.{name}_jamming"), c(f"alerts_seen.{name}_jamming")),
            F.when(unseen, F.lit(NOT_SUPPLIED)).when(deep, F.lit(ASLEEP)).otherwise(F.lit(reason)),
        )
    put(
        "gnss.reports_continued",
        c("episode.type").isin("gnss_only_loss", "stale_position"),
        NOT_SUPPLIED,
    )
    put("device.reboot_after_gap", c("recovery.reboot_reported"), NOT_RESUMED)
    put("device.sequence_reset", c("recovery.sequence_reset"), NOT_RESUMED)
    put("device.model_fault_pattern", c("model_fault_pattern"), NO_MODEL_REVIEW)
    put("source.independent_devices", c("peers.source_independent_devices"), NO_PEERS)
    put("source.health_incident_active", c("peers.source_health_incident"), NO_PEERS)
    put("network.identity_known", c("peers.network_identity_known"), NO_PEERS)
    put(
        "network.independent_devices",
        c("peers.network_independent_devices"),
        F.when(c("peers").isNull(), F.lit(NO_PEERS))
        .when(c("peers.network_identity_known"), F.lit(NO_PEER_COUNT))
        .otherwise(F.lit(NO_IDENTITY)),
    )
    put("corridor.recurrence_qualified", c("corridor_qualified"), NO_CORRIDOR)
    put("maintenance.window_active", c("maintenance_active"), NOT_SUPPLIED)

    facts = F.struct(*[built[n][0].alias(fact_field(n)) for n in FACT_TYPES])
    reasons = F.map_from_entries(
        F.array_compact(
            F.array(
                *[
                    F.when(built[n][0].isNull(), F.struct(F.lit(n).alias("k"), built[n][1].alias("v")))
                    for n in FACT_TYPES
                ]
            )
        )
    )
    return inputs.select(*keep, facts.alias("facts"), reasons.alias("unavailable"))


def device_evidence(events: DataFrame) -> DataFrame:
    """Per device: alerts seen, last known motion and power, sleep and reboot signals.

    Only maxima and disjunctions, so each device is reduced before the shuffle.  An alert of a
    jamming kind is true or unknown, never false: without one the detector may not exist.
    """
    order = F.struct(ms("received_at"), F.col("arrival"))

    def alert(*codes: str) -> Column:
        return F.coalesce(
            F.bool_or(F.exists("alerts", lambda a: a["code"].isin(*codes))), F.lit(False)
        )

    def last(column: str) -> Column:
        value = F.col(column)
        return F.max_by(value, F.when(value.isNotNull(), order))

    moving = last("motion.motion_state")
    deep = F.coalesce(F.bool_or(F.col("device.sleep_state") == "deep_sleep"), F.lit(False))
    return events.groupBy("device_ref").agg(
        F.struct(
            (moving == "moving").alias("moving"),
            last("power.external_state").alias("external_power_state"),
            F.when(deep, F.lit("deep_sleep"))
            .otherwise(last("device.sleep_state"))
            .alias("sleep_state"),
        ).alias("observations"),
        F.struct(
            alert("power_cut").alias("power_cut"),
            alert("tamper", "unplug").alias("tamper"),
            F.when(alert("gnss_jamming"), F.lit(True)).alias("gnss_jamming"),
            F.when(alert("network_jamming"), F.lit(True)).alias("network_jamming"),
        ).alias("alerts_seen"),
        F.struct(
            F.coalesce(F.bool_or(F.col("device.reboot_reason").isNotNull()), F.lit(False)).alias(
                "reboot_reported"
            ),
            F.lit(False).alias("sequence_reset"),
        ).alias("recovery"),
    )
