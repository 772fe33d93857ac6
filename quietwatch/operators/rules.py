"""Declarative three-valued rules compiled to column expressions.

A rule is data.  Facts are typed nullable fields of a ``facts`` struct, NULL meaning unavailable, so
"could not check" stays apart from "checked and found nothing" without any Python per row.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quietwatch.functions.scalars import any_of, ms

FactTest = tuple[str, str, object]
Predicate = FactTest | tuple[str, list]


@dataclass(frozen=True)
class Rule:
    rule_id: str
    hypothesis: str
    required: tuple[str, ...]
    optional: tuple[str, ...]
    positive: tuple[Predicate, ...]
    negative: tuple[Predicate, ...]
    counter: tuple[tuple[Predicate, str], ...]
    family: str
    strength: str
    summary: str
    factor: str
    effect: str
    human_review: bool
    version: str = "1.1.0"
    effective_from: str = "2026-08-07T00:00:00Z"
    effective_to: str | None = None


@dataclass(frozen=True)
class Contradiction:
    suppressor: str
    suppressed: str
    rationale: str
    unless: tuple[Predicate, ...] = ()


# The 23 facts a rule may read, with their types.
FACT_TYPES = {
    "episode.type": "string",
    "episode.duration_s": "double",
    "episode.missed_reports": "double",
    "policy.state_at_gap": "string",
    "policy.sleep_provenance": "string",
    "policy.weak_basis": "boolean",
    "movement.moving_before_gap": "boolean",
    "power.cut_alert_present": "boolean",
    "power.external_state_before_gap": "string",
    "device.sleep_state_before_gap": "string",
    "device.reboot_after_gap": "boolean",
    "device.sequence_reset": "boolean",
    "device.model_fault_pattern": "boolean",
    "gnss.reports_continued": "boolean",
    "gnss.jamming_alert": "boolean",
    "network.jamming_alert": "boolean",
    "network.independent_devices": "double",
    "network.identity_known": "boolean",
    "source.independent_devices": "double",
    "source.health_incident_active": "boolean",
    "corridor.recurrence_qualified": "boolean",
    "tamper.alert_present": "boolean",
    "maintenance.window_active": "boolean",
}

# Wording that results must carry verbatim.
TAMPER_PHRASE = "device telemetry supports possible tracker interference"
SOURCE_INCIDENT = "a source-wide incident is concurrently active on this platform"
WINDOW_COVERS = "an approved maintenance or installation window covers this gap"

# The ten shipped rules, in evaluation order.
RULES: tuple[Rule, ...] = (
    Rule(
        rule_id="rule.h-expected.policy-match",
        hypothesis="H-EXPECTED",
        required=("episode.type", "policy.state_at_gap", "policy.weak_basis", "policy.sleep_provenance"),
        optional=(
            "power.cut_alert_present", "tamper.alert_present", "maintenance.window_active",
            "episode.missed_reports", "gnss.jamming_alert", "network.jamming_alert",
            "movement.moving_before_gap",
        ),
        positive=(
            ("episode.type", "eq", "total_silence"),
            ("policy.state_at_gap", "in", ["sleep", "parked"]),
            ("policy.weak_basis", "eq", False),
            ("policy.sleep_provenance", "eq", "declared"),
        ),
        negative=(
            ("power.cut_alert_present", "eq", True),
            ("tamper.alert_present", "eq", True),
            ("gnss.jamming_alert", "eq", True),
            ("network.jamming_alert", "eq", True),
        ),
        counter=(
            (("episode.missed_reports", "gte", 10), "the gap has outlasted many expected sleep cycles"),
            (
                ("movement.moving_before_gap", "eq", True),
                "the asset was moving in its last valid observations, at odds with a parked or sleeping state",
            ),
        ),
        family="policy_match",
        strength="corroborated",
        summary="the effective reporting policy predicts silence in this state, from a declared interval",
        factor="expected-state-match",
        effect="lower",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-gnss.position-quality-loss",
        hypothesis="H-GNSS",
        required=("episode.type", "gnss.reports_continued"),
        optional=("maintenance.window_active", "movement.moving_before_gap", "device.sleep_state_before_gap"),
        positive=(
            ("episode.type", "in", ["gnss_only_loss", "stale_position"]),
            ("gnss.reports_continued", "eq", True),
        ),
        negative=(
            ("maintenance.window_active", "eq", True),
            ("device.sleep_state_before_gap", "eq", "deep_sleep"),
        ),
        counter=(
            (
                ("device.sleep_state_before_gap", "eq", "unknown"),
                "the device reported its sleep state as undetermined when the gap opened",
            ),
        ),
        family="device_signal",
        strength="corroborated",
        summary="reports continued on schedule while position quality failed",
        factor="gnss-loss-while-reporting",
        effect="raise",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-gnss.jamming-flag",
        hypothesis="H-GNSS",
        required=("gnss.jamming_alert",),
        optional=("source.health_incident_active",),
        positive=(("gnss.jamming_alert", "eq", True),),
        negative=(),
        counter=((("source.health_incident_active", "eq", True), SOURCE_INCIDENT),),
        family="device_signal",
        strength="direct",
        summary="the device reported a GNSS jamming indication",
        factor="direct-jamming-indication",
        effect="raise",
        human_review=True,
    ),
    Rule(
        rule_id="rule.h-vendor.source-cluster",
        hypothesis="H-VENDOR",
        required=("source.independent_devices",),
        optional=("source.health_incident_active", "episode.type"),
        positive=(("source.independent_devices", "gte", 3),),
        negative=(("episode.type", "in", ["gnss_only_loss", "stale_position"]),),
        counter=(
            (
                ("source.health_incident_active", "eq", False),
                "platform health monitoring reports no active incident over this window",
            ),
        ),
        family="platform_health",
        strength="corroborated",
        summary="independent devices on the same platform show correlated receipt failure",
        factor="peer-incident-explains-gap",
        effect="lower",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-network.operator-cluster",
        hypothesis="H-NETWORK",
        required=("network.independent_devices", "network.identity_known"),
        optional=("source.health_incident_active", "episode.type"),
        positive=(
            ("network.independent_devices", "gte", 3),
            ("network.identity_known", "eq", True),
        ),
        negative=(("episode.type", "in", ["gnss_only_loss", "stale_position"]),),
        counter=(
            (
                ("source.health_incident_active", "eq", True),
                "a platform-wide incident is active and would produce the same correlated silence "
                "without any network involvement",
            ),
        ),
        family="peer_devices",
        strength="corroborated",
        summary="independent devices on the same network identity show correlated silence",
        factor="network-incident-explains-gap",
        effect="lower",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-corridor.recurrence",
        hypothesis="H-CORRIDOR",
        required=("corridor.recurrence_qualified",),
        optional=(),
        positive=(("corridor.recurrence_qualified", "eq", True),),
        negative=(),
        counter=(),
        family="route_history",
        strength="weak",
        summary="this corridor recurs above the fleet base rate, on exposure-adjusted counts",
        factor="corridor-recurrence",
        effect="raise",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-power.external-cut",
        hypothesis="H-POWER",
        required=("power.cut_alert_present",),
        optional=("source.health_incident_active", "movement.moving_before_gap", "maintenance.window_active"),
        positive=(("power.cut_alert_present", "eq", True),),
        negative=(),
        counter=(
            (("source.health_incident_active", "eq", True), SOURCE_INCIDENT),
            (("maintenance.window_active", "eq", True), WINDOW_COVERS),
        ),
        family="device_signal",
        strength="direct",
        summary="the device reported loss of external power before the gap",
        factor="direct-power-evidence",
        effect="raise",
        human_review=True,
    ),
    Rule(
        rule_id="rule.h-device.fault-pattern",
        hypothesis="H-DEVICE",
        required=(),
        optional=(
            "device.reboot_after_gap", "device.sequence_reset", "device.model_fault_pattern",
            "maintenance.window_active", "power.cut_alert_present", "tamper.alert_present",
            "source.health_incident_active",
        ),
        positive=(
            (
                "any_of",
                [
                    ("device.reboot_after_gap", "eq", True),
                    ("device.sequence_reset", "eq", True),
                    ("device.model_fault_pattern", "eq", True),
                ],
            ),
        ),
        negative=(("maintenance.window_active", "eq", True),),
        counter=(
            (
                ("power.cut_alert_present", "eq", True),
                "a power-cut indication accompanies the reboot; the cause may be external power, not the device",
            ),
            (("tamper.alert_present", "eq", True), "a tamper indication accompanies the fault pattern"),
            (
                ("source.health_incident_active", "eq", True),
                "a source-wide incident is concurrently active and can produce sequence artefacts",
            ),
        ),
        family="device_signal",
        strength="weak",
        summary="device fault indicators are present: reboot, sequence reset or a reviewed model pattern",
        factor="device-fault-indicators",
        effect="lower",
        human_review=False,
    ),
    Rule(
        rule_id="rule.h-tamper.direct-signal",
        hypothesis="H-TAMPER",
        required=("tamper.alert_present",),
        optional=("source.health_incident_active", "movement.moving_before_gap", "maintenance.window_active"),
        positive=(("tamper.alert_present", "eq", True),),
        negative=(),
        counter=(
            (("source.health_incident_active", "eq", True), SOURCE_INCIDENT),
            (("maintenance.window_active", "eq", True), WINDOW_COVERS),
        ),
        family="device_signal",
        strength="direct",
        summary=TAMPER_PHRASE,
        factor="direct-tamper-indication",
        effect="raise",
        human_review=True,
    ),
    Rule(
        rule_id="rule.h-tamper.network-jamming",
        hypothesis="H-TAMPER",
        required=("network.jamming_alert",),
        optional=("source.health_incident_active",),
        positive=(("network.jamming_alert", "eq", True),),
        negative=(),
        counter=((("source.health_incident_active", "eq", True), SOURCE_INCIDENT),),
        family="device_signal",
        strength="direct",
        summary=TAMPER_PHRASE,
        factor="direct-network-jamming-indication",
        effect="raise",
        human_review=True,
    ),
)

# Which hypothesis explains another away.
CONTRADICTIONS: tuple[Contradiction, ...] = (
    Contradiction(
        "H-VENDOR",
        "H-TAMPER",
        "a platform-wide receipt failure explains individual silence without interference; "
        "escalating every affected device as suspected interference would flood the queue with "
        "cases the incident already explains",
    ),
    Contradiction(
        "H-NETWORK",
        "H-TAMPER",
        "a correlated network incident explains individual silence without interference",
    ),
)

OUTCOME_TYPE = (
    "struct<code:string,rule_id:string,rule_version:string,kind:string,family:string,"
    "strength:string,summary:string,counterevidence:array<string>,missing:array<string>,"
    "human_review:boolean,factor:string,effect:string>"
)


def fact_field(name: str) -> str:
    return name.replace(".", "_")


def fact(name: str) -> Column:
    if name not in FACT_TYPES:
        raise ValueError(f"{name} is not in the fact vocabulary")
    return F.col(f"facts.{fact_field(name)}")


def _or(flags: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags, F.lit(False))


def compare(name: str, op: str, value: object) -> Column:
    column = fact(name)
    if op == "eq":
        return column == F.lit(value)
    if op == "neq":
        return column != F.lit(value)
    if op == "gte":
        return column >= F.lit(value)
    if op == "lte":
        return column <= F.lit(value)
    if op == "in":
        return column.isin(*value)
    raise ValueError(f"unknown operator {op}")


def holds(predicate: Predicate) -> Column:
    """Rule reading: in a disjunction a readable false beats an unreadable branch."""
    if predicate[0] == "any_of":
        return any_of([holds(p) for p in predicate[1]])
    return compare(*predicate)


def holds_kleene(predicate: Predicate) -> Column:
    """Exception reading (``unless``): an unreadable branch beats false, which is SQL ``OR``."""
    if predicate[0] == "any_of":
        return _or([holds_kleene(p) for p in predicate[1]])
    return compare(*predicate)


def unreadable(predicate: Predicate, reached: Column | None = None) -> list[Column]:
    """Names of facts the predicate tried to read and could not; a true branch ends a disjunction."""
    reached = F.lit(True) if reached is None else reached
    if predicate[0] == "any_of":
        names: list[Column] = []
        for branch in predicate[1]:
            names += unreadable(branch, reached)
            reached = reached & ~F.coalesce(holds(branch), F.lit(False))
        return names
    return [F.when(reached & fact(predicate[0]).isNull(), F.lit(predicate[0]))]


def _names(columns: list[Column]) -> Column:
    if not columns:
        return F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*columns))))


def outcome(rule: Rule) -> Column:
    """Outcome of one rule on the ``facts`` struct of the row."""
    positives = [holds(p) for p in rule.positive]
    any_false = _or([F.coalesce(~p, F.lit(False)) for p in positives])
    any_unknown = _or([p.isNull() for p in positives])
    blocked = _or([F.coalesce(holds(p), F.lit(False)) for p in rule.negative])
    missing_required = F.array_compact(
        F.array(*[F.when(fact(n).isNull(), F.lit(n)) for n in rule.required])
        if rule.required
        else F.array().cast("array<string>")
    )
    undecided = _names(
        [
            F.when(p.isNull(), name)
            for p, source in zip(positives, rule.positive, strict=True)
            for name in unreadable(source)
        ]
    )
    expected = _names(
        [n for p in (*rule.positive, *rule.negative) for n in unreadable(p)]
        + [F.when(fact(n).isNull(), F.lit(n)) for n in rule.optional]
    )
    counter = (
        F.array_compact(
            F.array(*[F.when(holds(when), F.lit(text)) for when, text in rule.counter])
        )
        if rule.counter
        else F.array().cast("array<string>")
    )
    kind = (
        F.when(F.size(missing_required) > 0, F.lit("not_applicable"))
        .when(~any_false & any_unknown, F.lit("not_applicable"))
        .when(any_false | blocked, F.lit("did_not_fire"))
        .otherwise(F.lit("fired"))
    )
    missing = (
        F.when(F.size(missing_required) > 0, missing_required)
        .when(~any_false & any_unknown, undecided)
        .otherwise(expected)
    )
    return F.struct(
        F.lit(rule.hypothesis).alias("code"),
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.version).alias("rule_version"),
        kind.alias("kind"),
        F.lit(rule.family).alias("family"),
        F.lit(rule.strength).alias("strength"),
        F.lit(rule.summary).alias("summary"),
        F.when(kind == "fired", counter).otherwise(F.array().cast("array<string>")).alias("counterevidence"),
        missing.alias("missing"),
        F.lit(rule.human_review).alias("human_review"),
        F.lit(rule.factor).alias("factor"),
        F.lit(rule.effect).alias("effect"),
    )


def _instant_ms(text: str) -> int:
    at = datetime.fromisoformat(text.replace("Z", "+00:00"))
    if at.tzinfo is None:
        at = at.replace(tzinfo=timezone.utc)
    return int(at.timestamp() * 1000)


def effective(rule: Rule, at: Column) -> Column:
    """Half-open effective period of a rule."""
    t = ms(at)
    inside = t >= _instant_ms(rule.effective_from)
    if rule.effective_to is not None:
        inside = inside & (t < _instant_ms(rule.effective_to))
    return inside


def _clashing(rules: Sequence[Rule]) -> list[tuple[Rule, Rule]]:
    clashes = []
    for i, a in enumerate(rules):
        for b in rules[i + 1 :]:
            if a.rule_id != b.rule_id:
                continue
            end_a = _instant_ms(a.effective_to) if a.effective_to else 2**62
            end_b = _instant_ms(b.effective_to) if b.effective_to else 2**62
            if _instant_ms(a.effective_from) < end_b and _instant_ms(b.effective_from) < end_a:
                clashes.append((a, b))
    return clashes


def outcomes(at: Column, rules: Sequence[Rule] = RULES) -> Column:
    """Outcomes of every rule effective at the instant, in rule order.

    Two versions of one rule effective at the same instant fail the row.
    """
    evaluated = F.array_compact(
        F.array(*[F.when(effective(r, at), outcome(r)) for r in rules]).cast(f"array<{OUTCOME_TYPE}>")
    )
    for a, b in _clashing(rules):
        evaluated = F.when(
            effective(a, at) & effective(b, at),
            F.raise_error(F.lit(f"two versions of {a.rule_id} are effective at once")),
        ).otherwise(evaluated)
    return evaluated
