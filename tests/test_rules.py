"""Rules fire, decline or do not apply; suppression and urgency follow the evidence."""

import dataclasses

import pytest
from pyspark.sql import functions as F

from quietwatch.functions.scalars import any_of
from quietwatch.operators import classify, facts, rules
from quietwatch.operators.rules import FACT_TYPES, RULES, fact_field


def now():
    return F.lit("2026-09-01 00:00:00").cast("timestamp")


def facts_frame(spark, cases):
    kinds = ", ".join(f"{fact_field(n)}: {t}" for n, t in FACT_TYPES.items())
    rows = [
        (i, tuple(float(c[n]) if FACT_TYPES[n] == "double" and n in c else c.get(n) for n in FACT_TYPES))
        for i, c in enumerate(cases)
    ]
    return spark.createDataFrame(rows, f"episode_id int, facts struct<{kinds}>")


PARKED = {
    "episode.type": "total_silence",
    "policy.state_at_gap": "parked",
    "policy.weak_basis": False,
    "policy.sleep_provenance": "declared",
}
CASES = [
    ("rule.h-expected.policy-match", PARKED, "fired"),
    ("rule.h-expected.policy-match", {**PARKED, "network.jamming_alert": True}, "did_not_fire"),
    ("rule.h-expected.policy-match", {**PARKED, "policy.sleep_provenance": "assumed"}, "did_not_fire"),
    ("rule.h-expected.policy-match", {"episode.type": "total_silence"}, "not_applicable"),
    ("rule.h-gnss.position-quality-loss", {"episode.type": "stale_position", "gnss.reports_continued": True}, "fired"),
    (
        "rule.h-gnss.position-quality-loss",
        {"episode.type": "gnss_only_loss", "gnss.reports_continued": True, "device.sleep_state_before_gap": "deep_sleep"},
        "did_not_fire",
    ),
    ("rule.h-gnss.jamming-flag", {"gnss.jamming_alert": True}, "fired"),
    ("rule.h-gnss.jamming-flag", {}, "not_applicable"),
    ("rule.h-vendor.source-cluster", {"source.independent_devices": 3}, "fired"),
    ("rule.h-vendor.source-cluster", {"source.independent_devices": 2}, "did_not_fire"),
    ("rule.h-network.operator-cluster", {"network.independent_devices": 4, "network.identity_known": True}, "fired"),
    ("rule.h-network.operator-cluster", {"network.identity_known": False}, "not_applicable"),
    ("rule.h-corridor.recurrence", {"corridor.recurrence_qualified": False}, "did_not_fire"),
    ("rule.h-power.external-cut", {"power.cut_alert_present": True, "maintenance.window_active": True}, "fired"),
    ("rule.h-device.fault-pattern", {"device.model_fault_pattern": True}, "fired"),
    ("rule.h-device.fault-pattern", {"device.reboot_after_gap": False, "device.sequence_reset": False}, "did_not_fire"),
    ("rule.h-device.fault-pattern", {}, "not_applicable"),
    ("rule.h-tamper.direct-signal", {"tamper.alert_present": True}, "fired"),
    ("rule.h-tamper.network-jamming", {"network.jamming_alert": False}, "did_not_fire"),
]


def test_each_rule_on_its_cases(spark):
    frame = facts_frame(spark, [c for _, c, _ in CASES])
    found = {(r.episode_id, r.rule_id): r.kind for r in classify.rule_outcomes(frame, now()).collect()}
    assert [found[(i, rule)] for i, (rule, _, _) in enumerate(CASES)] == [kind for _, _, kind in CASES]


def test_rules_are_not_in_force_before_their_date(spark):
    early = classify.classify(facts_frame(spark, [PARKED]), F.lit("2026-08-05 00:00:00").cast("timestamp"))
    assert early.first().hypotheses == []


def test_two_effective_versions_fail(spark):
    twin = dataclasses.replace(RULES[0], version="1.2.0")
    with pytest.raises(Exception, match="effective at once"):
        classify.classify(facts_frame(spark, [PARKED]), now(), [*RULES, twin]).collect()


def test_a_readable_false_beats_an_unreadable_branch(spark):
    flags = spark.createDataFrame(
        [(False, None), (None, None), (True, None), (False, False)], "a boolean, b boolean"
    )
    rows = flags.select(any_of([F.col("a"), F.col("b")]), F.col("a") | F.col("b")).collect()
    assert [r[0] for r in rows] == [False, None, True, False]
    assert [r[1] for r in rows] == [None, None, True, False]


def test_direct_evidence_is_never_suppressed_and_weak_is(spark):
    weak = dataclasses.replace(RULES[8], rule_id="rule.weak", strength="corroborated")
    case = {"source.independent_devices": 5, "source.health_incident_active": True, "tamper.alert_present": True}
    row = classify.classify(facts_frame(spark, [case]), now(), [*RULES, weak]).first()
    by_rule = {h.rule_id: h for h in row.hypotheses}
    direct = by_rule["rule.h-tamper.direct-signal"]
    assert (direct.band, direct.suppressed_by) == ("direct", None)
    assert any("preserved" in note for note in direct.counterevidence)
    assert (by_rule["rule.weak"].band, by_rule["rule.weak"].suppressed_by) == ("weak", "H-VENDOR")
    assert row.urgent_eligible
    assert {f.from_rule: f.effect for f in row.priority_factors}["rule.weak"] == "none"


def test_an_unreadable_exception_withholds_suppression(spark):
    weak = dataclasses.replace(RULES[8], rule_id="rule.weak", strength="weak")
    clash = rules.Contradiction("H-VENDOR", "H-TAMPER", "why", (("corridor.recurrence_qualified", "eq", True),))
    case = {"source.independent_devices": 5, "tamper.alert_present": True}
    row = classify.classify(facts_frame(spark, [case]), now(), [RULES[3], weak], [clash]).first()
    entry = [h for h in row.hypotheses if h.rule_id == "rule.weak"][0]
    assert entry.suppressed_by is None
    assert "withheld" in entry.counterevidence[-1]


def test_benign_explanations_never_add_up_to_urgency(spark):
    case = {**PARKED, "source.independent_devices": 5, "source.health_incident_active": True}
    row = classify.classify(facts_frame(spark, [case]), now()).first()
    assert len(row.hypotheses) == 2 and not row.urgent_eligible


def test_unknown_lists_what_was_missing(spark):
    row = classify.classify(facts_frame(spark, [{}]), now()).first()
    assert row.unknown.code == "H-UNKNOWN"
    assert "gnss.jamming_alert" in row.unknown.missing_expected


def test_deep_sleep_makes_jamming_unavailable(spark):
    frame = spark.createDataFrame(
        [(1, ("x", "present", "deep_sleep"), (True, False, False, True), ["alerts.power_cut"])],
        "episode_id int, o struct<a:string,b:string,c:string>, s struct<power_cut:boolean,tamper:boolean,"
        "gnss_jamming:boolean,network_jamming:boolean>, capabilities array<string>",
    ).select(
        "episode_id",
        F.struct(
            F.lit(None).cast("boolean").alias("moving"),
            F.col("o.b").alias("external_power_state"),
            F.col("o.c").alias("sleep_state"),
        ).alias("observations"),
        F.col("s").alias("alerts_seen"),
        "capabilities",
    )
    row = facts.derive_facts(frame, ["episode_id"]).first()
    assert row.facts.power_cut_alert_present is True
    assert row.facts.gnss_jamming_alert is None and row.facts.tamper_alert_present is None
    assert row.unavailable["gnss.jamming_alert"] == facts.ASLEEP
    assert row.unavailable["tamper.alert_present"] == facts.NO_TAMPER
    assert row.unavailable["device.reboot_after_gap"] == facts.NOT_RESUMED
