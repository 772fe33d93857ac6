"""Queries from episodes to evidence: peers, facts, rules, classification, queue."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwatch.catalog.telemetry_queries import WINDOWS_SQL, region_windows
from quietwatch.catalog.views import EPISODES_SQL, POLICY, TELEMETRY_SQL, shared, telemetry
from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators import classify, decisions, episodes, facts, listing, peers, queue, redact, rules, sla
from quietwatch.plans import evidence

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, view: str = EPISODES_SQL):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {view.strip()}\n{sql.strip()}"
        return function

    return register


WINDOW_S = 1800
# All shipped rules are in force at this instant.
CLASSIFY_MS = 1_788_220_800_000
NOW_MS = 1_706_659_200_000

CANDIDATES_SQL = EPISODES_SQL + """, placed AS (
  SELECT device_ref, asset_ref, source, '639-' || lpad(CAST(mnc AS VARCHAR), 2, '0') AS network_identity,
    'cell_' || cell_id AS cell FROM (SELECT *, row_number() OVER (PARTITION BY device_ref
      ORDER BY received_ms DESC, arrival DESC) AS n FROM telemetry) WHERE n = 1
), candidates AS (
  SELECT e.episode_id, e.device_ref, e.start_ms, p.asset_ref, p.source, p.network_identity, p.cell
  FROM episodes e JOIN placed p USING (device_ref)
), members AS (
  SELECT * FROM (SELECT episode_id, device_ref, asset_ref, start_ms,
    unnest([{'d': 'source', 'k': source}, {'d': 'sim_provider', 'k': network_identity},
      {'d': 'network', 'k': network_identity}, {'d': 'area', 'k': cell}]) AS dk FROM candidates)
  WHERE dk.k IS NOT NULL
), starts AS (SELECT DISTINCT dk.d AS dimension, dk.k AS key, start_ms FROM members
), hops AS (
  SELECT dimension, key, start_ms, min(start_ms) OVER (PARTITION BY dimension, key ORDER BY start_ms
    RANGE BETWEEN 1800001 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_ms FROM starts
), anchors AS (
  SELECT dimension, key, min(start_ms) AS anchor FROM starts GROUP BY dimension, key
  UNION ALL
  SELECT a.dimension, a.key, h.next_ms FROM anchors a JOIN hops h
    ON h.dimension = a.dimension AND h.key = a.key AND h.start_ms = a.anchor WHERE h.next_ms IS NOT NULL
), assigned AS (
  SELECT m.episode_id, m.device_ref, m.asset_ref, m.start_ms, m.dk.d AS dimension, m.dk.k AS key, a.anchor
  FROM members m ASOF JOIN anchors a ON a.dimension = m.dk.d AND a.key = m.dk.k AND a.anchor <= m.start_ms
), cluster_devices AS (
  SELECT dimension, key, anchor, device_ref, count(*) AS copies, max(start_ms) AS last_ms,
    coalesce(min(asset_ref), device_ref) AS witness FROM assigned GROUP BY dimension, key, anchor, device_ref
), witnesses AS (
  SELECT dimension, key, anchor, witness, min(device_ref) AS counted_as, count(*) AS devices,
    sum(copies) AS members, max(last_ms) AS last_ms FROM cluster_devices GROUP BY dimension, key, anchor, witness
), clusters AS (
  SELECT dimension, key, anchor, max(last_ms) AS window_end_ms, CAST(sum(members) AS BIGINT) AS member_rows,
    CAST(sum(devices) AS BIGINT) AS member_devices, count(*) AS independent_count
  FROM witnesses GROUP BY dimension, key, anchor
)"""


def samples(spark, sf_dir):
    return shared(
        spark,
        sf_dir,
        "samples",
        lambda: episodes.with_episode_id(episodes.sample_episodes(telemetry(spark, sf_dir), POLICY)),
    )


def _assigned(spark, sf_dir):
    candidates = shared(
        spark,
        sf_dir,
        "candidates",
        lambda: evidence.candidates_for(samples(spark, sf_dir), telemetry(spark, sf_dir)),
    )
    assigned = shared(
        spark,
        sf_dir,
        "assigned",
        lambda: peers.assign_clusters(peers.dimension_keys(candidates), WINDOW_S),
    )
    return candidates, assigned


@query(
    "peer_dimension_keys",
    "SELECT dk.d AS dimension, dk.k AS key, count(*) AS candidates FROM members GROUP BY ALL",
    CANDIDATES_SQL,
)
def peer_dimension_keys(spark, sf_dir):
    keyed = peers.dimension_keys(_assigned(spark, sf_dir)[0])
    return keyed.groupBy("dimension", "key").agg(F.count(F.lit(1)).alias("candidates"))


@query(
    "cluster_assignment",
    "SELECT dimension, key, episode_id, anchor AS cluster_start_ms FROM assigned",
    CANDIDATES_SQL,
)
def cluster_assignment(spark, sf_dir):
    return _assigned(spark, sf_dir)[1].select("dimension", "key", "episode_id", "cluster_start_ms")


POPULATION_SQL = """, population AS (SELECT 'source' AS dimension, source AS key,
  count(DISTINCT device_ref) AS active_population FROM telemetry GROUP BY source)"""


@query(
    "peer_clusters",
    """SELECT dimension, key, anchor AS cluster_start_ms, window_end_ms, member_rows, member_devices, independent_count,
    member_rows - member_devices AS duplicate_devices, member_devices - independent_count AS shared_assets,
    independent_count >= 3 AS meets_minimum, active_population,
    independent_count / active_population AS affected_fraction
    FROM clusters LEFT JOIN population USING (dimension, key)""",
    CANDIDATES_SQL + POPULATION_SQL,
)
def peer_clusters(spark, sf_dir):
    population = (
        telemetry(spark, sf_dir)
        .groupBy(F.lit("source").alias("dimension"), F.col("source").alias("key"))
        .agg(F.count_distinct("device_ref").alias("active_population"))
    )
    return peers.clusters(_assigned(spark, sf_dir)[1], population=population).drop("tenant_id")


@query(
    "cluster_exclusions",
    """SELECT dimension, key, anchor AS cluster_start_ms, device_ref, 'duplicate_device' AS reason, device_ref AS counted_as
    FROM cluster_devices, range(1, copies) WHERE copies > 1
    UNION ALL
    SELECT d.dimension, d.key, d.anchor, d.device_ref, 'shares_asset', w.counted_as FROM cluster_devices d
    JOIN witnesses w USING (dimension, key, anchor, witness) WHERE d.device_ref <> w.counted_as""",
    CANDIDATES_SQL,
)
def cluster_exclusions(spark, sf_dir):
    return peers.exclusions(_assigned(spark, sf_dir)[1]).drop("tenant_id")


PEERS_SQL = CANDIDATES_SQL + """, peer_facts AS (
  SELECT c.episode_id, coalesce(max(k.independent_count) FILTER (a.dimension = 'source'), 0) AS source_devices,
    CASE WHEN max(c.network_identity) IS NOT NULL THEN
      coalesce(max(k.independent_count) FILTER (a.dimension = 'network'), 0) END AS network_devices,
    max(c.network_identity) IS NOT NULL AS identity_known,
    coalesce(bool_or(a.dimension = 'source' AND k.independent_count >= 3), false) AS incident
  FROM candidates c JOIN assigned a USING (episode_id) JOIN clusters k
    ON k.dimension = a.dimension AND k.key = a.key AND k.anchor = a.anchor
  GROUP BY c.episode_id
)"""


@query("peer_facts", "SELECT * FROM peer_facts", PEERS_SQL)
def peer_facts(spark, sf_dir):
    candidates, assigned = _assigned(spark, sf_dir)
    found = peers.peer_facts(candidates, assigned, peers.clusters(assigned))
    return found.select(
        "episode_id",
        F.col("peers.source_independent_devices").alias("source_devices"),
        F.col("peers.network_independent_devices").alias("network_devices"),
        F.col("peers.network_identity_known").alias("identity_known"),
        F.col("peers.source_health_incident").alias("incident"),
    )


DEVICE_SQL = """device_evidence AS (
  SELECT device_ref,
    arg_max(motion_state, (received_ms, arrival)) FILTER (motion_state IS NOT NULL) = 'moving' AS moving,
    arg_max(external_state, (received_ms, arrival)) FILTER (external_state IS NOT NULL) AS external_power_state,
    CASE WHEN bool_or(sleep_state = 'deep_sleep') THEN 'deep_sleep'
      ELSE arg_max(sleep_state, (received_ms, arrival)) FILTER (sleep_state IS NOT NULL) END AS last_sleep_state,
    bool_or(power_cut) AS power_cut, bool_or(tamper) AS tamper,
    CASE WHEN bool_or(gnss_jamming) THEN true END AS gnss_jamming,
    CASE WHEN bool_or(network_jamming) THEN true END AS network_jamming,
    bool_or(reboot_reason IS NOT NULL) AS reboot_reported
  FROM telemetry GROUP BY device_ref
)"""


@query("device_evidence", "SELECT * FROM device_evidence", TELEMETRY_SQL + ", " + DEVICE_SQL)
def device_evidence(spark, sf_dir):
    found = facts.device_evidence(telemetry(spark, sf_dir))
    return found.select(
        "device_ref",
        "observations.moving",
        "observations.external_power_state",
        F.col("observations.sleep_state").alias("last_sleep_state"),
        "alerts_seen.power_cut",
        "alerts_seen.tamper",
        "alerts_seen.gnss_jamming",
        "alerts_seen.network_jamming",
        "recovery.reboot_reported",
    )


# The fact table of every episode: NULL is unavailable.
FACTS_SQL = PEERS_SQL + WINDOWS_SQL + ", " + DEVICE_SQL + """, gap_state AS (
  SELECT e.episode_id, p.p_state FROM episodes e JOIN (SELECT DISTINCT device_ref, before_ms, at_ms, p_state FROM pairs) p
    ON p.device_ref = e.device_ref AND p.before_ms = e.start_ms AND p.at_ms = e.end_ms
), facts AS (
  SELECT e.episode_id, e.device_ref, e.start_ms, e.end_ms, e.clock_basis, e.type AS episode_type, e.duration_s AS episode_duration_s,
    CAST(e.missed_reports AS DOUBLE) AS episode_missed_reports, g.p_state AS policy_state_at_gap,
    'declared' AS policy_sleep_provenance, e.weak_basis AS policy_weak_basis, d.moving AS movement_moving_before_gap,
    d.power_cut AS power_cut_alert_present, d.external_power_state AS power_external_state_before_gap,
    d.last_sleep_state AS device_sleep_state_before_gap, d.reboot_reported AS device_reboot_after_gap,
    false AS device_sequence_reset, CAST(NULL AS BOOLEAN) AS device_model_fault_pattern,
    e.type IN ('gnss_only_loss', 'stale_position') AS gnss_reports_continued,
    CASE WHEN coalesce(d.last_sleep_state = 'deep_sleep', false) THEN NULL ELSE d.gnss_jamming END AS gnss_jamming_alert,
    CASE WHEN coalesce(d.last_sleep_state = 'deep_sleep', false) THEN NULL ELSE d.network_jamming END AS network_jamming_alert,
    CAST(p.network_devices AS DOUBLE) AS network_independent_devices, p.identity_known AS network_identity_known,
    CAST(p.source_devices AS DOUBLE) AS source_independent_devices, p.incident AS source_health_incident_active,
    CAST(NULL AS BOOLEAN) AS corridor_recurrence_qualified, d.tamper AS tamper_alert_present,
    EXISTS (SELECT 1 FROM windows w WHERE e.start_ms >= w.from_ms AND e.start_ms < w.to_ms) AS maintenance_window_active
  FROM episodes e JOIN gap_state g USING (episode_id) JOIN device_evidence d USING (device_ref)
    JOIN peer_facts p USING (episode_id)
)"""


def _facts(spark, sf_dir):
    def build():
        candidates, assigned = _assigned(spark, sf_dir)
        peer_rows = peers.peer_facts(candidates, assigned, peers.clusters(assigned))
        return evidence.episode_facts(
            samples(spark, sf_dir),
            telemetry(spark, sf_dir),
            POLICY,
            peer_rows,
            region_windows(spark, sf_dir),
        )

    return shared(spark, sf_dir, "facts", build)


@query(
    "episode_facts",
    "SELECT * EXCLUDE (device_ref, start_ms, end_ms, clock_basis) FROM facts",
    FACTS_SQL,
)
def episode_facts(spark, sf_dir):
    return _facts(spark, sf_dir).select("episode_id", "facts.*")


@query(
    "unavailable_facts",
    """SELECT u.f AS fact, u.r AS reason, count(*) AS episodes FROM (SELECT unnest([
      CASE WHEN device_model_fault_pattern IS NULL THEN {'f': 'device.model_fault_pattern',
        'r': 'no reviewed fault-pattern analysis for this model'} END,
      CASE WHEN gnss_jamming_alert IS NULL THEN {'f': 'gnss.jamming_alert', 'r': CASE WHEN device_sleep_state_before_gap = 'deep_sleep'
        THEN 'jamming detectors are disabled in deep sleep' ELSE 'device does not report GNSS jamming' END} END,
      CASE WHEN network_jamming_alert IS NULL THEN {'f': 'network.jamming_alert', 'r': CASE WHEN device_sleep_state_before_gap = 'deep_sleep'
        THEN 'jamming detectors are disabled in deep sleep' ELSE 'device does not report network jamming' END} END,
      CASE WHEN network_independent_devices IS NULL THEN {'f': 'network.independent_devices',
        'r': 'serving network identity was not observed before the gap'} END,
      {'f': 'corridor.recurrence_qualified', 'r': 'corridor baseline has not been evaluated'},
      CASE WHEN movement_moving_before_gap IS NULL THEN {'f': 'movement.moving_before_gap', 'r': 'not supplied to fact derivation'} END,
      CASE WHEN power_external_state_before_gap IS NULL THEN {'f': 'power.external_state_before_gap', 'r': 'not supplied to fact derivation'} END,
      CASE WHEN device_sleep_state_before_gap IS NULL THEN {'f': 'device.sleep_state_before_gap', 'r': 'not supplied to fact derivation'} END
    ]) AS u FROM facts) WHERE u IS NOT NULL GROUP BY ALL""",
    FACTS_SQL,
)
def unavailable_facts(spark, sf_dir):
    return (
        _facts(spark, sf_dir)
        .select(F.explode("unavailable").alias("fact", "reason"))
        .groupBy("fact", "reason")
        .agg(F.count(F.lit(1)).alias("episodes"))
    )


# Each shipped rule as kind, band strength, review flag and counterevidence count.
OUTCOMES_SQL = FACTS_SQL + """, outcomes AS (
  SELECT f.*, unnest([
    {'n': 1, 'code': 'H-EXPECTED', 'rule': 'rule.h-expected.policy-match', 'family': 'policy_match', 'strength': 'corroborated',
     'factor': 'expected-state-match', 'effect': 'lower', 'review': false,
     'kind': CASE WHEN episode_type IS NULL OR policy_state_at_gap IS NULL OR policy_weak_basis IS NULL OR policy_sleep_provenance IS NULL
        THEN 'not_applicable'
      WHEN episode_type = 'total_silence' AND policy_state_at_gap IN ('sleep', 'parked') AND NOT policy_weak_basis
        AND policy_sleep_provenance = 'declared' AND NOT (coalesce(power_cut_alert_present, false) OR coalesce(tamper_alert_present, false)
          OR coalesce(gnss_jamming_alert, false) OR coalesce(network_jamming_alert, false)) THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(episode_missed_reports >= 10, false)::INT + coalesce(movement_moving_before_gap, false)::INT,
     'missing': (power_cut_alert_present IS NULL)::INT + (tamper_alert_present IS NULL)::INT + (maintenance_window_active IS NULL)::INT
       + (episode_missed_reports IS NULL)::INT + (gnss_jamming_alert IS NULL)::INT + (network_jamming_alert IS NULL)::INT
       + (movement_moving_before_gap IS NULL)::INT},
    {'n': 2, 'code': 'H-GNSS', 'rule': 'rule.h-gnss.position-quality-loss', 'family': 'device_signal', 'strength': 'corroborated',
     'factor': 'gnss-loss-while-reporting', 'effect': 'raise', 'review': false,
     'kind': CASE WHEN episode_type IS NULL OR gnss_reports_continued IS NULL THEN 'not_applicable'
      WHEN episode_type IN ('gnss_only_loss', 'stale_position') AND gnss_reports_continued AND NOT coalesce(maintenance_window_active, false)
        AND NOT coalesce(device_sleep_state_before_gap = 'deep_sleep', false) THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(device_sleep_state_before_gap = 'unknown', false)::INT,
     'missing': (maintenance_window_active IS NULL)::INT + (movement_moving_before_gap IS NULL)::INT + (device_sleep_state_before_gap IS NULL)::INT},
    {'n': 3, 'code': 'H-GNSS', 'rule': 'rule.h-gnss.jamming-flag', 'family': 'device_signal', 'strength': 'direct',
     'factor': 'direct-jamming-indication', 'effect': 'raise', 'review': true,
     'kind': CASE WHEN gnss_jamming_alert IS NULL THEN 'not_applicable' WHEN gnss_jamming_alert THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(source_health_incident_active, false)::INT,
     'missing': CASE WHEN gnss_jamming_alert IS NULL THEN 1 ELSE (source_health_incident_active IS NULL)::INT END},
    {'n': 4, 'code': 'H-VENDOR', 'rule': 'rule.h-vendor.source-cluster', 'family': 'platform_health', 'strength': 'corroborated',
     'factor': 'peer-incident-explains-gap', 'effect': 'lower', 'review': false,
     'kind': CASE WHEN source_independent_devices IS NULL THEN 'not_applicable' WHEN source_independent_devices >= 3
        AND NOT coalesce(episode_type IN ('gnss_only_loss', 'stale_position'), false) THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(NOT source_health_incident_active, false)::INT, 'missing': (source_health_incident_active IS NULL)::INT + (episode_type IS NULL)::INT},
    {'n': 5, 'code': 'H-NETWORK', 'rule': 'rule.h-network.operator-cluster', 'family': 'peer_devices', 'strength': 'corroborated',
     'factor': 'network-incident-explains-gap', 'effect': 'lower', 'review': false,
     'kind': CASE WHEN network_independent_devices IS NULL OR network_identity_known IS NULL THEN 'not_applicable'
       WHEN network_independent_devices >= 3 AND network_identity_known
        AND NOT coalesce(episode_type IN ('gnss_only_loss', 'stale_position'), false) THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(source_health_incident_active, false)::INT,
     'missing': CASE WHEN network_independent_devices IS NULL THEN 1 + (network_identity_known IS NULL)::INT
       ELSE (source_health_incident_active IS NULL)::INT + (episode_type IS NULL)::INT END},
    {'n': 6, 'code': 'H-CORRIDOR', 'rule': 'rule.h-corridor.recurrence', 'family': 'route_history', 'strength': 'weak',
     'factor': 'corridor-recurrence', 'effect': 'raise', 'review': false,
     'kind': CASE WHEN corridor_recurrence_qualified IS NULL THEN 'not_applicable' WHEN corridor_recurrence_qualified THEN 'fired'
       ELSE 'did_not_fire' END, 'counter': 0, 'missing': (corridor_recurrence_qualified IS NULL)::INT},
    {'n': 7, 'code': 'H-POWER', 'rule': 'rule.h-power.external-cut', 'family': 'device_signal', 'strength': 'direct',
     'factor': 'direct-power-evidence', 'effect': 'raise', 'review': true,
     'kind': CASE WHEN power_cut_alert_present IS NULL THEN 'not_applicable' WHEN power_cut_alert_present THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(source_health_incident_active, false)::INT + coalesce(maintenance_window_active, false)::INT,
     'missing': CASE WHEN power_cut_alert_present IS NULL THEN 1 ELSE (source_health_incident_active IS NULL)::INT
       + (movement_moving_before_gap IS NULL)::INT + (maintenance_window_active IS NULL)::INT END},
    {'n': 8, 'code': 'H-DEVICE', 'rule': 'rule.h-device.fault-pattern', 'family': 'device_signal', 'strength': 'weak',
     'factor': 'device-fault-indicators', 'effect': 'lower', 'review': false,
     'kind': CASE WHEN (coalesce(device_reboot_after_gap, false) OR coalesce(device_sequence_reset, false)
          OR coalesce(device_model_fault_pattern, false)) AND NOT coalesce(maintenance_window_active, false) THEN 'fired'
       WHEN device_reboot_after_gap IS NULL AND device_sequence_reset IS NULL AND device_model_fault_pattern IS NULL
         THEN 'not_applicable' ELSE 'did_not_fire' END,
     'counter': coalesce(power_cut_alert_present, false)::INT + coalesce(tamper_alert_present, false)::INT
       + coalesce(source_health_incident_active, false)::INT,
     'missing': (device_reboot_after_gap IS NULL)::INT + (device_sequence_reset IS NULL)::INT + (device_model_fault_pattern IS NULL)::INT
       + (maintenance_window_active IS NULL)::INT + (power_cut_alert_present IS NULL)::INT + (tamper_alert_present IS NULL)::INT
       + (source_health_incident_active IS NULL)::INT},
    {'n': 9, 'code': 'H-TAMPER', 'rule': 'rule.h-tamper.direct-signal', 'family': 'device_signal', 'strength': 'direct',
     'factor': 'direct-tamper-indication', 'effect': 'raise', 'review': true,
     'kind': CASE WHEN tamper_alert_present IS NULL THEN 'not_applicable' WHEN tamper_alert_present THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(source_health_incident_active, false)::INT + coalesce(maintenance_window_active, false)::INT,
     'missing': CASE WHEN tamper_alert_present IS NULL THEN 1 ELSE (source_health_incident_active IS NULL)::INT
       + (movement_moving_before_gap IS NULL)::INT + (maintenance_window_active IS NULL)::INT END},
    {'n': 10, 'code': 'H-TAMPER', 'rule': 'rule.h-tamper.network-jamming', 'family': 'device_signal', 'strength': 'direct',
     'factor': 'direct-network-jamming-indication', 'effect': 'raise', 'review': true,
     'kind': CASE WHEN network_jamming_alert IS NULL THEN 'not_applicable' WHEN network_jamming_alert THEN 'fired' ELSE 'did_not_fire' END,
     'counter': coalesce(source_health_incident_active, false)::INT,
     'missing': CASE WHEN network_jamming_alert IS NULL THEN 1 ELSE (source_health_incident_active IS NULL)::INT END}
  ]) AS o FROM facts f
), fired AS (
  SELECT *, max(o.code = 'H-VENDOR' AND o.kind = 'fired') OVER w AS vendor, max(o.code = 'H-NETWORK' AND o.kind = 'fired') OVER w AS network
  FROM (SELECT * FROM outcomes WHERE o.kind = 'fired') WINDOW w AS (PARTITION BY episode_id)
), hypotheses AS (
  SELECT episode_id, device_ref, start_ms, end_ms, clock_basis, o.n AS n, o.code AS code, o.rule AS rule_id, o.family AS family, o.effect AS effect,
    o.factor AS factor, o.review AS review, o.missing AS missing,
    CASE WHEN o.code = 'H-TAMPER' AND o.strength <> 'direct' THEN CASE WHEN network THEN 'H-NETWORK' WHEN vendor THEN 'H-VENDOR' END END
      AS suppressed_by,
    o.counter + CASE WHEN o.code = 'H-TAMPER' THEN vendor::INT + network::INT ELSE 0 END AS counters,
    CASE WHEN o.strength = 'corroborated' AND o.counter > 0 THEN 'weak' ELSE o.strength END AS band
  FROM fired
)"""


@query(
    "rule_outcomes",
    "SELECT o.rule AS rule_id, o.kind AS kind, count(*) AS episodes, CAST(sum(o.missing) AS BIGINT) AS missing FROM outcomes GROUP BY ALL",
    OUTCOMES_SQL,
)
def rule_outcomes(spark, sf_dir):
    found = classify.rule_outcomes(_facts(spark, sf_dir), from_ms(F.lit(CLASSIFY_MS)))
    return found.groupBy("rule_id", "kind").agg(
        F.count(F.lit(1)).alias("episodes"), F.sum(F.size("missing")).alias("missing")
    )


def _classified(spark, sf_dir):
    return shared(
        spark,
        sf_dir,
        "classified",
        lambda: classify.classify(_facts(spark, sf_dir), from_ms(F.lit(CLASSIFY_MS))),
    )


@query(
    "classified_hypotheses",
    "SELECT episode_id, code, rule_id, band, suppressed_by, counters, missing FROM hypotheses",
    OUTCOMES_SQL,
)
def classified_hypotheses(spark, sf_dir):
    return (
        _classified(spark, sf_dir)
        .select("episode_id", F.inline("hypotheses"))
        .select(
            "episode_id",
            "code",
            "rule_id",
            "band",
            "suppressed_by",
            F.size("counterevidence").alias("counters"),
            F.size("missing_expected").alias("missing"),
        )
    )


SUMMARY_SQL = OUTCOMES_SQL + """, summary AS (
  SELECT f.episode_id, f.start_ms, f.end_ms, f.device_ref, f.clock_basis,
    coalesce(string_agg(h.code, ',' ORDER BY h.code) FILTER (h.code IS NOT NULL), '') AS fired,
    count(h.code) = 0 AS is_unknown,
    coalesce(bool_or(h.effect = 'raise' AND h.suppressed_by IS NULL AND h.band = 'direct')
      OR count(DISTINCT h.family) FILTER (h.effect = 'raise' AND h.suppressed_by IS NULL AND h.band = 'corroborated') >= 2, false)
      AS urgent_eligible,
    coalesce(string_agg(replace(h.factor, '_', ' '), ', ' ORDER BY h.n) FILTER (h.effect = 'raise' AND h.suppressed_by IS NULL), '') AS raising,
    count(h.factor) AS factor_count,
    CASE coalesce(max(CASE h.band WHEN 'direct' THEN 3 WHEN 'corroborated' THEN 2 WHEN 'weak' THEN 1 END)
      FILTER (h.suppressed_by IS NULL), 0) WHEN 3 THEN 'direct' WHEN 2 THEN 'corroborated' WHEN 1 THEN 'weak' END AS band,
    coalesce(bool_or(h.review), false) AS needs_review
  FROM facts f LEFT JOIN hypotheses h USING (episode_id) GROUP BY ALL
)"""


@query(
    "classification_summary",
    "SELECT episode_id, fired, is_unknown, urgent_eligible FROM summary",
    SUMMARY_SQL,
)
def classification_summary(spark, sf_dir):
    return classify.summarise(_classified(spark, sf_dir), "episode_id").select(
        "episode_id", F.array_join("fired", ",").alias("fired"), "is_unknown", "urgent_eligible"
    )


@query(
    "classification_changes",
    """SELECT s.episode_id, 'changed' AS kind FROM summary s WHERE EXISTS (SELECT 1 FROM hypotheses h
      WHERE h.episode_id = s.episode_id AND h.rule_id = 'rule.h-device.fault-pattern')""",
    SUMMARY_SQL,
)
def classification_changes(spark, sf_dir):
    """What withdrawing one rule would change, over every episode."""
    derived = _facts(spark, sf_dir)
    at = from_ms(F.lit(CLASSIFY_MS))
    fewer = [r for r in rules.RULES if r.rule_id != "rule.h-device.fault-pattern"]
    before = classify.summarise(classify.classify(derived, at), "episode_id")
    after = classify.summarise(classify.classify(derived, at, fewer), "episode_id")
    return classify.diff_summaries(before, after, "episode_id").select("episode_id", "kind")


@query(
    "actionability",
    """SELECT actionable, reason, count(*) AS episodes FROM (SELECT episode_id,
        coalesce(bool_or(band = 'direct'), false) OR families >= 2 AS actionable,
        CASE WHEN coalesce(bool_or(band = 'direct'), false) THEN 'direct evidence from device_signal'
          WHEN families >= 2 THEN 'corroborated across ' || families || ' independent evidence families'
          ELSE 'no direct or independently corroborated evidence' END AS reason
      FROM (SELECT f.episode_id, h.band, count(DISTINCT h.family) FILTER (h.band = 'corroborated') OVER (PARTITION BY f.episode_id) AS families
        FROM facts f LEFT JOIN hypotheses h USING (episode_id)) GROUP BY episode_id, families) GROUP BY ALL""",
    OUTCOMES_SQL,
)
def actionability(spark, sf_dir):
    explained = _classified(spark, sf_dir).withColumn("e", classify.explain_actionability(F.col("hypotheses")))
    return explained.groupBy("e.actionable", "e.reason").agg(F.count(F.lit(1)).alias("episodes"))


QUEUE_SQL = SUMMARY_SQL + f""", queued AS (
  SELECT s.*, p.source, p.asset_ref, CASE WHEN NOT is_unknown THEN 'review_required' ELSE 'awaiting_data' END AS bucket,
    greatest(0, CAST(floor(({NOW_MS} - start_ms) / 1000.0::DOUBLE + 0.5) AS BIGINT)) AS age_s
  FROM summary s JOIN placed p USING (device_ref)
), tiered AS (
  SELECT *, CASE WHEN urgent_eligible THEN 'urgent' WHEN raising <> '' OR age_s > 86400 THEN 'elevated' ELSE 'routine' END AS tier,
    concat_ws(', ', nullif(raising, ''), CASE WHEN urgent_eligible THEN 'urgent eligible evidence' END,
      CASE WHEN age_s > 86400 THEN 'episode age exceeds routine window' END) AS raised,
    factor_count + urgent_eligible::INT + is_unknown::INT + (age_s > 86400)::INT AS factors FROM queued
), items AS (
  SELECT *, start_ms + CASE tier WHEN 'urgent' THEN 7200000 WHEN 'elevated' THEN 28800000 ELSE 86400000 END AS due_ms,
    CASE WHEN raised <> '' THEN tier || ': ' || raised ELSE
      'routine: no factor increased the priority (the system examined ' || factors || ' factors)' END AS reason
  FROM tiered
), due AS (
  SELECT *, CASE WHEN {NOW_MS} <= due_ms THEN 'not_due' WHEN {NOW_MS} - due_ms > 3600000 THEN 'overdue' ELSE 'due' END AS due_state
  FROM items
)"""


def _items(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return evidence.review_queue(_classified(spark, sf_dir), events, from_ms(F.lit(NOW_MS)))


@query(
    "review_queue",
    """SELECT episode_id, asset_ref, bucket, age_s, tier, reason, band, source, due_ms, due_state,
    (clock_basis = 'received_at')::INT + is_unknown::INT AS warnings FROM due""",
    QUEUE_SQL,
)
def review_queue(spark, sf_dir):
    return _items(spark, sf_dir).select(
        "episode_id",
        "asset_ref",
        "bucket",
        "age_s",
        "tier",
        "reason",
        "band",
        "source",
        ms("due_at").alias("due_ms"),
        "due_state",
        F.size("warnings").alias("warnings"),
    )


@query(
    "suggestions",
    """SELECT basis, count(*) AS episodes FROM (SELECT unnest([
      CASE WHEN contains(fired, 'H-EXPECTED') THEN 'H-EXPECTED fired: the effective policy predicts this silence' END,
      CASE WHEN contains(fired, 'H-VENDOR') OR contains(fired, 'H-NETWORK') THEN
        'a source-level cluster explains the gap without a device-level cause' END]) AS basis FROM summary)
    WHERE basis IS NOT NULL GROUP BY basis""",
    SUMMARY_SQL,
)
def suggestions(spark, sf_dir):
    advice = decisions.suggestions(F.transform("hypotheses", lambda h: h["code"]))
    return (
        _classified(spark, sf_dir)
        .select(F.inline(advice))
        .groupBy("basis")
        .agg(F.count(F.lit(1)).alias("episodes"))
    )


@query(
    "queue_statistics",
    """SELECT count(*) AS total_cases, count(*) FILTER (tier = 'urgent') AS urgent_tier,
    count(*) FILTER (band = 'direct') AS direct_evidence, count(*) FILTER (band IS NULL) AS without_band,
    count(*) FILTER (due_state = 'overdue') AS overdue,
    (SELECT quantile_disc(greatest(0, (received_ms - device_ms) / 1000.0::DOUBLE), 0.95) FROM telemetry
      WHERE device_ms IS NOT NULL) AS delivery_lag_p95_s,
    count(*) FILTER (end_ms IS NULL) AS open_episodes,
    CAST(sum(floor((end_ms - start_ms) / 60000.0::DOUBLE + 0.5)) AS BIGINT) AS closed_gap_minutes FROM due""",
    QUEUE_SQL,
)
def queue_statistics(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    return sla.dashboard(_items(spark, sf_dir), events, samples(spark, sf_dir))


@query(
    "recent_episodes",
    "SELECT episode_id, type, start_ms FROM episodes ORDER BY start_ms DESC, episode_id LIMIT 5",
)
def recent_episodes(spark, sf_dir):
    found = listing.recent(samples(spark, sf_dir))
    return found.select("episode_id", "type", ms("start_at").alias("start_ms"))


@query(
    "episode_page",
    """SELECT episode_id, device_ref, type, start_ms FROM episodes WHERE (start_ms, episode_id) > (1704844800000, 'ep_8')
    AND type = 'total_silence' ORDER BY start_ms, episode_id LIMIT 51""",
)
def episode_page(spark, sf_dir):
    found = samples(spark, sf_dir).withColumn("state", F.col("type"))
    cursor = listing.encode_cursor("2024-01-10T00:00:00.000Z", "ep_8")
    page = listing.page_rows(found, cursor=cursor, state="total_silence")
    return page.select("episode_id", "device_ref", "type", ms("start_at").alias("start_ms"))


@query(
    "missing_fact_union",
    """SELECT name, count(DISTINCT episode_id) AS episodes FROM (SELECT episode_id, unnest([
      CASE WHEN gnss_jamming_alert IS NULL THEN 'gnss.jamming_alert' END,
      CASE WHEN network_jamming_alert IS NULL THEN 'network.jamming_alert' END,
      CASE WHEN device_model_fault_pattern IS NULL THEN 'device.model_fault_pattern' END,
      'corridor.recurrence_qualified',
      CASE WHEN network_independent_devices IS NULL THEN 'network.independent_devices' END,
      CASE WHEN movement_moving_before_gap IS NULL THEN 'movement.moving_before_gap' END,
      CASE WHEN device_sleep_state_before_gap IS NULL THEN 'device.sleep_state_before_gap' END]) AS name FROM facts)
    WHERE name IS NOT NULL GROUP BY name""",
    FACTS_SQL,
)
def missing_fact_union(spark, sf_dir):
    judged = classify.evaluate(_facts(spark, sf_dir), from_ms(F.lit(CLASSIFY_MS)))
    names = F.array_distinct(F.flatten(F.transform("outcomes", lambda o: o["missing"])))
    return (
        judged.select("episode_id", F.explode(names).alias("name"))
        .groupBy("name")
        .agg(F.count(F.lit(1)).alias("episodes"))
    )


@query(
    "queue_tiers",
    "SELECT tier, count(*) AS count FROM due GROUP BY tier",
    QUEUE_SQL,
)
def queue_tiers(spark, sf_dir):
    return sla.counts_by(_items(spark, sf_dir), "tier")


@query(
    "bulk_check",
    """SELECT episode_id, NOT (tier = 'urgent' OR coalesce(band = 'direct', false)) AS eligible,
    CASE WHEN tier = 'urgent' THEN 'You must review urgent rows one at a time.'
      WHEN band = 'direct' THEN 'You must review rows with direct evidence one at a time.' END AS refusal FROM due""",
    QUEUE_SQL,
)
def bulk_check(spark, sf_dir):
    return queue.check_bulk("assign_owner", _items(spark, sf_dir))


@query("redaction_violations")
def redaction_violations(spark, sf_dir):
    """Violations in frames that must not leave: raw episodes and cohort rows below the floor."""
    from quietwatch.operators import quality

    events = telemetry(spark, sf_dir)
    found = redact.check_redaction(
        {"completeness": quality.completeness(events), "episodes": samples(spark, sf_dir).drop("state_at_gap")}
    )
    return spark.createDataFrame([(v.code, v.path) for v in found], "code string, path string")
