"""Queries over the telemetry view: quality measures, sampling, policies."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwatch.catalog.views import EPISODES_SQL, POLICY, TELEMETRY_SQL, epoch_ms, table, telemetry
from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators import episodes, policy, quality, temporal

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, view: str = TELEMETRY_SQL):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {view.strip()}\n{sql.strip()}"
        return function

    return register


@query(
    "cohort_keys",
    """SELECT coalesce(model, 'unknown') AS model, source, CAST(make_timestamp(received_ms * 1000) AS DATE) AS day,
    count(*) AS events FROM telemetry GROUP BY ALL""",
)
def cohort_keys(spark, sf_dir):
    return (
        telemetry(spark, sf_dir)
        .select(*quality.cohort_columns())
        .groupBy("model", "source", "day")
        .agg(F.count(F.lit(1)).alias("events"))
    )


@query(
    "field_presence",
    """SELECT source, count(*) FILTER (lat IS NOT NULL) AS position, count(*) FILTER (has_motion) AS motion,
    count(*) FILTER (has_power) AS power, count(*) FILTER (has_network) AS network,
    count(*) FILTER (device_ms IS NOT NULL) AS device_time,
    count(*) FILTER (vendor_ms IS NOT NULL) AS vendor_time FROM telemetry GROUP BY source""",
)
def field_presence(spark, sf_dir):
    return (
        telemetry(spark, sf_dir)
        .groupBy("source")
        .agg(*[F.count_if(quality.presence(g)).alias(g) for g in quality.FIELD_GROUPS])
    )


STATE_SQL = """CASE WHEN sleep_state IN ('deep_sleep', 'light_sleep') THEN 'sleep'
  WHEN motion_state = 'moving' THEN 'moving' WHEN ignition = 'on' THEN 'ignition_on' ELSE 'parked' END"""


@query(
    "motion_states",
    f"SELECT source, {STATE_SQL} AS state, count(*) AS events FROM telemetry GROUP BY ALL",
)
def motion_states(spark, sf_dir):
    return (
        telemetry(spark, sf_dir)
        .groupBy("source", policy.motion_state().alias("state"))
        .agg(F.count(F.lit(1)).alias("events"))
    )


_COMPLETENESS_SQL = """
, flags AS (
  SELECT coalesce(model, 'unknown') AS model, source, CAST(make_timestamp(received_ms * 1000) AS DATE) AS day,
    device_ref, coalesce(sleep_state IN ('deep_sleep', 'light_sleep'), false) AS asleep,
    unnest([{'g': 'position', 'ok': lat IS NOT NULL}, {'g': 'motion', 'ok': has_motion},
      {'g': 'power', 'ok': has_power}, {'g': 'network', 'ok': has_network},
      {'g': 'device_time', 'ok': device_ms IS NOT NULL}, {'g': 'vendor_time', 'ok': vendor_ms IS NOT NULL}]) AS f
  FROM telemetry
), completeness AS (
  SELECT model, source, day, count(DISTINCT device_ref) AS device_count, f.g AS field_group,
    count(*) FILTER (f.g = 'device_time' OR NOT asleep) AS denominator,
    count(*) FILTER ((f.g = 'device_time' OR NOT asleep) AND f.ok) AS numerator,
    count(*) FILTER (f.g <> 'device_time' AND asleep) AS excluded
  FROM flags GROUP BY model, source, day, f.g
)"""


@query(
    "completeness",
    """SELECT *, CASE WHEN denominator > 0 THEN numerator / denominator END AS completeness,
    CASE WHEN excluded > 0 THEN 'device_asleep=' || excluded ELSE '' END AS exclusion_reasons FROM completeness""",
    TELEMETRY_SQL + _COMPLETENESS_SQL,
)
def completeness(spark, sf_dir):
    rows = quality.completeness(telemetry(spark, sf_dir))
    reasons = F.transform(
        F.map_entries("exclusion_reasons"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))
    )
    return rows.withColumn("exclusion_reasons", F.array_join(reasons, ","))


@query(
    "published_cohorts",
    """SELECT count(*) FILTER (device_count >= 3) AS published, count(*) FILTER (device_count < 3) AS suppressed
    FROM completeness""",
    TELEMETRY_SQL + _COMPLETENESS_SQL,
)
def published_cohorts(spark, sf_dir):
    from quietwatch.operators.redact import suppressed_rows

    return suppressed_rows(quality.completeness(telemetry(spark, sf_dir)), floor=3)


_LAGS_SQL = """
, lags AS (
  SELECT unnest([{'lag': 'platform_lag_s', 's': (received_ms - vendor_ms) / 1000.0::DOUBLE},
    {'lag': 'total_lag_s', 's': (received_ms - device_ms) / 1000.0::DOUBLE},
    {'lag': 'device_to_vendor_lag_s', 's': (vendor_ms - device_ms) / 1000.0::DOUBLE}]) AS l FROM telemetry
)"""


@query(
    "lag_percentiles",
    """SELECT l.lag AS lag, count(*) AS count, quantile_disc(l.s, 0.5) AS p50, quantile_disc(l.s, 0.95) AS p95,
    quantile_disc(l.s, 0.99) AS p99, min(l.s) AS min, max(l.s) AS max FROM lags WHERE l.s IS NOT NULL GROUP BY l.lag""",
    TELEMETRY_SQL + _LAGS_SQL,
)
def lag_percentiles(spark, sf_dir):
    return quality.lag_percentiles(telemetry(spark, sf_dir))


@query(
    "timing_counts",
    """SELECT count(*) AS observation_count, count(*) FILTER (received_ms < device_ms) AS negative_lag_count,
    count(DISTINCT device_ref) FILTER (received_ms < device_ms) AS clock_skew_suspects,
    count(*) FILTER (device_ms IS NULL AND vendor_ms IS NULL) AS insufficient_times FROM telemetry""",
)
def timing_counts(spark, sf_dir):
    return quality.timing_counts(telemetry(spark, sf_dir))


@query("clock_skew_suspects", "SELECT DISTINCT device_ref FROM telemetry WHERE received_ms < device_ms")
def clock_skew_suspects(spark, sf_dir):
    return quality.clock_skew_suspects(telemetry(spark, sf_dir))


@query(
    "duplicate_identities",
    """SELECT count(*) AS total, count(*) - count(DISTINCT source || '|' || identity_value) AS duplicate_identities
    FROM telemetry""",
)
def duplicate_identities(spark, sf_dir):
    return quality.duplicate_identities(telemetry(spark, sf_dir))


_OUT_OF_ORDER_SQL = """(SELECT count(*) FILTER (device_ms < highest) FROM (
    SELECT device_ms, max(device_ms) OVER (PARTITION BY device_ref ORDER BY received_ms, arrival
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS highest
    FROM telemetry WHERE device_ms IS NOT NULL))"""


@query("out_of_order", f"SELECT {_OUT_OF_ORDER_SQL} AS out_of_order")
def out_of_order(spark, sf_dir):
    return quality.out_of_order(telemetry(spark, sf_dir))


@query("backfilled", "SELECT count(*) FILTER (received_ms - device_ms > 900000) AS backfilled FROM telemetry")
def backfilled(spark, sf_dir):
    return quality.backfilled(telemetry(spark, sf_dir))


@query(
    "impossible_values",
    """SELECT kind, count(*) AS count FROM (
      SELECT unnest([CASE WHEN lat < -90 OR lat > 90 THEN 'position.lat_out_of_range' END,
        CASE WHEN lon < -180 OR lon > 180 THEN 'position.lon_out_of_range' END,
        CASE WHEN lat = 0 AND lon = 0 THEN 'position.null_island' END,
        CASE WHEN speed_kph < 0 OR speed_kph > 400 THEN 'motion.speed_implausible' END,
        CASE WHEN external_v < 0 OR external_v > 100 THEN 'power.external_v_sentinel' END]) AS kind FROM telemetry)
    WHERE kind IS NOT NULL GROUP BY kind""",
)
def impossible_values(spark, sf_dir):
    return quality.impossible_values(telemetry(spark, sf_dir))


@query(
    "integrity",
    f"""SELECT total, duplicate_identities, out_of_order, backfilled, duplicate_identities / total AS duplicate_rate,
      out_of_order / total AS out_of_order_rate, backfilled / total AS backfill_rate FROM (
      SELECT count(*) AS total, count(*) - count(DISTINCT source || '|' || identity_value) AS duplicate_identities,
        {_OUT_OF_ORDER_SQL} AS out_of_order, count(*) FILTER (received_ms - device_ms > 900000) AS backfilled
      FROM telemetry)""",
)
def integrity(spark, sf_dir):
    return quality.integrity(telemetry(spark, sf_dir))


@query(
    "platform_findings",
    """SELECT 'destructive_setting' AS finding, source, setting, CAST(NULL AS BOOLEAN) AS sufficient,
      source || ': ' || setting || ' is destroying records before they can be exported' AS blocking
    FROM settings WHERE s_acctbal < 2000
    UNION ALL
    SELECT 'retention', source, NULL, raw_days >= 90, CASE WHEN raw_days < 90 THEN source || ': raw retention is ' ||
      raw_days || ' days but the audit requests 90' WHEN raw_days IS NULL THEN source ||
      ': raw retention window is undocumented and must be established' END FROM settings""",
    """settings AS (SELECT s_name AS source, 'filter_' || s_nationkey AS setting, s_acctbal,
      CASE WHEN s_suppkey % 7 <> 0 THEN s_suppkey % 200 END AS raw_days FROM supplier)""",
)
def platform_findings(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    destructive = s.select(
        F.col("s_name").alias("source"),
        F.concat(F.lit("filter_"), F.col("s_nationkey").cast("string")).alias("setting"),
        F.lit("drops records").alias("effect"),
        (F.col("s_acctbal") < 2000).alias("enabled"),
        F.lit(True).alias("default_enabled"),
    )
    retention = s.select(
        F.col("s_name").alias("source"),
        F.when(F.col("s_suppkey") % 7 != 0, F.col("s_suppkey") % 200).alias("raw_days"),
        F.lit(True).alias("customer_reducible"),
        F.lit(90).alias("requested_days"),
    )
    return quality.platform_findings(destructive, retention)


@query(
    "clock_basis",
    """SELECT device_ref, CASE WHEN bool_and(device_clock) THEN 'device_time' ELSE 'received_at' END AS clock_basis
    FROM basis GROUP BY device_ref""",
    EPISODES_SQL,
)
def clock_basis(spark, sf_dir):
    return episodes.clock_basis(telemetry(spark, sf_dir))


@query(
    "report_pairs",
    """SELECT device_ref, count(*) AS pairs, CAST(sum(at_ms - before_ms) AS BIGINT) AS gap_ms,
    max(at_ms - before_ms) AS longest_ms FROM pairs GROUP BY device_ref""",
    EPISODES_SQL,
)
def report_pairs(spark, sf_dir):
    paired = episodes.pair_reports(telemetry(spark, sf_dir), POLICY).finished()
    gap = F.col("_at") - F.col("_before")
    return (
        paired.filter(F.col("_prev").isNotNull())
        .groupBy("device_ref")
        .agg(
            F.count(F.lit(1)).alias("pairs"), F.sum(gap).alias("gap_ms"), F.max(gap).alias("longest_ms")
        )
    )


@query(
    "stale_runs",
    "SELECT device_ref, before_ms AS start_ms, at_ms AS end_ms FROM stale_hits",
    EPISODES_SQL,
)
def stale_runs(spark, sf_dir):
    judged = episodes.judge_pairs(episodes.pair_reports(telemetry(spark, sf_dir), POLICY))
    return episodes.stale_pairs(judged).select(
        "device_ref", ms("start_at").alias("start_ms"), ms("end_at").alias("end_ms")
    )


@query(
    "episodes_sampled",
    """SELECT device_ref, type, start_ms, end_ms, duration_s, clock_basis, expected_interval_s, missed_reports,
    policy_version, weak_basis FROM episodes""",
    EPISODES_SQL,
)
def episodes_sampled(spark, sf_dir):
    found = episodes.sample_episodes(telemetry(spark, sf_dir), POLICY)
    return found.select(
        "device_ref",
        "type",
        ms("start_at").alias("start_ms"),
        ms("end_at").alias("end_ms"),
        "duration_s",
        "clock_basis",
        "expected_interval_s",
        "missed_reports",
        "policy_version",
        "weak_basis",
    )


@query(
    "episode_summary",
    """SELECT count(*) AS episode_count, count(*) FILTER (type = 'total_silence') AS total_silence,
    count(*) FILTER (type = 'gnss_only_loss') AS gnss_only_loss,
    count(*) FILTER (type = 'stale_position') AS stale_position,
    count(*) FILTER (type = 'vendor_ingestion_delay') AS vendor_ingestion_delay,
    CAST(0 AS BIGINT) AS suppressed_count, count(*) FILTER (weak_basis) AS weak_basis_count,
    count(DISTINCT device_ref) AS devices_with_episodes,
    (SELECT count(DISTINCT device_ref) FROM telemetry) AS devices_observed,
    quantile_disc(duration_s, 0.5) AS p50, quantile_disc(duration_s, 0.95) AS p95,
    quantile_disc(duration_s, 0.99) AS p99, min(duration_s) AS shortest, max(duration_s) AS longest FROM episodes""",
    EPISODES_SQL,
)
def episode_summary(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    summary = episodes.summarise_episodes(episodes.sample_episodes(events, POLICY), events)
    return summary.select(
        "*",
        "duration_s.p50",
        "duration_s.p95",
        "duration_s.p99",
        F.col("duration_s.min").alias("shortest"),
        F.col("duration_s.max").alias("longest"),
    ).drop("duration_s")


_INTERVAL_SQL = """CASE state WHEN 'moving' THEN 21600.0::DOUBLE WHEN 'ignition_on' THEN 43200.0::DOUBLE
  WHEN 'parked' THEN 86400.0::DOUBLE ELSE 172800.0::DOUBLE END"""


@query(
    "expected_next_report",
    f"""SELECT arrival, state, {_INTERVAL_SQL} AS interval_s,
    CAST(received_ms + {_INTERVAL_SQL} * 1000 AS BIGINT) AS due_ms,
    CAST(received_ms + {_INTERVAL_SQL} * 1500 + 120000 AS BIGINT) AS deadline_ms, false AS weak_basis FROM ordered""",
    EPISODES_SQL,
)
def expected_next_report(spark, sf_dir):
    reports = telemetry(spark, sf_dir).select(
        "arrival", F.col("received_at").alias("last_report_at"), policy.motion_state().alias("state")
    )
    expected = policy.expected_next_report(reports, POLICY.column(), lag_p95_s=120)
    return expected.select(
        "arrival",
        "state",
        "interval_s",
        ms("due_at").alias("due_ms"),
        ms("deadline_at").alias("deadline_ms"),
        "weak_basis",
    )


# The instant the open-gap queries look from: noon after the supplied month, when some devices are overdue.
_NOW_MS = 1_706_788_800_000


@query(
    "trailing_silence",
    f"""SELECT device_ref, at_ms AS start_ms, CAST(at_ms + {_INTERVAL_SQL} * 1500 AS BIGINT) AS deadline_ms,
      clock_basis, state AS state_at_gap FROM (
      SELECT device_ref, coalesce(device_ms, received_ms) AS at_ms, state,
        CASE WHEN device_ms IS NULL THEN 'received_at' ELSE 'device_time' END AS clock_basis,
        row_number() OVER (PARTITION BY device_ref ORDER BY received_ms DESC, arrival DESC) AS n
      FROM ordered) WHERE n = 1 AND at_ms + {_INTERVAL_SQL} * 1500 < {_NOW_MS}""",
    EPISODES_SQL,
)
def trailing_silence(spark, sf_dir):
    found = episodes.trailing_silence(telemetry(spark, sf_dir), POLICY, F.lit(_NOW_MS))
    return found.select(
        "device_ref",
        ms("start_at").alias("start_ms"),
        ms("deadline_at").alias("deadline_ms"),
        "clock_basis",
        "state_at_gap",
    )


def region_windows(spark, sf_dir):
    """One maintenance window per region, a day and a half each."""
    begin = F.lit(1_704_067_200_000) + F.col("r_regionkey") * 5 * 86_400_000
    return table(spark, sf_dir, "region").select(
        F.col("r_regionkey").alias("ord"),
        F.concat(F.lit("maintenance_"), F.lower("r_name")).alias("reason"),
        from_ms(begin.cast("bigint")).alias("from_at"),
        from_ms((begin + 129_600_000).cast("bigint")).alias("to_at"),
        F.lit("ops").alias("approved_by"),
    )


WINDOWS_SQL = """, windows AS (SELECT r_regionkey AS ord, 'maintenance_' || lower(r_name) AS reason,
  1704067200000 + r_regionkey * 5 * 86400000 AS from_ms,
  1704067200000 + r_regionkey * 5 * 86400000 + 129600000 AS to_ms FROM region)"""


@query(
    "suppressed_episodes",
    """SELECT type, reason AS suppressed_by, count(*) AS episodes FROM (
      SELECT type, CASE WHEN type IN ('total_silence', 'vendor_ingestion_delay') THEN
        (SELECT arg_min(reason, ord) FROM windows w WHERE e.start_ms >= w.from_ms AND e.start_ms < w.to_ms) END AS reason
      FROM episodes e) GROUP BY ALL""",
    EPISODES_SQL + WINDOWS_SQL,
)
def suppressed_episodes(spark, sf_dir):
    found = episodes.sample_episodes(
        telemetry(spark, sf_dir), POLICY, windows=region_windows(spark, sf_dir)
    )
    return found.groupBy("type", "suppressed_by").agg(F.count(F.lit(1)).alias("episodes"))


def model_policies(spark, sf_dir):
    """Two policy versions per observed model, the second from mid-month; ``unknown`` has none."""
    models = telemetry(spark, sf_dir).select(F.col("device.model").alias("cohort")).distinct()
    version = lambda n, factor, begin, end: F.struct(
        *[
            F.lit(float(seconds * factor)).alias(state)
            for state, seconds in zip(policy.MOTION_STATES, (21600, 43200, 86400, 172800, 3600), strict=True)
        ],
        F.lit("declared" if n == 1 else "measured").alias("provenance"),
        F.lit(1.5).alias("grace_factor"),
        F.lit(f"v{n}").alias("version"),
        from_ms(F.lit(begin)).alias("valid_from"),
        (from_ms(F.lit(end)) if end else F.lit(None).cast("timestamp")).alias("valid_to"),
    )
    begin, middle = 1_704_067_200_000 + 86_400_000, 1_705_276_800_000
    return models.filter(F.col("cohort").isNotNull()).select(
        "cohort", F.inline(F.array(version(1, 1, begin, middle), version(2, 2, middle, None)))
    )


@query(
    "policy_as_of",
    """SELECT coalesce(model, 'unknown') AS cohort, CASE WHEN model IS NOT NULL AND received_ms >= 1705276800000 THEN 'v2'
      WHEN model IS NOT NULL AND received_ms >= 1704153600000 THEN 'v1' END AS version, count(*) AS events
    FROM telemetry GROUP BY ALL""",
)
def policy_as_of(spark, sf_dir):
    events = telemetry(spark, sf_dir).select(
        F.coalesce("device.model", F.lit("unknown")).alias("cohort"), "received_at"
    )
    resolved = temporal.policy_at(events, model_policies(spark, sf_dir), "cohort", "received_at")
    return resolved.groupBy("cohort", F.col("policy.version").alias("version")).agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "events_of_tenant",
    "SELECT source, count(*) AS events FROM telemetry WHERE tenant_id = 'tenant_a' GROUP BY source",
)
def events_of_tenant(spark, sf_dir):
    from quietwatch.operators.listing import tenant_rows

    return tenant_rows(telemetry(spark, sf_dir), "tenant_a").groupBy("source").agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "cell_lookup",
    """SELECT cell_status, range_m, count(*) AS events FROM (
      SELECT CASE WHEN l.cell_id IS NULL THEN 'no_record' ELSE 'found' END AS cell_status, l.range_m
      FROM telemetry t LEFT JOIN (SELECT s_suppkey AS cell_id, s_nationkey % 3 AS mnc, 500.0::DOUBLE + s_nationkey AS range_m
        FROM supplier) l ON t.cell_id = l.cell_id AND t.mnc = l.mnc) GROUP BY ALL""",
)
def cell_lookup(spark, sf_dir):
    from quietwatch.operators.cells import lookup_cells

    layer = table(spark, sf_dir, "supplier").select(
        F.lit(639).cast("bigint").alias("mcc"),
        (F.col("s_nationkey") % 3).cast("bigint").alias("mnc"),
        F.lit(1).cast("bigint").alias("lac"),
        F.col("s_suppkey").alias("cell_id"),
        (F.lit(500.0) + F.col("s_nationkey")).alias("range_m"),
    )
    served = telemetry(spark, sf_dir).select(
        F.lit(639).cast("bigint").alias("mcc"),
        F.col("network.mnc").alias("mnc"),
        F.lit(1).cast("bigint").alias("lac"),
        F.col("network.cell_id").alias("cell_id"),
    )
    return lookup_cells(served, layer).groupBy("cell_status", "range_m").agg(
        F.count(F.lit(1)).alias("events")
    )


@query(
    "bounding_fixes",
    """SELECT e.episode_id, (SELECT max(t) FROM fixes f WHERE f.device_ref = e.device_ref AND f.t <= e.start_ms) AS last_fix_ms,
      (SELECT min(t) FROM fixes f WHERE f.device_ref = e.device_ref AND f.t >= e.end_ms) AS next_fix_ms FROM episodes e""",
    EPISODES_SQL
    + """, fixes AS (SELECT device_ref, coalesce(device_ms, received_ms) AS t FROM telemetry
      WHERE valid AND lat IS NOT NULL AND lon IS NOT NULL)""",
)
def bounding_fixes(spark, sf_dir):
    events = telemetry(spark, sf_dir)
    found = episodes.with_episode_id(episodes.sample_episodes(events, POLICY))
    return episodes.last_and_next_fix(found, events).select(
        "episode_id",
        F.col("last_fix.at_ms").alias("last_fix_ms"),
        F.col("next_fix.at_ms").alias("next_fix_ms"),
    )


@query(
    "replay_windows",
    """SELECT DISTINCT user_id, window_index, window_from_ms, least(window_from_ms + 86400000, to_ms) AS window_to_ms FROM (
      SELECT user_id, to_ms, unnest(range(0, CAST(ceil((to_ms - from_ms) / 86400000.0::DOUBLE) AS BIGINT))) AS window_index,
        from_ms + window_index * 86400000 AS window_from_ms
      FROM (SELECT user_id, min(epoch_us(ts) // 1000) AS from_ms, max(epoch_us(ts) // 1000) AS to_ms FROM events GROUP BY user_id))
    WHERE least(window_from_ms + 86400000, to_ms) > 1705276800000""",
    "scopes AS (SELECT 1)",
)
def replay_windows(spark, sf_dir):
    from quietwatch.operators.replay import plan_windows, remaining_windows

    scopes = table(spark, sf_dir, "events").groupBy("user_id").agg(
        from_ms(F.min(epoch_ms("ts"))).alias("from_at"), from_ms(F.max(epoch_ms("ts"))).alias("to_at")
    )
    windows = remaining_windows(plan_windows(scopes), from_ms(F.lit(1_705_276_800_000)))
    return windows.select(
        "user_id",
        F.col("window_index").cast("bigint").alias("window_index"),
        ms("window_from").alias("window_from_ms"),
        ms("window_to").alias("window_to_ms"),
    )
