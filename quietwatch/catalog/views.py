"""The supplied tables mapped to telemetry inputs.

``telemetry`` derives a full report from each ``events`` row; every branch of the operators (null
groups, sleeping devices, skewed clocks, frozen positions, resends) is reached by modulus rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms
from quietwatch.operators.policy import ReportingPolicy
from quietwatch.session import configure

TENANT = "tenant_a"

# Gaps in the supplied events are hours long, so the policy is scaled to hours.
POLICY = ReportingPolicy(
    moving=6 * 3600,
    ignition_on=12 * 3600,
    parked=24 * 3600,
    sleep=48 * 3600,
    exception=3600,
    provenance="declared",
    grace_factor=1.5,
    version="2024.1",
)


_SHARED: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """An intermediate frame that many queries read, planned once per session and persisted."""
    key = (id(spark), spark.sparkContext.applicationId, sf_dir, name)
    if key not in _SHARED:
        configure(spark)
        _SHARED[key] = build().persist()
    return _SHARED[key]


def forget() -> None:
    """Drop the shared frames, so that the next query computes its own."""
    for frame in _SHARED.values():
        frame.unpersist()
    _SHARED.clear()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    configure(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_ms(column: str) -> Column:
    return F.unix_millis(F.col(column).cast("timestamp"))


def _every(n: int, value: Column, remainder: int = 0) -> Column:
    return F.when(F.col("event_id") % n == remainder, value)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "event_type",
        "value",
        epoch_ms("ts").alias("t"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    user, event, value = F.col("user_id"), F.col("event_id"), F.col("value")
    lag_ms = ((event * 37) % 1200) * 1000
    device_ms = F.when((user % 5 == 0) & (event % 7 == 0), F.lit(None)).otherwise(
        F.col("t") + F.when(user % 11 == 3, F.lit(7_200_000)).otherwise(F.lit(0))
    )
    day = F.floor(F.col("t") / 86_400_000)
    no = lambda t: F.lit(None).cast(t)
    lat = (
        F.when(event % 17 == 0, no("double"))
        .when(event % 211 == 0, F.lit(0.0))
        .when(event % 97 == 0, F.lit(95.5))
        .otherwise(F.lit(-1.0) - (user % 50) / F.lit(100.0) - F.floor(day / 4) / F.lit(1000.0))
    )
    lon = (
        F.when(event % 19 == 0, no("double"))
        .when(event % 211 == 0, F.lit(0.0))
        .otherwise(F.lit(36.0) + (user % 40) / F.lit(100.0))
    )
    k = F.col("k")
    position = F.when(
        event % 29 != 0,
        F.struct(
            lat.alias("lat"),
            lon.alias("lon"),
            (event % 13 != 0).alias("valid"),
        ),
    )
    motion = F.when(
        F.col("event_type") != "error",
        F.struct(
            value.alias("speed_kph"),
            F.when(k % 3 == 0, F.lit("on"))
            .when(k % 3 == 1, F.lit("off"))
            .otherwise(F.lit("unknown"))
            .alias("ignition"),
            F.when(value > 100, F.lit("moving"))
            .when(value > 20, F.lit("stationary"))
            .alias("motion_state"),
        ),
    )
    power = F.when(
        ~((F.col("event_type") == "view") & (event % 4 == 0)),
        F.struct(
            F.when(event % 10 < 7, F.lit("present"))
            .when(event % 10 < 9, F.lit("absent"))
            .alias("external_state"),
            F.when(event % 53 == 0, F.lit(6553.5))
            .otherwise(F.lit(12.0) + k / F.lit(10.0))
            .alias("external_v"),
        ),
    )
    network = F.when(
        user % 9 != 0,
        F.struct(
            F.lit(639).cast("bigint").alias("mcc"),
            (user % 3).alias("mnc"),
            (user % 20).alias("cell_id"),
        ),
    )
    device = F.struct(
        F.lit("acme").alias("vendor"),
        F.when(user % 7 != 0, F.concat(F.lit("model_"), (user % 7).cast("string"))).alias("model"),
        F.concat(F.lit("fw_"), (user % 3).cast("string")).alias("firmware"),
        _every(61, F.lit("watchdog")).alias("reboot_reason"),
        F.when(k < 10, F.lit("deep_sleep"))
        .when(k < 20, F.lit("light_sleep"))
        .when(k < 25, F.lit("unknown"))
        .when(k < 90, F.lit("awake"))
        .alias("sleep_state"),
    )
    alert = lambda n, code: _every(
        n, F.struct(F.lit(code).alias("code"), F.lit(f"vendor_{code}").alias("source_code"))
    )
    alerts = F.array_compact(
        F.array(
            alert(37, "power_cut"),
            alert(43, "tamper"),
            alert(71, "gnss_jamming"),
            alert(83, "network_jamming"),
        )
    )
    return e.select(
        F.lit(TENANT).alias("tenant_id"),
        F.col("event_type").alias("source"),
        F.struct(
            F.lit("vendor_sequence").alias("basis"),
            F.concat_ws(
                "-", user.cast("string"), F.floor(F.col("t") / 7_200_000).cast("string")
            ).alias("value"),
            no("string").alias("algorithm"),
        ).alias("event_identity"),
        F.concat(F.lit("ast_"), F.lpad(F.floor(user / 2).cast("string"), 8, "0")).alias("asset_ref"),
        F.concat(F.lit("dev_"), F.lpad(user.cast("string"), 8, "0")).alias("device_ref"),
        from_ms(F.col("t") + lag_ms).alias("received_at"),
        from_ms(F.when(event % 6 != 0, F.col("t") + ((event * 37) % 1200) * 500)).alias(
            "vendor_received_at"
        ),
        from_ms(device_ms).alias("device_time"),
        position.alias("position"),
        motion.alias("motion"),
        power.alias("power"),
        network.alias("network"),
        device.alias("device"),
        alerts.alias("alerts"),
        event.alias("arrival"),
    )


TELEMETRY_SQL = """
raw AS (
  SELECT event_id, user_id, event_type, value, epoch_us(ts) // 1000 AS t,
         CAST(json_extract_string(props, '$.k') AS INT) AS k
  FROM events
), telemetry AS (
  SELECT 'tenant_a' AS tenant_id, event_type AS source, event_id AS arrival, user_id, k,
    user_id || '-' || (t // 7200000) AS identity_value,
    'ast_' || lpad(CAST(user_id // 2 AS VARCHAR), 8, '0') AS asset_ref,
    'dev_' || lpad(CAST(user_id AS VARCHAR), 8, '0') AS device_ref,
    t + ((event_id * 37) % 1200) * 1000 AS received_ms,
    CASE WHEN event_id % 6 <> 0 THEN t + ((event_id * 37) % 1200) * 500 END AS vendor_ms,
    CASE WHEN user_id % 5 = 0 AND event_id % 7 = 0 THEN NULL
         ELSE t + CASE WHEN user_id % 11 = 3 THEN 7200000 ELSE 0 END END AS device_ms,
    event_id % 29 <> 0 AS has_position,
    CASE WHEN event_id % 29 = 0 OR event_id % 17 = 0 THEN NULL
         WHEN event_id % 211 = 0 THEN 0.0::DOUBLE WHEN event_id % 97 = 0 THEN 95.5::DOUBLE
         ELSE -1.0::DOUBLE - (user_id % 50) / 100.0::DOUBLE
              - ((t // 86400000) // 4) / 1000.0::DOUBLE END AS lat,
    CASE WHEN event_id % 29 = 0 OR event_id % 19 = 0 THEN NULL
         WHEN event_id % 211 = 0 THEN 0.0::DOUBLE
         ELSE 36.0::DOUBLE + (user_id % 40) / 100.0::DOUBLE END AS lon,
    CASE WHEN event_id % 29 <> 0 THEN event_id % 13 <> 0 END AS valid,
    event_type <> 'error' AS has_motion,
    CASE WHEN event_type <> 'error' THEN value END AS speed_kph,
    CASE WHEN event_type <> 'error' THEN
      CASE k % 3 WHEN 0 THEN 'on' WHEN 1 THEN 'off' ELSE 'unknown' END END AS ignition,
    CASE WHEN event_type <> 'error' THEN
      CASE WHEN value > 100 THEN 'moving' WHEN value > 20 THEN 'stationary' END END AS motion_state,
    NOT (event_type = 'view' AND event_id % 4 = 0) AS has_power,
    CASE WHEN NOT (event_type = 'view' AND event_id % 4 = 0) THEN
      CASE WHEN event_id % 10 < 7 THEN 'present' WHEN event_id % 10 < 9 THEN 'absent' END END
      AS external_state,
    CASE WHEN NOT (event_type = 'view' AND event_id % 4 = 0) THEN
      CASE WHEN event_id % 53 = 0 THEN 6553.5::DOUBLE ELSE 12.0::DOUBLE + k / 10.0::DOUBLE END END
      AS external_v,
    user_id % 9 <> 0 AS has_network,
    CASE WHEN user_id % 9 <> 0 THEN user_id % 3 END AS mnc,
    CASE WHEN user_id % 9 <> 0 THEN user_id % 20 END AS cell_id,
    CASE WHEN user_id % 7 <> 0 THEN 'model_' || (user_id % 7) END AS model,
    'fw_' || (user_id % 3) AS firmware,
    CASE WHEN event_id % 61 = 0 THEN 'watchdog' END AS reboot_reason,
    CASE WHEN k < 10 THEN 'deep_sleep' WHEN k < 20 THEN 'light_sleep' WHEN k < 25 THEN 'unknown'
         WHEN k < 90 THEN 'awake' END AS sleep_state,
    event_id % 37 = 0 AS power_cut, event_id % 43 = 0 AS tamper,
    event_id % 71 = 0 AS gnss_jamming, event_id % 83 = 0 AS network_jamming
  FROM raw
)"""

# The sampler in plain SQL: pairing by receipt order, then a recursive walk of the stale runs.
EPISODES_SQL = TELEMETRY_SQL + """, ordered AS (
  SELECT *, row_number() OVER w AS i,
    lag(received_ms) OVER w AS p_received, lag(device_ms) OVER w AS p_device,
    lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon,
    CASE WHEN sleep_state IN ('deep_sleep', 'light_sleep') THEN 'sleep'
         WHEN motion_state = 'moving' THEN 'moving'
         WHEN ignition = 'on' THEN 'ignition_on' ELSE 'parked' END AS state
  FROM telemetry WINDOW w AS (PARTITION BY device_ref ORDER BY received_ms, arrival)
), basis AS (
  SELECT *, bool_and(device_ms IS NOT NULL AND (i = 1 OR coalesce(device_ms >= p_device, false)))
      OVER (PARTITION BY device_ref) AS device_clock,
    lag(state) OVER (PARTITION BY device_ref ORDER BY received_ms, arrival) AS p_state
  FROM ordered
), pairs AS (
  SELECT *, CASE WHEN device_clock THEN device_ms ELSE received_ms END AS at_ms,
    CASE WHEN device_clock THEN p_device ELSE p_received END AS before_ms,
    CASE p_state WHEN 'moving' THEN 21600.0::DOUBLE WHEN 'ignition_on' THEN 43200.0
      WHEN 'parked' THEN 86400.0 WHEN 'sleep' THEN 172800.0 END AS interval_s
  FROM basis WHERE i > 1
), judged AS (
  SELECT *, at_ms > before_ms + interval_s * 1500 AS late,
    coalesce((received_ms - device_ms) / 1000.0::DOUBLE > 900, false) AS held,
    p_lat IS NOT NULL AND coalesce(p_lat = lat, false) AND p_lon IS NOT DISTINCT FROM lon AS same
  FROM pairs
), islands AS (
  SELECT *, sum(CASE WHEN same THEN 0 ELSE 1 END)
      OVER (PARTITION BY device_ref ORDER BY i) AS island
  FROM judged
), runs AS (
  SELECT *, row_number() OVER (PARTITION BY device_ref, island ORDER BY i) AS pos
  FROM islands WHERE same
), stale_hits AS (
  WITH RECURSIVE walk AS (
    SELECT device_ref, island, min(pos) AS pos FROM runs
    WHERE pos >= 3 AND NOT late AND valid GROUP BY device_ref, island
    UNION ALL
    SELECT w.device_ref, w.island,
      (SELECT min(r.pos) FROM runs r WHERE r.device_ref = w.device_ref AND r.island = w.island
         AND r.pos >= w.pos + 3 AND NOT r.late AND r.valid) AS pos
    FROM walk w WHERE w.pos IS NOT NULL
  )
  SELECT r.* FROM runs r JOIN walk w USING (device_ref, island, pos)
), sampled AS (
  SELECT device_ref, CASE WHEN late AND held THEN 'vendor_ingestion_delay' WHEN late THEN
      'total_silence' ELSE 'gnss_only_loss' END AS type, before_ms, at_ms, device_clock, interval_s,
    CASE WHEN late THEN greatest(1, CAST(floor((at_ms - before_ms) / 1000.0::DOUBLE / interval_s) AS BIGINT) - 1)
      ELSE 0 END AS missed
  FROM judged WHERE late OR valid = false
  UNION ALL
  SELECT device_ref, 'stale_position', before_ms, at_ms, device_clock, interval_s, 0 FROM stale_hits
), episodes AS (
  SELECT device_ref, type, before_ms AS start_ms, at_ms AS end_ms,
    (at_ms - before_ms) / 1000.0::DOUBLE AS duration_s,
    CASE WHEN device_clock THEN 'device_time' ELSE 'received_at' END AS clock_basis,
    interval_s AS expected_interval_s, CAST(missed AS BIGINT) AS missed_reports,
    '2024.1' AS policy_version, false AS weak_basis,
    'ep_' || substr(sha256(device_ref || '|' || type || '|' || before_ms), 1, 16) AS episode_id
  FROM sampled
)"""
