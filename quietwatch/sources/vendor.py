"""Vendor forward payloads mapped to canonical events in one projection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.scalars import round_half_up
from quietwatch.sources.schemas import SCHEMA_VERSION

ADAPTER_VERSION = "forwarder-0.1.0"

# Knots to km/h, alarm codes, mapped attributes and the stale-fix warning.
KNOTS_TO_KPH = 1.852
ALARM_CODES = {
    "powerCut": "power_cut",
    "powerOff": "power_cut",
    "powerRestored": "other",
    "tampering": "tamper",
    "removing": "unplug",
    "jamming": "gnss_jamming",
    "tow": "towing",
}
MAPPED_ATTRIBUTES = (
    "sat", "hdop", "ignition", "motion", "totalDistance", "power", "battery", "batteryLevel",
    "charge", "rssi", "mcc", "mnc", "cid", "lac", "alarm", "version",
)
STALE_FIX = "fixTime differs from deviceTime; position may be stale"


def decode(payloads: DataFrame, tenant_id: str, source: str) -> DataFrame:
    """``payload`` (VARIANT), ``asset_ref``, ``device_ref``, ``received_at`` to event columns.

    A payload without a position fails to decode and is marked, with no value of it kept.
    """
    def get(path: str, kind: str) -> Column:
        return F.try_variant_get("payload", path, kind)

    attributes = get("$.position.attributes", "map<string,variant>")

    def attribute(name: str) -> Column:
        return F.try_element_at(F.col("_attributes"), F.lit(name))

    def kind_of(name: str) -> Column:
        return F.schema_of_variant(attribute(name))

    def number(name: str) -> Column:
        return F.when(
            kind_of(name).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"),
            F.try_variant_get(attribute(name), "$", "double"),
        )

    def flag(name: str) -> Column:
        return F.when(kind_of(name) == "BOOLEAN", F.try_variant_get(attribute(name), "$", "boolean"))

    def text(name: str) -> Column:
        return F.when(kind_of(name) == "STRING", F.try_variant_get(attribute(name), "$", "string"))

    rows = payloads.withColumn("_attributes", attributes)
    lat, lon = get("$.position.latitude", "double"), get("$.position.longitude", "double")
    fix_time, device_time = get("$.position.fixTime", "string"), get("$.position.deviceTime", "string")
    position_id = get("$.position.id", "string")
    digest = F.sha2(
        F.concat_ws(
            "|",
            F.lit(tenant_id),
            F.lit(source),
            "device_ref",
            F.coalesce(device_time, F.lit("")),
            F.to_json(get("$.position", "variant")),
        ),
        256,
    )
    identity = F.struct(
        F.when(position_id.isNotNull(), F.lit("vendor_event_id"))
        .otherwise(F.lit("synthesised"))
        .alias("basis"),
        F.coalesce(position_id, F.concat(F.lit("h:"), F.substring(digest, 1, 32))).alias("value"),
        F.when(
            position_id.isNull(), F.lit("sha256(tenant|source|device_ref|device_time|position)")
        ).alias("algorithm"),
    )
    position = F.when(
        lat.isNotNull() & lon.isNotNull(),
        F.struct(
            lat.alias("lat"),
            lon.alias("lon"),
            get("$.position.accuracy", "double").alias("accuracy_m"),
            F.lit("gps").alias("fix_type"),
            number("sat").cast("bigint").alias("satellites"),
            number("hdop").alias("hdop"),
            F.coalesce(get("$.position.valid", "boolean"), F.lit(False)).alias("valid"),
        ),
    )
    speed = get("$.position.speed", "double")
    course = get("$.position.course", "double")
    ignition = F.when(
        attribute("ignition").isNotNull(),
        F.when(flag("ignition"), F.lit("on"))
        .when(~flag("ignition"), F.lit("off"))
        .otherwise(F.lit("unknown")),
    )
    moving = F.when(flag("motion"), F.lit("moving")).when(~flag("motion"), F.lit("stationary"))

    def present(*members: Column) -> Column:
        """A group with at least one value, else NULL."""
        return F.when(F.coalesce(*[m.cast("string") for m in members]).isNotNull(), F.struct(*members))

    motion = present(
        (round_half_up(speed * F.lit(KNOTS_TO_KPH) * 10) / F.lit(10.0)).alias("speed_kph"),
        course.alias("heading_deg"),
        ignition.alias("ignition"),
        moving.alias("motion_state"),
        round_half_up(number("totalDistance")).cast("double").alias("odometer_m"),
    )
    power = present(
        F.when(flag("charge"), F.lit("present")).when(~flag("charge"), F.lit("absent")).alias("external_state"),
        number("power").alias("external_v"),
        number("battery").alias("internal_v"),
        number("batteryLevel").alias("internal_pct"),
    )
    network = present(
        number("mcc").cast("bigint").alias("mcc"),
        number("mnc").cast("bigint").alias("mnc"),
        number("lac").cast("bigint").alias("lac"),
        number("cid").cast("bigint").alias("cell_id"),
        number("rssi").alias("rssi_dbm"),
    )
    codes = F.create_map(*[F.lit(x) for pair in ALARM_CODES.items() for x in pair])
    alarm = text("alarm")
    overspeed = get("$.event.type", "string") == "deviceOverspeed"
    alerts = F.array_compact(
        F.array(
            F.when(
                alarm.isNotNull(),
                F.struct(
                    F.coalesce(F.try_element_at(codes, alarm), F.lit("other")).alias("code"),
                    alarm.alias("source_code"),
                ),
            ),
            F.when(
                overspeed,
                F.struct(F.lit("other").alias("code"), F.lit("deviceOverspeed").alias("source_code")),
            ),
        )
    )
    warnings = F.when(
        fix_time.isNotNull() & device_time.isNotNull() & (fix_time != device_time),
        F.array(F.lit(STALE_FIX)),
    )
    extras = F.map_filter("_attributes", lambda k, _: ~k.isin(*MAPPED_ATTRIBUTES))
    return rows.select(
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.lit(tenant_id).alias("tenant_id"),
        F.lit(source).alias("source"),
        identity.alias("event_identity"),
        "asset_ref",
        "device_ref",
        F.col("received_at"),
        F.try_to_timestamp(get("$.position.serverTime", "string")).alias("vendor_received_at"),
        F.try_to_timestamp(device_time).alias("device_time"),
        position.alias("position"),
        motion.alias("motion"),
        power.alias("power"),
        network.alias("network"),
        F.struct(
            F.lit("forwarder").alias("vendor"),
            F.nullif(get("$.device.model", "string"), F.lit("")).alias("model"),
            text("version").alias("firmware"),
            F.lit(None).cast("string").alias("reboot_reason"),
            F.lit(None).cast("string").alias("sleep_state"),
        ).alias("device"),
        alerts.alias("alerts"),
        F.struct(
            F.sha2(F.to_json("payload"), 256).alias("raw_sha256"),
            F.lit(ADAPTER_VERSION).alias("adapter_version"),
            warnings.alias("parse_warnings"),
        ).alias("quality"),
        F.when(F.size(extras) > 0, extras).alias("ext_forwarder"),
        F.when(get("$.position", "variant").isNull(), F.lit("failed to decode")).alias("decode_error"),
    )


def split_decoded(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good events, and failures with their adapter version only."""
    good = decoded.filter(F.col("decode_error").isNull()).drop("decode_error")
    bad = decoded.filter(F.col("decode_error").isNotNull()).select(
        F.lit("/").alias("path"),
        F.col("decode_error").alias("message"),
        F.col("quality.adapter_version").alias("adapter_version"),
        F.col("quality.raw_sha256").alias("raw_sha256"),
    )
    return good, bad
