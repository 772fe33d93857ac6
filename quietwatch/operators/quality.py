"""Data-quality measures with visible denominators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.ordered import HOT_ROWS, slice_hot_keys, with_running_max
from quietwatch.functions.percentiles import nearest_rank
from quietwatch.functions.scalars import ms, ratio, seconds_between

# Field groups, sleeping states and the limits behind each impossible-value kind.
FIELD_GROUPS = ("position", "motion", "power", "network", "device_time", "vendor_time")
SLEEPING = ("deep_sleep", "light_sleep")
BACKFILL_THRESHOLD_S = 900
MAX_SPEED_KPH = 400
MAX_EXTERNAL_V = 100


def asleep() -> Column:
    return F.coalesce(F.col("device.sleep_state").isin(*SLEEPING), F.lit(False))


def cohort_columns() -> list[Column]:
    """Model (NULL reads as ``unknown``), source and UTC day of receipt."""
    return [
        F.coalesce(F.col("device.model"), F.lit("unknown")).alias("model"),
        F.col("source"),
        F.to_date("received_at").alias("day"),
    ]


def presence(group: str) -> Column:
    """Whether an event carries a field group.

    The reader keeps an object with at least one key as a struct and an empty object as NULL, so a
    struct of NULL fields counts as present.
    """
    return {
        "position": F.col("position.lat").isNotNull(),
        "motion": F.col("motion").isNotNull(),
        "power": F.col("power").isNotNull(),
        "network": F.col("network").isNotNull(),
        "device_time": F.col("device_time").isNotNull(),
        "vendor_time": F.col("vendor_received_at").isNotNull(),
    }[group]


def completeness(events: DataFrame) -> DataFrame:
    """Presence per cohort and field group, with distinct devices behind every row.

    Sleeping devices are excluded from every group but ``device_time``.  The six groups are counted
    side by side and turned into rows afterwards, so the shuffle carries one row per cohort.
    """
    flags = events.select(
        *cohort_columns(),
        "device_ref",
        asleep().alias("_asleep"),
        *[presence(g).alias(f"_has_{g}") for g in FIELD_GROUPS],
    )
    counted = flags.groupBy("model", "source", "day").agg(
        F.count_distinct("device_ref").alias("device_count"),
        F.count(F.lit(1)).alias("_rows"),
        F.count_if("_asleep").alias("_asleep_rows"),
        *[
            F.count_if(F.col(f"_has_{g}") & (~F.col("_asleep") | F.lit(g == "device_time"))).alias(
                f"_num_{g}"
            )
            for g in FIELD_GROUPS
        ],
    )
    cells = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(g).alias("field_group"),
                    F.col(f"_num_{g}").alias("numerator"),
                    (F.lit(0).cast("bigint") if g == "device_time" else F.col("_asleep_rows")).alias(
                        "excluded"
                    ),
                )
                for g in FIELD_GROUPS
            ]
        )
    ).alias("cell")
    denominator = F.col("_rows") - F.col("cell.excluded")
    return counted.select("model", "source", "day", "device_count", "_rows", cells).select(
        "model",
        "source",
        "day",
        "device_count",
        "cell.field_group",
        denominator.alias("denominator"),
        F.col("cell.numerator").alias("numerator"),
        F.col("cell.excluded").alias("excluded"),
        F.when(
            F.col("cell.excluded") > 0, F.create_map(F.lit("device_asleep"), F.col("cell.excluded"))
        )
        .otherwise(F.create_map().cast("map<string,bigint>"))
        .alias("exclusion_reasons"),
        ratio(F.col("cell.numerator"), denominator).alias("completeness"),
    )


def _lags() -> list[Column]:
    return [
        F.struct(F.lit(name).alias("lag"), seconds_between(later, earlier).alias("seconds"))
        for name, later, earlier in (
            ("platform_lag_s", "received_at", "vendor_received_at"),
            ("total_lag_s", "received_at", "device_time"),
            ("device_to_vendor_lag_s", "vendor_received_at", "device_time"),
        )
    ]


def lag_percentiles(events: DataFrame) -> DataFrame:
    """One row per lag kind that was measurable at all."""
    rows = events.select(F.inline(F.array(*_lags()))).filter(F.col("seconds").isNotNull())
    return nearest_rank(rows, F.col("seconds"), ["lag"])


def timing_counts(events: DataFrame) -> DataFrame:
    """Counts that need no distribution: clocks ahead of receipt, and events without any lag."""
    ahead = seconds_between("received_at", "device_time") < 0
    return events.agg(
        F.count(F.lit(1)).alias("observation_count"),
        F.count_if(ahead).alias("negative_lag_count"),
        F.count_distinct(F.when(ahead, F.col("device_ref"))).alias("clock_skew_suspects"),
        F.count_if(F.col("device_time").isNull() & F.col("vendor_received_at").isNull()).alias(
            "insufficient_times"
        ),
    )


def clock_skew_suspects(events: DataFrame) -> DataFrame:
    """Devices whose clock ran ahead of receipt, one row each."""
    return (
        events.filter(seconds_between("received_at", "device_time") < 0)
        .select("device_ref")
        .distinct()
    )


def impossible_kinds() -> dict[str, Column]:
    lat, lon = F.col("position.lat"), F.col("position.lon")
    speed, volts = F.col("motion.speed_kph"), F.col("power.external_v")
    return {
        "position.lat_out_of_range": (lat < -90) | (lat > 90),
        "position.lon_out_of_range": (lon < -180) | (lon > 180),
        "position.null_island": (lat == 0) & (lon == 0),
        "motion.speed_implausible": (speed < 0) | (speed > MAX_SPEED_KPH),
        "power.external_v_sentinel": (volts < 0) | (volts > MAX_EXTERNAL_V),
    }


def impossible_values(events: DataFrame) -> DataFrame:
    """Count per impossible-value kind; kinds that never occur are absent."""
    kinds = impossible_kinds()
    counted = events.agg(*[F.count_if(c).alias(f"k{i}") for i, c in enumerate(kinds.values())])
    return counted.select(
        F.inline(
            F.array(
                *[
                    F.struct(F.lit(kind).alias("kind"), F.col(f"k{i}").alias("count"))
                    for i, kind in enumerate(kinds)
                ]
            )
        )
    ).filter(F.col("count") > 0)


def duplicate_identities(events: DataFrame) -> DataFrame:
    """Rows whose identity was seen before: all rows less the distinct identities."""
    identity = F.struct(
        F.col("source"),
        F.coalesce(F.col("event_identity.basis"), F.lit("?")),
        F.coalesce(F.col("event_identity.value"), F.lit("?")),
    )
    return events.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_distinct(identity).alias("_distinct"),
    ).select("total", (F.col("total") - F.col("_distinct")).alias("duplicate_identities"))


def out_of_order(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Events whose device time is below an earlier arrival of the same device."""
    timed = events.filter(F.col("device_time").isNotNull()).select(
        "device_ref",
        ms("received_at").alias("_received_ms"),
        "arrival",
        ms("device_time").alias("_device_ms"),
    )
    sliced = slice_hot_keys(
        timed, ["device_ref"], "_received_ms", ["_received_ms", "arrival"], hot_rows
    )
    seen = with_running_max(sliced, F.col("_device_ms"), "_highest", include_self=False)
    return seen.finished().agg(
        F.count_if(F.col("_device_ms") < F.col("_highest")).alias("out_of_order")
    )


def backfilled(events: DataFrame, threshold_s: int = BACKFILL_THRESHOLD_S) -> DataFrame:
    return events.agg(
        F.count_if(seconds_between("received_at", "device_time") > threshold_s).alias("backfilled")
    )


def integrity(
    events: DataFrame, threshold_s: int = BACKFILL_THRESHOLD_S, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Duplicates, ordering and backfill in one row (each input is itself one row)."""
    rates = [
        ratio(F.col(n), F.col("total")).alias(f"{r}_rate")
        for n, r in (
            ("duplicate_identities", "duplicate"),
            ("out_of_order", "out_of_order"),
            ("backfilled", "backfill"),
        )
    ]
    return (
        duplicate_identities(events)
        .join(out_of_order(events, hot_rows))
        .join(backfilled(events, threshold_s))
        .select("total", "duplicate_identities", "out_of_order", "backfilled", *rates)
    )


def platform_findings(destructive: DataFrame, retention: DataFrame) -> DataFrame:
    """Findings from platform settings: records destroyed on write, and short or unknown retention.

    ``destructive``: source, setting, effect, enabled, default_enabled.
    ``retention``: source, raw_days, customer_reducible, requested_days.
    """
    active = destructive.filter("enabled").select(
        F.lit("destructive_setting").alias("finding"),
        "source",
        "setting",
        F.lit(None).cast("boolean").alias("sufficient"),
        F.concat(
            "source",
            F.lit(": "),
            "setting",
            F.lit(" is destroying records before they can be exported"),
        ).alias("blocking"),
    )
    enough = F.col("raw_days") >= F.col("requested_days")
    windows = retention.select(
        F.lit("retention").alias("finding"),
        "source",
        F.lit(None).cast("string").alias("setting"),
        enough.alias("sufficient"),
        F.when(
            ~enough,
            F.concat(
                "source",
                F.lit(": raw retention is "),
                F.col("raw_days").cast("string"),
                F.lit(" days but the audit requests "),
                F.col("requested_days").cast("string"),
            ),
        )
        .when(
            F.col("raw_days").isNull(),
            F.concat(
                "source",
                F.lit(": raw retention window is undocumented and must be established"),
            ),
        )
        .alias("blocking"),
    )
    return active.unionByName(windows)
