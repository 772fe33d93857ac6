"""Effective-dated records: resolution at an instant, overlaps, gaps and coverage.

Intervals are half-open, ``valid_from <= t < valid_to``; a NULL ``valid_to`` is open-ended.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.ordered import HOT_ROWS, slice_hot_keys, with_last_seen, with_previous
from quietwatch.functions.scalars import ms
from quietwatch.operators import segments
from quietwatch.session import written

# Open end as milliseconds, beyond any timestamp Spark can hold in milliseconds.
OPEN_END_MS = 2**62

# Histories up to this many rows (some 50 MB) are broadcast as one array per key; larger ones are
# merged by time.
MAX_BROADCAST_RECORDS = 500_000

# Keys with up to this many intervals compare each of them with a row; longer histories go by time buckets.
MAX_COMPARED = 128

DAY_MS = 86_400_000
MONTH_MS = 30 * DAY_MS


def _bounds(from_col: str, to_col: str) -> tuple[Column, Column]:
    return ms(from_col), F.coalesce(ms(to_col), F.lit(OPEN_END_MS))


def well_formed(records: DataFrame, from_col: str = "valid_from", to_col: str = "valid_to") -> DataFrame:
    return records.filter(F.col(to_col).isNull() | (ms(from_col) < ms(to_col)))


def _is_small(records: DataFrame, limit: int) -> bool:
    return records.limit(limit + 1).count() <= limit


def resolve_at(
    probe: DataFrame,
    records: DataFrame,
    keys: Sequence[str],
    at: str,
    values: Sequence[str],
    record_id: str,
    from_col: str = "valid_from",
    to_col: str = "valid_to",
    max_broadcast: int = MAX_BROADCAST_RECORDS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Left as-of join: the record in force at ``at``, as a struct column ``resolved``.

    On overlap the latest ``valid_from`` wins, then the highest ``record_id``; no record gives NULL.
    A probe row with a NULL key or a NULL instant is kept and resolves to NULL, whatever the size of
    the history.
    The history is flattened to disjoint segments first.  If it is of checked size it is broadcast,
    each probe row searches the segments of its key, and the probe does not move.  A larger history is
    merged with the probe in time order: one shuffle, and the last segment seen is the answer.
    """
    start, end = _bounds(from_col, to_col)
    sound = (
        well_formed(records, from_col, to_col)
        .filter(F.col(from_col).isNotNull())
        .dropna(subset=list(keys))
        .select(
            *keys,
            start.alias(segments.START),
            end.alias(segments.END),
            F.col(record_id).alias(segments.ORDER),
            F.struct(*values).alias(segments.VALUE),
        )
    )
    small = _is_small(sound, max_broadcast)
    flat = segments.disjoint(sound, keys, hot_rows)
    if small:
        return look_up(probe, flat, keys, ms(at), "resolved")
    known = F.col(at).isNotNull()
    for key in keys:
        known = known & F.col(key).isNotNull()
    merged = merge_up(probe.filter(known), flat, keys, ms(at), "resolved", hot_rows)
    value_type = sound.schema[segments.VALUE].dataType
    aside = probe.filter(~known).withColumn("resolved", F.lit(None).cast(value_type))
    return merged.unionByName(aside)


def look_up(probe: DataFrame, flat: DataFrame, keys: Sequence[str], t: Column, name: str) -> DataFrame:
    """The segment value at ``t`` by a search in the broadcast segments; their size must be checked."""
    firsts, blocks = segments.searchable(flat, keys)
    return (
        probe.join(F.broadcast(firsts), list(keys), "left")
        .withColumn("_block", segments.block_at(t))
        .drop("_firsts")
        .join(F.broadcast(blocks), [*keys, "_block"], "left")
        .withColumn(name, segments.found_at(t))
        .select(*probe.columns, name)
    )


def merge_up(
    probe: DataFrame, flat: DataFrame, keys: Sequence[str], t: Column, name: str, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """The segment value at ``t`` by one merge of probe rows and segments in time order."""
    rows = probe.select(
        *keys,
        t.alias("_t"),
        F.lit(1).alias("_side"),
        F.struct(*[F.col(c) for c in probe.columns if c not in keys]).alias("_row"),
        F.lit(None).cast("bigint").alias(segments.TO),
        F.lit(None).cast(flat.schema[segments.VALUE].dataType).alias(segments.VALUE),
    )
    starts = flat.select(
        *keys,
        F.col(segments.FROM).alias("_t"),
        F.lit(0).alias("_side"),
        F.lit(None).cast(rows.schema["_row"].dataType).alias("_row"),
        segments.TO,
        segments.VALUE,
    )
    sliced = slice_hot_keys(starts.unionByName(rows), keys, "_t", ["_t", "_side"], hot_rows)
    segment = F.when(F.col("_side") == 0, F.struct(segments.TO, segments.VALUE))
    found = with_last_seen(sliced, segment, "_latest").finished().filter(F.col("_side") == 1)
    value = F.when(F.col("_t") < F.col(f"_latest.{segments.TO}"), F.col(f"_latest.{segments.VALUE}"))
    return found.select(*keys, "_row.*", value.alias(name)).select(*probe.columns, name)


def resolve_device(
    probe: DataFrame,
    asset_device: DataFrame,
    device_sim: DataFrame,
    at: str,
    max_broadcast: int = MAX_BROADCAST_RECORDS,
) -> DataFrame:
    """Asset, role, installer, SIM and provider of a device at an instant.

    The SIM side is only reported where an assignment resolves.
    """
    placed = resolve_at(
        probe,
        asset_device,
        ["device_ref"],
        at,
        ["asset_ref", "role", "installer_ref"],
        "record_id",
        max_broadcast=max_broadcast,
    ).withColumnRenamed("resolved", "assignment")
    carried = resolve_at(
        placed,
        device_sim,
        ["device_ref"],
        at,
        ["sim_ref", "provider_ref"],
        "record_id",
        max_broadcast=max_broadcast,
    )
    return carried.withColumn(
        "sim", F.when(F.col("assignment").isNotNull(), F.col("resolved"))
    ).drop("resolved")


def _by_history(rows: DataFrame, intervals: DataFrame, key: str, by_key, by_bucket, max_compared: int) -> DataFrame:
    """Rows beside the intervals of their key: by the key alone, or by time buckets where a history is long."""
    counts = intervals.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    long = counts.filter((F.col("_n") > max_compared) & F.col(key).isNotNull()).drop("_n")
    if long.isEmpty():
        return by_key(rows, intervals)
    short = by_key(rows.join(long, key, "left_anti"), intervals.join(long, key, "left_anti"))
    bucketed = by_bucket(rows.join(long, key, "left_semi"), intervals.join(long, key, "left_semi"))
    return short.unionByName(bucketed, allowMissingColumns=True)


def resolve_asset(
    probe: DataFrame,
    asset_device: DataFrame,
    device_sim: DataFrame,
    at: str,
    bucket_ms: int = MONTH_MS,
    max_broadcast: int = MAX_BROADCAST_RECORDS,
    max_compared: int = MAX_COMPARED,
) -> DataFrame:
    """Every device on an asset at an instant, with its own resolution; primary sorts first.

    The answer may hold several devices per instant.  An asset of up to ``max_compared`` assignments meets them by
    its name alone; the intervals of longer histories are exploded into time buckets and joined on
    ``(asset_ref, bucket)``.
    """
    start, end = _bounds("valid_from", "valid_to")
    keyed = probe.withColumn("_t", ms(at))
    placed = well_formed(asset_device).select(
        "asset_ref", "device_ref", start.alias("_start"), end.alias("_end")
    )
    holds = (F.col("_start") <= F.col("_t")) & (F.col("_t") < F.col("_end"))

    def by_bucket(asked: DataFrame, intervals: DataFrame) -> DataFrame:
        horizon = asked.agg(F.max("_t").alias("_horizon"))
        last = F.greatest("_start", F.least(F.col("_end") - 1, F.col("_horizon")))
        spanned = F.sequence(F.floor(F.col("_start") / bucket_ms), F.floor(last / bucket_ms))
        pieces = intervals.join(F.broadcast(horizon)).withColumn("_bucket", F.explode(spanned)).drop("_horizon")
        return asked.withColumn("_bucket", F.floor(F.col("_t") / bucket_ms)).join(pieces, ["asset_ref", "_bucket"])

    on_asset = (
        _by_history(keyed, placed, "asset_ref", lambda a, b: a.join(b, "asset_ref"), by_bucket, max_compared)
        .filter(holds)
        .drop("_bucket", "_start", "_end", "_t")
    )
    resolved = resolve_device(
        on_asset.withColumnRenamed("asset_ref", "queried_asset_ref"),
        asset_device,
        device_sim,
        at,
        max_broadcast,
    )
    return resolved.withColumn(
        "role_rank", F.when(F.col("assignment.role") == "primary", 0).otherwise(1)
    )


def overlapping_pairs(
    records: DataFrame,
    key: str,
    record_id: str,
    from_col: str = "valid_from",
    to_col: str = "valid_to",
    bucket_ms: int = MONTH_MS,
    max_compared: int = MAX_COMPARED,
) -> DataFrame:
    """Pairs of sound records of one key that overlap, earlier start first.

    The later record starts inside the earlier one.  A key of up to ``max_compared`` records compares them by the
    key alone; in longer histories starts are matched with the time buckets the earlier interval spans: work
    follows the overlaps found, not the square of the history.
    """
    start, end = _bounds(from_col, to_col)
    sound = (
        well_formed(records, from_col, to_col)
        .select(F.col(key).alias("key"), F.col(record_id).alias("id"), start.alias("s"), end.alias("e"))
        .filter(F.col("s").isNotNull())
    )

    def earlier(rows: DataFrame) -> DataFrame:
        return rows.withColumnsRenamed({"id": "earlier_id", "s": "_as", "e": "_ae"})

    def by_bucket(rows: DataFrame, others: DataFrame) -> DataFrame:
        horizon = rows.agg(F.max("s").alias("_h"))
        last = F.greatest("_as", F.least(F.col("_ae") - 1, F.col("_h")))
        spanned = F.sequence(F.floor(F.col("_as") / bucket_ms), F.floor(last / bucket_ms))
        spans = earlier(others).join(F.broadcast(horizon)).withColumn("_bucket", F.explode(spanned)).drop("_h")
        return rows.withColumn("_bucket", F.floor(F.col("s") / bucket_ms)).join(spans, ["key", "_bucket"]).drop("_bucket")

    return (
        _by_history(sound, sound, "key", lambda a, b: a.join(earlier(b), "key"), by_bucket, max_compared)
        .filter(
            (F.struct("_as", "earlier_id") < F.struct("s", F.col("id")))
            & (F.col("s") < F.col("_ae"))
        )
        .select("key", "earlier_id", F.col("id").alias("later_id"))
    )


def history_gaps(
    records: DataFrame,
    key: str,
    record_id: str,
    from_col: str = "valid_from",
    to_col: str = "valid_to",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Uncovered spans between consecutive sound records of one key."""
    sound = well_formed(records, from_col, to_col).select(
        F.col(key).alias("key"),
        ms(from_col).alias("_s"),
        F.col(record_id).alias("id"),
        ms(to_col).alias("_e"),
    )
    sliced = slice_hot_keys(sound, ["key"], "_s", ["_s", "id"], hot_rows)
    paired = with_previous(sliced, F.struct("id", "_e"), "_prev").finished()
    return paired.filter(F.col("_prev._e") < F.col("_s")).select(
        "key",
        F.col("_prev.id").alias("earlier_id"),
        F.col("id").alias("later_id"),
        F.col("_prev._e").alias("from_ms"),
        F.col("_s").alias("to_ms"),
    )


def malformed(
    records: DataFrame,
    key: str,
    record_id: str,
    from_col: str = "valid_from",
    to_col: str = "valid_to",
) -> DataFrame:
    """Zero-length and inverted intervals."""
    return records.filter(ms(to_col) <= ms(from_col)).select(
        F.col(key).alias("key"), F.col(record_id).alias("id")
    )


def _defects(records: DataFrame, key: str, record_id: str, with_gaps: bool) -> DataFrame:
    none = F.lit(None).cast("bigint")
    id_type = records.schema[record_id].dataType
    bad = malformed(records, key, record_id).select(
        "key",
        F.lit("malformed").alias("kind"),
        F.col("id").alias("earlier_id"),
        F.lit(None).cast(id_type).alias("later_id"),
        none.alias("from_ms"),
        none.alias("to_ms"),
    )
    pairs = overlapping_pairs(records, key, record_id).select(
        "key",
        F.lit("overlap").alias("kind"),
        "earlier_id",
        "later_id",
        none.alias("from_ms"),
        none.alias("to_ms"),
    )
    found = bad.unionByName(pairs)
    if with_gaps:
        found = found.unionByName(
            history_gaps(records, key, record_id).withColumn("kind", F.lit("gap"))
        )
    return found


def assignment_defects(asset_device: DataFrame, device_sim: DataFrame) -> DataFrame:
    """Defects by key family; a gap only counts for an asset and role."""
    by_device = asset_device.withColumn("_key", F.concat(F.lit("device:"), "device_ref"))
    by_role = asset_device.withColumn(
        "_key", F.concat(F.lit("asset:"), "asset_ref", F.lit(":"), "role")
    )
    by_sim = device_sim.withColumn("_key", F.concat(F.lit("device-sim:"), "device_ref"))
    return (
        _defects(by_device, "_key", "record_id", False)
        .unionByName(_defects(by_role, "_key", "record_id", True))
        .unionByName(_defects(by_sim, "_key", "record_id", False))
    )


def coverage(resolved: DataFrame, column: str = "resolved") -> DataFrame:
    """Share of observations with an effective record; 1 when there are none."""
    hit = F.col(column).isNotNull().cast("double")
    return resolved.agg(
        F.count(F.lit(1)).alias("observations"),
        F.coalesce(F.avg(hit), F.lit(1.0)).alias("coverage"),
        F.count_distinct(F.when(F.col(column).isNull(), F.col("device_ref"))).alias(
            "unmapped_device_count"
        ),
    )


def unmapped_devices(resolved: DataFrame, column: str = "resolved") -> DataFrame:
    return resolved.filter(F.col(column).isNull()).select("device_ref").distinct()


def policy_at(
    events: DataFrame, policies: DataFrame, cohort: str, at: str, max_broadcast: int = MAX_BROADCAST_RECORDS
) -> DataFrame:
    """The policy in force for a cohort at event time, as a struct column ``policy``."""
    from quietwatch.operators.policy import MOTION_STATES

    keyed = policies.withColumnRenamed("cohort", cohort)
    return resolve_at(
        events,
        keyed,
        [cohort],
        at,
        [*MOTION_STATES, "provenance", "grace_factor", "version"],
        "version",
        max_broadcast=max_broadcast,
    ).withColumnRenamed("resolved", "policy")
