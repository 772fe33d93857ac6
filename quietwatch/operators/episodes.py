"""Episode sampling: bounded intervals with a type, never a cause."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.functions.ordered import (
    HOT_ROWS,
    SLICE,
    Sliced,
    prefix_states,
    slice_hot_keys,
    with_all_true,
    with_last_seen,
    with_previous,
)
from quietwatch.functions.percentiles import nearest_rank_struct
from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators.policy import (
    ReportingPolicy,
    deadline_ms,
    interval_for,
    motion_state,
    suppressed_by,
    weak_basis,
)
from quietwatch.operators.quality import BACKFILL_THRESHOLD_S

# The four observable shapes of a gap.
EPISODE_TYPES = ("total_silence", "gnss_only_loss", "stale_position", "vendor_ingestion_delay")
STALE_AFTER_REPORTS = 3

# Symbols of the unchanged-position fold.
_MOVED, _SAME, _SAME_READY = 0, 1, 2


def _report_struct() -> Column:
    return F.struct(
        F.col("_received_ms").alias("received_ms"),
        F.col("_device_ms").alias("device_ms"),
        F.col("_state").alias("state"),
        F.col("_lat").alias("lat"),
        F.col("_lon").alias("lon"),
        F.col("_policy").alias("policy"),
    )


def pair_reports(
    events: DataFrame, policy: ReportingPolicy | Column, hot_rows: int = HOT_ROWS
) -> Sliced:
    """Each report beside the previous one of its device, on the device's clock basis.

    A device clock is usable when every report has one and it never falls in receipt order.  Then
    device order *is* receipt order, so one ordering serves both bases and the events shuffle once.
    """
    chosen = policy.column() if isinstance(policy, ReportingPolicy) else policy
    reports = events.select(
        "device_ref",
        ms("received_at").alias("_received_ms"),
        F.col("arrival").alias("_arrival"),
        ms("device_time").alias("_device_ms"),
        motion_state().alias("_state"),
        F.col("position").isNotNull().alias("_has_position"),
        F.col("position.lat").alias("_lat"),
        F.col("position.lon").alias("_lon"),
        F.col("position.valid").alias("_valid"),
        chosen.alias("_policy"),
    )
    sliced = slice_hot_keys(
        reports, ["device_ref"], "_received_ms", ["_received_ms", "_arrival"], hot_rows
    )
    sliced = with_previous(sliced, _report_struct(), "_prev")
    steady = F.col("_device_ms").isNotNull() & F.coalesce(
        F.col("_device_ms") >= F.col("_prev.device_ms"), F.col("_prev").isNull()
    )
    sliced = with_all_true(sliced, steady, "_device_clock")
    at = F.when(F.col("_device_clock"), F.col("_device_ms")).otherwise(F.col("_received_ms"))
    before = F.when(F.col("_device_clock"), F.col("_prev.device_ms")).otherwise(
        F.col("_prev.received_ms")
    )
    return sliced.with_rows(
        sliced.rows.withColumns(
            {
                "_at": at,
                "_before": before,
                "_interval": interval_for(F.col("_prev.policy"), F.col("_prev.state")),
            }
        )
    )


def clock_basis(events: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The clock each device is measured on."""
    paired = pair_reports(events, ReportingPolicy(), hot_rows).finished()
    return paired.groupBy("device_ref").agg(
        F.when(F.bool_and("_device_clock"), F.lit("device_time"))
        .otherwise(F.lit("received_at"))
        .alias("clock_basis")
    )


def _step(state: Column, symbol: Column, limit: int) -> Column:
    """Unchanged-run length after a pair; the counter is capped because only ``limit`` matters."""
    longer = F.least(state + 1, F.lit(limit))
    return (
        F.when(symbol == _MOVED, F.lit(0))
        .when((symbol == _SAME_READY) & (longer >= limit), F.lit(0))
        .otherwise(longer)
    )


def _entry_states(sliced: Sliced, limit: int) -> DataFrame:
    """Run length at the start of every slice of a hot device.

    A slice acts on the run length as a function of ``limit + 1`` values; composing those small
    functions along the device replaces one long fold.
    """
    codes = F.transform(
        F.array_sort(F.collect_list(F.struct("_received_ms", "_arrival", "_symbol"))),
        lambda r: r["_symbol"],
    )
    effects = (
        sliced.hot_rows()
        .groupBy(*sliced.keys, SLICE)
        .agg(codes.alias("_codes"))
        .withColumn(
            "_effect",
            F.array(
                *[
                    F.aggregate(
                        "_codes", F.lit(start), lambda s, c: _step(s, c, limit).cast("int")
                    )
                    for start in range(limit + 1)
                ]
            ),
        )
        .groupBy(*sliced.keys)
        .agg(F.array_sort(F.collect_list(F.struct(SLICE, "_effect"))).alias("_slices"))
    )
    states = prefix_states(
        F.col("_slices"), F.lit(0), lambda state, s: F.get(s["_effect"], state), chunk=512
    )
    return effects.select(
        *sliced.keys,
        F.inline(
            F.zip_with(
                "_slices",
                states,
                lambda s, state: F.struct(s[SLICE].alias(SLICE), state.alias("_entry")),
            )
        ),
    )


def _sample(kind: Column, missed: Column) -> list[Column]:
    return [
        F.col("device_ref"),
        kind.alias("type"),
        from_ms("_before").alias("start_at"),
        from_ms("_at").alias("end_at"),
        ((F.col("_at") - F.col("_before")) / F.lit(1000.0)).alias("duration_s"),
        F.when(F.col("_device_clock"), F.lit("device_time"))
        .otherwise(F.lit("received_at"))
        .alias("clock_basis"),
        F.col("_interval").alias("expected_interval_s"),
        missed.cast("bigint").alias("missed_reports"),
        F.col("_policy_version").alias("policy_version"),
        F.col("_weak").alias("weak_basis"),
        F.col("_gap_state").alias("state_at_gap"),
    ]


def _with_stale_hits(sliced: Sliced, limit: int, gap: Column | None = None) -> DataFrame:
    """Islands of unchanged position with ``_hits``, the stale samples they emit, and ``_gaps``.

    Runs are islands between position changes; each island folds on its own, and only an island
    that continues over a slice border of a hot device needs the state carried into the slice.
    ``gap`` is a sample struct (NULL where a pair is no gap) gathered in the same pass, so that the
    events are shuffled and sorted once.
    """
    moved = F.col("_symbol") == _MOVED
    rows = sliced.rows.withColumn(
        "_island", F.sum(F.when(moved, 1).otherwise(0)).over(sliced.window)
    )
    stale = F.struct(*_sample(F.lit("stale_position"), F.lit(0)))
    item = F.struct("_received_ms", "_arrival", "_symbol", stale.alias("sample"))
    gap = F.lit(None).cast("string") if gap is None else gap
    islands = (
        rows.groupBy(*sliced.keys, SLICE, "_island")
        .agg(
            F.array_sort(F.collect_list(F.when(~moved, item))).alias("_run"),
            F.collect_list(gap).alias("_gaps"),
        )
        .withColumn("_entry", F.lit(0))
    )
    if sliced.has_hot:
        entries = _entry_states(sliced, limit).withColumn("_island", F.lit(0).cast("bigint"))
        islands = (
            sliced.join_side(entries, [*sliced.keys, SLICE, "_island"], islands.drop("_entry"))
            .withColumn("_entry", F.coalesce("_entry", F.lit(0)))
        )
    symbols = F.transform("_run", lambda r: r["_symbol"])
    before = prefix_states(symbols, F.col("_entry"), lambda s, c: _step(s, c, limit))
    marked = F.zip_with("_run", before, lambda r, s: F.struct(r.alias("r"), s.alias("s")))
    hits = F.transform(
        F.filter(marked, lambda m: (m["r"]["_symbol"] == _SAME_READY) & (m["s"] + 1 >= limit)),
        lambda m: m["r"]["sample"],
    )
    # A run too short to reach the limit emits nothing, whatever its symbols are.
    long_enough = F.size("_run") + F.col("_entry") >= limit
    return islands.withColumn("_hits", F.when(long_enough, hits))


def stale_pairs(sliced: Sliced, limit: int = STALE_AFTER_REPORTS) -> DataFrame:
    """Samples at which an unchanged, valid, on-time position run reaches ``limit`` and restarts."""
    return _with_stale_hits(sliced, limit).select(F.inline("_hits"))


def judge_pairs(
    sliced: Sliced, lag_p95_s: float = 0.0, backfill_threshold_s: int = BACKFILL_THRESHOLD_S
) -> Sliced:
    """Add lateness, the fold symbol and the platform-held test to paired reports."""
    grace, provenance = F.col("_prev.policy.grace_factor"), F.col("_prev.policy.provenance")
    late = F.col("_at") > deadline_ms(F.col("_before"), F.col("_interval"), grace, lag_p95_s)
    unchanged = (
        F.col("_prev.lat").isNotNull()
        & F.coalesce(F.col("_prev.lat") == F.col("_lat"), F.lit(False))
        & F.col("_prev.lon").eqNullSafe(F.col("_lon"))
    )
    held = F.coalesce(
        (F.col("_received_ms") - F.col("_device_ms")) / F.lit(1000.0) > backfill_threshold_s,
        F.lit(False),
    )
    rows = sliced.rows.withColumns(
        {
            "_late": F.coalesce(late, F.lit(False)),
            "_policy_version": F.col("_prev.policy.version"),
            "_weak": weak_basis(F.col("_prev.state"), provenance),
            "_gap_state": F.col("_prev.state"),
            "_held": held,
        }
    ).withColumn(
        "_symbol",
        F.when(F.col("_prev").isNull() | ~unchanged, F.lit(_MOVED))
        .when(~F.col("_late") & F.coalesce(F.col("_valid"), F.lit(False)), F.lit(_SAME_READY))
        .otherwise(F.lit(_SAME)),
    )
    return sliced.with_rows(rows)


def sample_episodes(
    events: DataFrame,
    policy: ReportingPolicy | Column,
    lag_p95_s: float = 0.0,
    windows: DataFrame | None = None,
    backfill_threshold_s: int = BACKFILL_THRESHOLD_S,
    stale_after: int = STALE_AFTER_REPORTS,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Episodes of every device.

    ``policy`` is one policy for the run, or a struct column already resolved per event (see
    ``policy_struct``), in which case the policy of the earlier report governs the gap.
    """
    judged = judge_pairs(
        pair_reports(events, policy, hot_rows), lag_p95_s, backfill_threshold_s
    )
    gap_s = (F.col("_at") - F.col("_before")) / F.lit(1000.0)
    missed = F.greatest(F.lit(1), F.floor(gap_s / F.col("_interval")) - 1)
    lost_fix = F.col("_has_position") & (F.col("_valid") == F.lit(False))
    kind = (
        F.when(F.col("_prev").isNull(), F.lit(None))
        .when(F.col("_late") & F.col("_held"), F.lit("vendor_ingestion_delay"))
        .when(F.col("_late"), F.lit("total_silence"))
        .when(lost_fix, F.lit("gnss_only_loss"))
    )
    gap = F.when(
        kind.isNotNull(),
        F.struct(*_sample(kind, F.when(F.col("_late"), missed).otherwise(F.lit(0)))),
    )
    islands = _with_stale_hits(judged, stale_after, gap)
    none_stale = F.expr("slice(_gaps, 1, 0)")
    episodes = islands.select(F.inline(F.concat("_gaps", F.coalesce("_hits", none_stale))))
    if windows is None:
        return episodes.withColumn("suppressed_by", F.lit(None).cast("string"))
    real = F.col("type").isin("total_silence", "vendor_ingestion_delay")
    return (
        suppressed_by(episodes, "start_at", windows, "_reason")
        .withColumn("suppressed_by", F.when(real, F.col("_reason")))
        .drop("_reason")
    )


def summarise_episodes(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """One row: totals by type (zero-filled), suppressed, weak basis and the device denominator."""
    counts = episodes.agg(
        F.count(F.lit(1)).alias("episode_count"),
        *[F.count_if(F.col("type") == t).alias(t) for t in EPISODE_TYPES],
        F.count_if(F.col("suppressed_by").isNotNull()).alias("suppressed_count"),
        F.count_if("weak_basis").alias("weak_basis_count"),
        F.count_distinct("device_ref").alias("devices_with_episodes"),
    )
    observed = events.agg(F.count_distinct("device_ref").alias("devices_observed"))
    durations = nearest_rank_struct(episodes, F.col("duration_s"), bucket_width=3600.0)
    return (
        counts.join(observed)
        .join(durations)
        .withColumnRenamed("percentiles", "duration_s")
    )


def trailing_silence(
    events: DataFrame,
    policy: ReportingPolicy | Column,
    now_ms: Column,
    lag_p95_s: float = 0.0,
) -> DataFrame:
    """Open-ended episodes: devices whose deadline after the last report has passed.

    The last report is an aggregate, so a device with very many reports is reduced before it moves.
    """
    chosen = policy.column() if isinstance(policy, ReportingPolicy) else policy
    last = (
        events.select(
            "device_ref",
            ms(F.coalesce("device_time", "received_at")).alias("_at"),
            F.struct(ms("received_at").alias("received_ms"), "arrival").alias("_order"),
            F.struct(motion_state().alias("state"), chosen.alias("policy")).alias("_last"),
            F.col("device_time").isNotNull().alias("_device_clock"),
        )
        .groupBy("device_ref")
        .agg(
            F.max_by(
                F.struct("_at", "_last", "_device_clock"), F.col("_order")
            ).alias("_r")
        )
        .select("device_ref", "_r.*")
    )
    interval = interval_for(F.col("_last.policy"), F.col("_last.state"))
    return (
        last.withColumn("_interval", interval)
        .withColumn(
            "_deadline",
            deadline_ms(F.col("_at"), F.col("_interval"), F.col("_last.policy.grace_factor"), lag_p95_s),
        )
        .filter(F.col("_deadline") < now_ms)
        .select(
            "device_ref",
            F.lit("total_silence").alias("type"),
            from_ms("_at").alias("start_at"),
            F.lit(None).cast("timestamp").alias("end_at"),
            F.lit(None).cast("double").alias("duration_s"),
            F.when(F.col("_device_clock"), F.lit("device_time"))
            .otherwise(F.lit("received_at"))
            .alias("clock_basis"),
            F.col("_interval").alias("expected_interval_s"),
            F.lit(1).cast("bigint").alias("missed_reports"),
            F.col("_last.policy.version").alias("policy_version"),
            weak_basis(F.col("_last.state"), F.col("_last.policy.provenance")).alias("weak_basis"),
            F.col("_last.state").alias("state_at_gap"),
            from_ms("_deadline").alias("deadline_at"),
        )
    )


def with_episode_id(episodes: DataFrame) -> DataFrame:
    """A deterministic id from device, type and start."""
    return episodes.withColumn(
        "episode_id",
        F.concat(
            F.lit("ep_"),
            F.substring(
                F.sha2(
                    F.concat_ws("|", "device_ref", "type", ms("start_at").cast("string")), 256
                ),
                1,
                16,
            ),
        ),
    )


def last_and_next_fix(episodes: DataFrame, events: DataFrame) -> DataFrame:
    """Last valid fix at or before the gap and first valid fix at or after it.

    Only closed episodes have both sides.  The fixes are laid beside the episode borders of the
    same device in time order, so no episode is paired with every event of its device.
    """
    fix = F.struct(
        ms(F.coalesce("device_time", "received_at")).alias("at_ms"),
        F.col("position.lat").alias("lat"),
        F.col("position.lon").alias("lon"),
    )
    usable = (
        F.col("position.valid")
        & F.col("position.lat").isNotNull()
        & F.col("position.lon").isNotNull()
    )
    fixes = events.filter(usable).select(
        "device_ref",
        ms(F.coalesce("device_time", "received_at")).alias("_t"),
        fix.alias("_fix"),
        F.lit(None).cast("string").alias("episode_id"),
        F.col("arrival").alias("_tie"),
    )
    closed = episodes.filter(F.col("end_at").isNotNull())

    def borders(column: str) -> DataFrame:
        return closed.select(
            "device_ref",
            ms(column).alias("_t"),
            F.lit(None).cast(fixes.schema["_fix"].dataType).alias("_fix"),
            "episode_id",
            F.lit(0).cast("bigint").alias("_tie"),
        )

    def seek(column: str, backwards: bool) -> DataFrame:
        sign = -1 if backwards else 1
        both = (
            fixes.unionByName(borders(column))
            .withColumn("_k", F.col("_t") * sign)
            .withColumn("_probe", F.when(F.col("episode_id").isNotNull(), 1).otherwise(0))
            .withColumn("_seq", F.col("_tie") * sign)
        )
        sliced = slice_hot_keys(both, ["device_ref"], "_k", ["_k", "_probe", "_seq"])
        found = with_last_seen(sliced, F.col("_fix"), "_found").finished()
        return found.filter(F.col("episode_id").isNotNull()).select(
            "episode_id", F.col("_found").alias("next_fix" if backwards else "last_fix")
        )

    return (
        closed.select("episode_id", "device_ref")
        .join(seek("start_at", False), "episode_id", "left")
        .join(seek("end_at", True), "episode_id", "left")
    )
