"""Episode versions, late data and permitted transitions as set operations.

An episode is its version rows.  Nothing is updated: every operator returns rows to append to the
version table, and the current row is the one with the highest version.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quietwatch.functions.scalars import ms

# Permitted transitions.
ALLOWED_TRANSITIONS = {
    "provisional": ("monitoring", "review_required", "retracted"),
    "monitoring": ("review_required", "classified", "retracted"),
    "review_required": ("classified", "monitoring", "retracted"),
    "classified": ("action_open", "resolved", "classified"),
    "action_open": ("resolved", "classified"),
    "resolved": ("classified",),
    "retracted": ("classified",),
}

VERSION_COLUMNS = (
    "episode_id",
    "device_ref",
    "version",
    "state",
    "type",
    "start_at",
    "end_at",
    "cause",
    "actor",
    "reason",
    "at",
    "supersedes",
    "clock_basis",
    "policy_version",
    "finalisation_watermark_at",
)


def transition_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(a, b) for a, targets in ALLOWED_TRANSITIONS.items() for b in targets],
        "from_state string, to_state string",
    )


def transition_allowed(from_state: Column, to_state: Column) -> Column:
    """The edge table as an expression, so checking a transition needs no join."""
    checks = [
        (from_state == a) & to_state.isin(*targets) for a, targets in ALLOWED_TRANSITIONS.items()
    ]
    allowed = checks[0]
    for check in checks[1:]:
        allowed = allowed | check
    return F.coalesce(allowed, F.lit(False))


def open_episodes(
    samples: DataFrame, finalise_after_s: int, actor: str = "system:sampler"
) -> DataFrame:
    """First version of every sampled episode: provisional, without an end."""
    return samples.select(
        "episode_id",
        "device_ref",
        F.lit(1).cast("bigint").alias("version"),
        F.lit("provisional").alias("state"),
        "type",
        "start_at",
        F.lit(None).cast("timestamp").alias("end_at"),
        F.lit("opened").alias("cause"),
        F.lit(actor).alias("actor"),
        F.concat(
            F.lit("expected report did not arrive, missed "), F.col("missed_reports").cast("string")
        ).alias("reason"),
        F.col("start_at").alias("at"),
        F.lit(None).cast("bigint").alias("supersedes"),
        "clock_basis",
        "policy_version",
        F.timestamp_millis(ms("start_at") + F.lit(finalise_after_s * 1000)).alias(
            "finalisation_watermark_at"
        ),
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """The last version of every episode, with the number of versions behind it."""
    rest = F.struct(*[c for c in versions.columns if c != "episode_id"])
    return (
        versions.groupBy("episode_id")
        .agg(
            F.max_by(rest, "version").alias("_v"),
            F.count(F.lit(1)).alias("version_count"),
        )
        .select("episode_id", "_v.*", "version_count")
    )


def requires_approval(now: Column, action_count: Column) -> Column:
    """Finalised and acted upon; time alone does not lock an episode."""
    return (ms(now) >= ms("finalisation_watermark_at")) & (F.coalesce(action_count, F.lit(0)) > 0)


def apply_transitions(current: DataFrame, requests: DataFrame, actions: DataFrame, now: Column) -> DataFrame:
    """Judge each request and build the version row it would append.

    ``requests``: episode_id, to_state, cause, actor, reason, at, and optionally new_type, new_end_at,
    set_end (whether new_end_at replaces the end) and approved_by.
    ``actions``: episode_id per recorded action.
    Returns the new version columns plus ``status``: applied, illegal or approval_required.
    """
    optional = {
        "new_type": "string",
        "new_end_at": "timestamp",
        "set_end": "boolean",
        "approved_by": "string",
    }
    for name, kind in optional.items():
        if name not in requests.columns:
            requests = requests.withColumn(name, F.lit(None).cast(kind))
    counted = actions.groupBy("episode_id").agg(F.count(F.lit(1)).alias("_actions"))
    r = requests.select(
        "episode_id",
        *[
            F.col(c).alias(f"_r_{c}")
            for c in ("to_state", "cause", "actor", "reason", "at", *optional)
        ],
    )
    joined = r.join(current, "episode_id").join(counted, "episode_id", "left")
    approved = F.col("_r_approved_by").isNotNull()
    reopening = approved & F.col("state").isin("resolved", "retracted")
    status = (
        F.when(~transition_allowed(F.col("state"), F.col("_r_to_state")), F.lit("illegal"))
        .when(
            F.coalesce(requires_approval(now, F.col("_actions")), F.lit(False)) & ~approved,
            F.lit("approval_required"),
        )
        .otherwise(F.lit("applied"))
    )
    return joined.select(
        "episode_id",
        "device_ref",
        (F.col("version") + 1).alias("version"),
        F.col("_r_to_state").alias("state"),
        F.coalesce("_r_new_type", "type").alias("type"),
        "start_at",
        F.when(F.coalesce("_r_set_end", F.lit(False)), F.col("_r_new_end_at"))
        .otherwise(F.col("end_at"))
        .alias("end_at"),
        F.when(reopening, F.lit("controlled_reopening")).otherwise(F.col("_r_cause")).alias("cause"),
        F.when(reopening, F.col("_r_approved_by")).otherwise(F.col("_r_actor")).alias("actor"),
        F.when(
            reopening,
            F.concat(
                "_r_reason", F.lit(" (controlled reopening approved by "), "_r_approved_by", F.lit(")")
            ),
        )
        .when(approved, F.concat("_r_reason", F.lit(" (approved by "), "_r_approved_by", F.lit(")")))
        .otherwise(F.col("_r_reason"))
        .alias("reason"),
        F.col("_r_at").alias("at"),
        F.col("version").alias("supersedes"),
        "clock_basis",
        "policy_version",
        "finalisation_watermark_at",
        F.col("state").alias("from_state"),
        status.alias("status"),
    )


def confirms_recovery(valid_count: Column, span_ms: Column, required: Column, interval_s: Column) -> Column:
    """Enough valid reports, and they span a full expected interval."""
    return F.coalesce(
        (valid_count >= required) & (span_ms >= interval_s * F.lit(1000.0)), F.lit(False)
    )


def recovery_confirmation(reports: DataFrame, required: int, interval_s: float) -> DataFrame:
    """Per episode: whether its late reports confirm recovery."""
    t = F.when(F.col("valid"), ms("at"))
    return reports.groupBy("episode_id").agg(
        F.count_if("valid").alias("valid_reports"),
        (F.max(t) - F.min(t)).alias("span_ms"),
    ).withColumn(
        "confirmed",
        confirms_recovery(
            F.col("valid_reports"), F.col("span_ms"), F.lit(required), F.lit(float(interval_s))
        ),
    )


def late_data_verdicts(
    current: DataFrame, reports: DataFrame, required: int = 3, interval_s: float | str = 300.0
) -> DataFrame:
    """What late reports do to each episode.

    ``reports``: episode_id, at, valid.  ``interval_s`` is a number or a column of ``current``.
    Reports are reduced per episode by counts, minima and maxima only, so an episode with a great
    many reports shrinks before the shuffle.
    """
    interval = F.col(interval_s) if isinstance(interval_s, str) else F.lit(float(interval_s))
    bounds = current.select(
        "episode_id",
        ms("start_at").alias("_start"),
        ms("end_at").alias("_end"),
        interval.alias("_interval"),
    )
    t = F.col("_t")
    inside = (t > F.col("_start")) & (F.col("_end").isNull() | (t < F.col("_end")))
    after = F.coalesce(t >= F.col("_end"), F.lit(False))
    valid = F.coalesce("valid", F.lit(False))

    def summary(prefix: str, part: Column) -> list[Column]:
        sound = F.when(part & valid, t)
        return [
            F.count_if(part).alias(f"{prefix}_n"),
            F.count_if(part & valid).alias(f"{prefix}_valid"),
            F.min(F.when(part, t)).alias(f"{prefix}_first"),
            F.max(F.when(part, t)).alias(f"{prefix}_last"),
            F.min(sound).alias(f"{prefix}_first_valid"),
            F.max(sound).alias(f"{prefix}_last_valid"),
        ]

    reduced = (
        reports.select("episode_id", ms("at").alias("_t"), "valid")
        .join(bounds, "episode_id")
        .groupBy("episode_id")
        .agg(*summary("in", inside), *summary("after", after))
    )
    joined = bounds.join(reduced, "episode_id", "left")

    def confirmed(prefix: str) -> Column:
        return confirms_recovery(
            F.col(f"{prefix}_valid"),
            F.col(f"{prefix}_last_valid") - F.col(f"{prefix}_first_valid"),
            F.lit(required),
            F.col("_interval"),
        )

    none_inside = F.coalesce(F.col("in_n"), F.lit(0)) == 0
    from_start = F.col("in_first") - F.col("_start") < F.col("_interval") * F.lit(1000.0)
    kind = (
        F.when(none_inside & confirmed("after"), F.lit("closed"))
        .when(none_inside, F.lit("no_change"))
        .when(confirmed("in") & from_start, F.lit("retracted"))
        .when(confirmed("in"), F.lit("split"))
        .otherwise(F.lit("annotated"))
    )
    return joined.select(
        "episode_id",
        kind.alias("verdict"),
        F.when(kind == "closed", F.timestamp_millis(F.coalesce("after_first_valid", "after_first"))).alias("end_at"),
        F.when(kind == "split", F.timestamp_millis("in_first")).alias("split_start"),
        F.when(kind == "split", F.timestamp_millis("in_last")).alias("split_end"),
        F.coalesce("in_n", F.lit(0)).alias("inside_reports"),
    )


def apply_verdicts(
    current: DataFrame,
    verdicts: DataFrame,
    actions: DataFrame,
    at: Column,
    now: Column,
    actor: str = "system:watermark",
    approved_by: str | None = None,
) -> DataFrame:
    """Version rows to append for the verdicts, with a status per row.

    A closed or retracted episode gets one more version.  A split retracts the original and starts
    two episodes, ``-a`` up to the first inside report and ``-b`` from the last one; when the
    retraction is refused the halves are refused with it.
    """
    texts = F.create_map(
        F.lit("closed"), F.lit("late records confirm recovery"),
        F.lit("retracted"), F.lit("buffered records show the device was reporting throughout"),
        F.lit("split"), F.lit("superseded by two episodes after late records confirmed recovery mid-gap"),
    )
    acting = verdicts.filter(F.col("verdict").isin("closed", "retracted", "split"))
    kind = F.col("verdict")
    requests = acting.select(
        "episode_id",
        F.when(kind == "closed", F.lit("classified")).otherwise(F.lit("retracted")).alias("to_state"),
        F.concat(F.lit("late_data_"), kind).alias("cause"),
        F.lit(actor).alias("actor"),
        F.element_at(texts, kind).alias("reason"),
        at.alias("at"),
        F.coalesce("end_at", "split_start").alias("new_end_at"),
        kind.isin("closed", "split").alias("set_end"),
        F.lit(approved_by).cast("string").alias("approved_by"),
    )
    revised = apply_transitions(current, requests, actions, now)
    status = revised.select("episode_id", "status")
    halves = (
        acting.filter(kind == "split")
        .select("episode_id", "split_start", "split_end")
        .join(current, "episode_id")
        .join(status, "episode_id")
        .select(
            "*",
            F.explode(
                F.array(
                    F.struct(
                        F.lit("-a").alias("suffix"),
                        F.col("start_at").alias("s"),
                        F.col("split_start").alias("e"),
                        F.lit("first half of ").alias("text"),
                    ),
                    F.struct(
                        F.lit("-b").alias("suffix"),
                        F.col("split_end").alias("s"),
                        F.col("end_at").alias("e"),
                        F.lit("second half of ").alias("text"),
                    ),
                )
            ).alias("half"),
        )
        .select(
            F.concat("episode_id", "half.suffix").alias("episode_id"),
            "device_ref",
            F.lit(1).cast("bigint").alias("version"),
            "state",
            "type",
            F.col("half.s").alias("start_at"),
            F.col("half.e").alias("end_at"),
            F.lit("late_data_split").alias("cause"),
            F.lit(actor).alias("actor"),
            F.concat("half.text", "episode_id").alias("reason"),
            at.alias("at"),
            F.lit(None).cast("bigint").alias("supersedes"),
            "clock_basis",
            "policy_version",
            "finalisation_watermark_at",
            "status",
        )
    )
    return revised.drop("from_state").unionByName(halves)
