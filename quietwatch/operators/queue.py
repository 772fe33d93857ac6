"""Review queue: priority from named factors, due state, views, assignment and bulk checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.functions.ordered import spread
from quietwatch.functions.scalars import from_ms, ms, round_half_up
from quietwatch.operators.classify import band_rank

# Actions allowed in bulk.
BULK_ACTIONS = ("assign_owner", "add_note")

ANY = object()


@dataclass(frozen=True)
class QueuePolicy:
    urgent_s: int = 2 * 3600
    elevated_s: int = 8 * 3600
    routine_s: int = 24 * 3600
    overdue_grace_s: int = 3600


@dataclass(frozen=True)
class View:
    """Saved filters and a sort; ``owner=None`` means unassigned, ``ANY`` means no owner filter."""

    view_id: str
    sort: str
    bucket: str | None = None
    due_state: str | None = None
    tier: str | None = None
    source: str | None = None
    owner: object = field(default=ANY)


# The views every deployment starts with.
BUILTIN_VIEWS = (
    View("view-due", "due_first", due_state="overdue"),
    View("view-review", "due_first", bucket="review_required"),
    View("view-unowned", "oldest", owner=None),
    View("view-urgent", "oldest", tier="urgent"),
)


def with_priority(classified: DataFrame, age_s: str, policy: QueuePolicy = QueuePolicy()) -> DataFrame:
    """Add tier, every factor considered, and the sentence derived from them."""
    def extra(when: Column, factor: str, effect: str, rule: str) -> Column:
        return F.when(
            when,
            F.struct(
                F.lit(factor).alias("factor"), F.lit(effect).alias("effect"), F.lit(rule).alias("from_rule")
            ),
        )

    added = F.array_compact(
        F.array(
            extra(F.col("urgent_eligible"), "urgent_eligible_evidence", "raise", "evidence_threshold"),
            extra(F.col("unknown").isNotNull(), "classification_unknown", "none", "queue_policy"),
            extra(
                F.col(age_s) > policy.routine_s,
                "episode_age_exceeds_routine_window",
                "raise",
                "queue_policy",
            ),
        )
    )
    raising = F.filter("factors", lambda f: f["effect"] == "raise")
    names = F.array_join(F.transform(raising, lambda f: F.replace(f["factor"], F.lit("_"), F.lit(" "))), ", ")
    return (
        classified.withColumn("factors", F.concat("priority_factors", added))
        .withColumn(
            "tier",
            F.when(F.col("urgent_eligible"), F.lit("urgent"))
            .when(F.size(raising) > 0, F.lit("elevated"))
            .otherwise(F.lit("routine")),
        )
        .withColumn(
            "priority_reason",
            F.when(F.size(raising) > 0, F.concat("tier", F.lit(": "), names)).otherwise(
                F.concat(
                    F.lit("routine: no factor increased the priority (the system examined "),
                    F.size("factors").cast("string"),
                    F.lit(" factors)"),
                )
            ),
        )
    )


def due_state(due_ms: Column, now_ms: Column, grace_s: int) -> Column:
    over = now_ms - due_ms
    return (
        F.when(over <= 0, F.lit("not_due"))
        .when(over > grace_s * 1000, F.lit("overdue"))
        .otherwise(F.lit("due"))
    )


def bucket(state: Column) -> Column:
    return (
        F.when(state == "provisional", F.lit("provisional"))
        .when(state == "monitoring", F.lit("awaiting_data"))
        .when(state == "review_required", F.lit("review_required"))
        .otherwise(F.lit("classified"))
    )


def build_queue(cases: DataFrame, now: Column, policy: QueuePolicy = QueuePolicy()) -> DataFrame:
    """Queue rows from current episodes with their classification.

    ``cases``: episode_id, asset_ref, device_ref, state, type, start_at, clock_basis, source, owner,
    row_version, last_defensible_observation_at, plus the classification columns.  No column can
    carry a person.
    """
    start, now_ms = ms("start_at"), ms(now)
    aged = cases.withColumn(
        "age_s",
        F.greatest(F.lit(0), round_half_up((now_ms - start) / F.lit(1000.0))).cast("bigint"),
    )
    ranked = with_priority(aged, "age_s", policy)
    open_bands = F.transform(
        F.filter("hypotheses", lambda h: h["suppressed_by"].isNull()),
        lambda h: F.struct(band_rank(h["band"]).alias("rank"), h["band"].alias("band")),
    )
    wait = (
        F.when(F.col("tier") == "urgent", policy.urgent_s)
        .when(F.col("tier") == "elevated", policy.elevated_s)
        .otherwise(policy.routine_s)
    )
    due_ms = start + wait * 1000
    warnings = F.array_compact(
        F.array(
            F.when(
                F.col("clock_basis") == "received_at",
                F.lit("The episode boundaries use the receipt time. The device clock was not usable."),
            ),
            F.when(
                F.col("unknown").isNotNull(),
                F.concat(F.lit("The classification is unknown: "), "unknown.reason", F.lit(".")),
            ),
        )
    )
    return ranked.select(
        "episode_id",
        "asset_ref",
        "device_ref",
        bucket(F.col("state")).alias("bucket"),
        F.col("type").alias("episode_type"),
        "start_at",
        "age_s",
        "tier",
        "factors",
        F.col("priority_reason").alias("reason"),
        F.array_max(open_bands)["band"].alias("band"),
        "last_defensible_observation_at",
        "source",
        "owner",
        F.col("row_version").alias("version"),
        from_ms(due_ms).alias("due_at"),
        due_state(due_ms, now_ms, policy.overdue_grace_s).alias("due_state"),
        warnings.alias("warnings"),
    )


def filter_view(items: DataFrame, view: View) -> DataFrame:
    """The rows of a view; ``overdue`` also shows rows that are merely due."""
    rows = items
    for column in ("bucket", "tier", "source"):
        wanted = getattr(view, column)
        if wanted is not None:
            rows = rows.filter(F.col(column) == wanted)
    if view.owner is not ANY:
        rows = rows.filter(F.col("owner").eqNullSafe(F.lit(view.owner).cast("string")))
    if view.due_state == "overdue":
        rows = rows.filter(F.col("due_state") != "not_due")
    elif view.due_state is not None:
        rows = rows.filter(F.col("due_state") == view.due_state)
    return rows


def apply_view(items: DataFrame, view: View) -> DataFrame:
    orders = {
        "due_first": [F.asc("due_at")],
        "newest": [F.desc("start_at")],
        "oldest": [F.asc("start_at")],
    }
    return filter_view(items, view).orderBy(*orders[view.sort], F.asc("episode_id"))


def merge_assignments(items: DataFrame, requests: DataFrame) -> DataFrame:
    """Optimistic assignment of a request table: episode_id, owner, expected_version, requested_at.

    The first request that saw the current version wins; every other one is a conflict and is told
    the owner and version that stand after the merge.
    """
    rows = requests.count()
    requests, items = spread(requests, ["episode_id"], rows), spread(items, ["episode_id"], rows)
    current = F.col("expected_version") == F.col("old_version")
    seen = (
        requests.withColumnRenamed("owner", "new_owner")
        .join(
            items.select("episode_id", F.col("owner").alias("old_owner"), F.col("version").alias("old_version")),
            "episode_id",
        )
        .withColumn("_current", F.coalesce(current, F.lit(False)))
    )
    # requests of the current version first, by time (an unknown time last); the first of them wins, once
    order = Window.partitionBy("episode_id").orderBy(
        F.desc("_current"), F.asc_nulls_last("requested_at"), F.asc_nulls_last("new_owner")
    )
    ranked = seen.withColumn("_rank", F.row_number().over(order))
    won = F.col("_current") & (F.col("_rank") == 1)
    whole = Window.partitionBy("episode_id")
    joined = ranked.withColumn("_won", F.max(won).over(whole)).withColumn(
        "_won_by", F.max(F.when(won, F.col("new_owner"))).over(whole)
    )
    return joined.select(
        "episode_id",
        "new_owner",
        "expected_version",
        "requested_at",
        F.when(won, F.lit("assigned")).otherwise(F.lit("conflict")).alias("outcome"),
        F.when(F.col("_won"), F.col("_won_by")).otherwise(F.col("old_owner")).alias("owner"),
        (F.col("old_version") + F.col("_won").cast("int")).alias("version"),
    )


def check_bulk(action: str, items: DataFrame) -> DataFrame:
    """Whether each row may take part in a bulk action, and the reason when it may not."""
    if action not in BULK_ACTIONS:
        refusal = F.lit(f'The action "{action}" is not approved for bulk use.')
    else:
        refusal = F.when(
            F.col("tier") == "urgent", F.lit("You must review urgent rows one at a time.")
        ).when(
            F.col("band") == "direct",
            F.lit("You must review rows with direct evidence one at a time."),
        )
    return items.select("episode_id", refusal.isNull().alias("eligible"), refusal.alias("refusal"))
