"""Recorded actions, canonical outcomes, aging and reviewer disagreement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quietwatch.functions.scalars import ms, round_half_up

# Outcome codes by category.
OUTCOMES = {
    "OUT-RESUMED": "technical",
    "OUT-EXPECTED": "technical",
    "OUT-FALSE": "technical",
    "OUT-VENDOR": "vendor",
    "OUT-BACKFILL": "technical",
    "OUT-SIM-REACTIVATED": "vendor",
    "OUT-SIM-REPLACED": "field",
    "OUT-RESET": "field",
    "OUT-RECONFIGURED": "field",
    "OUT-POWER-REPAIRED": "field",
    "OUT-RESEATED": "field",
    "OUT-DEVICE-REPLACED": "field",
    "OUT-FIELD-CHECK": "field",
    "OUT-ASSET-LOCATED": "field",
    "OUT-RECOVERY": "recovery",
    "OUT-UNRESOLVED": "open",
    "OUT-UNKNOWN": "open",
}
NEEDS_AUTHORIZATION = ("OUT-RECOVERY",)
OPEN_CODES = ("OUT-UNRESOLVED", "OUT-UNKNOWN")
ACTION_KINDS = ("field_verification", "vendor_ticket", "technician_visit", "record_external_recovery")


def outcome_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(c, k, c in NEEDS_AUTHORIZATION) for c, k in OUTCOMES.items()],
        "outcome_code string, category string, requires_authorization boolean",
    )


def category(code: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in OUTCOMES.items() for x in pair])
    return F.try_element_at(mapping, code)


def check_completion(actions: DataFrame) -> DataFrame:
    """Add ``status``: accepted, or the rule a completion breaks.

    ``actions``: started_at, completed_at, outcome_code (NULL stays unlabelled), authorization_ref.
    """
    code = F.col("outcome_code")
    status = (
        F.when(ms("completed_at") < ms("started_at"), F.lit("incoherent_times"))
        .when(code.isNotNull() & ~code.isin(*OUTCOMES), F.lit("unknown_outcome"))
        .when(
            code.isin(*NEEDS_AUTHORIZATION) & F.col("authorization_ref").isNull(),
            F.lit("missing_authorization"),
        )
        .otherwise(F.lit("accepted"))
    )
    return actions.withColumn("status", status)


def action_metrics(actions: DataFrame) -> DataFrame:
    """Seconds to action and to completion, and cost where both amount and currency are known."""
    def seconds(later: str, earlier: str) -> Column:
        return round_half_up((ms(later) - ms(earlier)) / F.lit(1000.0)).cast("bigint")

    priced = F.col("cost_amount").isNotNull() & F.col("cost_currency").isNotNull()
    return actions.withColumns(
        {
            "time_to_action_s": seconds("started_at", "opened_at"),
            "time_to_complete_s": seconds("completed_at", "started_at"),
            "cost": F.when(priced, F.struct("cost_amount", "cost_currency")),
        }
    )


def _lists() -> dict[str, Column]:
    done, code = F.col("completed_at").isNotNull(), F.col("outcome_code")
    open_code = F.coalesce(code.isin(*OPEN_CODES), F.lit(False))
    return {
        "open": ~done,
        "unresolved": open_code,
        "unlabelled": done & code.isNull(),
        "resolved": done & code.isNotNull() & ~open_code,
    }


def aging_rows(actions: DataFrame, now: Column) -> DataFrame:
    """One row per action and aging list it is on; an open action may also be unresolved."""
    lists = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in _lists().items()]))
    age = F.greatest(F.lit(0), round_half_up((ms(now) - ms("started_at")) / F.lit(1000.0)))
    return actions.select(
        "action_id", F.explode(lists).alias("aging_list"), age.cast("bigint").alias("age_s")
    )


def aging_report(actions: DataFrame, now: Column) -> DataFrame:
    return aging_rows(actions, now).groupBy("aging_list").agg(
        F.count(F.lit(1)).alias("actions"),
        F.min("age_s").alias("youngest_s"),
        F.max("age_s").alias("oldest_s"),
    )


def disputed(labels: DataFrame) -> DataFrame:
    """Per episode: labels given and whether reviewers disagree."""
    return labels.groupBy("episode_id").agg(
        F.count(F.lit(1)).alias("labels"),
        (F.min("outcome_code") != F.max("outcome_code")).alias("disputed"),
    )


def dataset_view(labels: DataFrame, mode: str) -> DataFrame:
    """Labels of episodes that are undisputed (exclude), disputed (only) or all (include)."""
    if mode == "include":
        return labels
    if mode not in ("exclude", "only"):
        raise ValueError(f"unknown dataset view {mode}")
    verdict = disputed(labels).filter(F.col("disputed") == (mode == "only")).select("episode_id")
    return labels.join(verdict, "episode_id", "left_semi")


def adjudicated(labels: DataFrame, finals: DataFrame) -> DataFrame:
    """Final code per episode beside its retained labels; the latest adjudication stands."""
    w = Window.partitionBy("episode_id").orderBy(F.desc("at"), F.desc("adjudicated_by"))
    last = finals.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")
    return disputed(labels).join(
        last.select("episode_id", F.col("outcome_code").alias("final_code"), "adjudicated_by"),
        "episode_id",
        "left",
    )
