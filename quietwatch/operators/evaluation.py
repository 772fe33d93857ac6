"""Evaluation of deciders against truth, and the pilot protocol built on it."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.scalars import ms, rate_struct
from quietwatch.operators.rules import RULES, Rule, fact

# Causes that truly need urgent review, and the hypothesis that names each cause.
URGENT_CAUSES = ("power_disconnect",)
TRUTH_TO_HYPOTHESIS = {
    "expected_sleep": "H-EXPECTED",
    "gnss_only_loss": "H-GNSS",
    "power_disconnect": "H-POWER",
    "device_fault": "H-DEVICE",
    "network_incident": "H-NETWORK",
    "vendor_ingestion_delay": "H-VENDOR",
}


def baselines() -> dict[str, Column]:
    """The simple deciders a customer could run alone, over the ``facts`` struct."""
    return {
        "fixed_timeout": fact("episode.type").isNotNull(),
        "power_loss_alert": F.coalesce(fact("power.cut_alert_present"), F.lit(False)),
        "vendor_volume": F.coalesce(fact("source.independent_devices") >= 3, F.lit(False)),
    }


def decider_metrics(
    cases: DataFrame, deciders: Mapping[str, Column], actual: Column, by: Sequence[str] = ()
) -> DataFrame:
    """Precision, recall and flagged rate of every decider in one pass over the cases."""
    by = list(by)
    flags = {n: F.coalesce(d, F.lit(False)) for n, d in deciders.items()}
    counted = cases.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_cases"),
        F.count_if(actual).alias("_truth"),
        *[F.count_if(c).alias(f"_flagged_{n}") for n, c in flags.items()],
        *[F.count_if(c & actual).alias(f"_hit_{n}") for n, c in flags.items()],
    )
    rows = F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(n).alias("decider"),
                    F.col("_cases").alias("cases"),
                    rate_struct(F.col(f"_hit_{n}"), F.col(f"_flagged_{n}")).alias("precision"),
                    rate_struct(F.col(f"_hit_{n}"), F.col("_truth")).alias("recall"),
                    rate_struct(F.col(f"_flagged_{n}"), F.col("_cases")).alias("flagged_rate"),
                )
                for n in flags
            ]
        )
    )
    return counted.select(*by, rows)


def incremental(metrics: DataFrame, candidate: str = "classifier") -> DataFrame:
    """The candidate less each baseline; clearly better only when the intervals do not meet."""
    ours = metrics.filter(F.col("decider") == candidate).select(
        F.col("precision").alias("_p"), F.col("recall").alias("_r")
    )
    return (
        metrics.filter(F.col("decider") != candidate)
        .join(F.broadcast(ours))
        .select(
            F.col("decider").alias("baseline"),
            (F.col("_p.value") - F.col("precision.value")).alias("precision_delta"),
            (F.col("_r.value") - F.col("recall.value")).alias("recall_delta"),
            F.coalesce(
                F.col("_p.ci95_lower") > F.col("precision.ci95_upper"), F.lit(False)
            ).alias("clearly_better_precision"),
        )
    )


def expected_hypothesis(cause: Column) -> Column:
    mapping = F.create_map(*[F.lit(x) for pair in TRUTH_TO_HYPOTHESIS.items() for x in pair])
    return F.try_element_at(mapping, cause)


def hypothesis_metrics(cases: DataFrame) -> DataFrame:
    """Precision and recall per hypothesis.  ``cases``: fired (codes), true_cause."""
    expected = expected_hypothesis(F.col("true_cause"))
    involved = F.array_distinct(F.array_compact(F.concat("fired", F.array(expected))))
    rows = cases.select("fired", expected.alias("expected"), F.explode(involved).alias("hypothesis"))
    fired = F.array_contains("fired", F.col("hypothesis"))
    truth = F.coalesce(F.col("expected") == F.col("hypothesis"), F.lit(False))
    return (
        rows.groupBy("hypothesis")
        .agg(
            F.count_if(fired & truth).alias("_tp"),
            F.count_if(fired).alias("_fired"),
            F.count_if(truth).alias("_truth"),
        )
        .select(
            "hypothesis",
            rate_struct(F.col("_tp"), F.col("_fired")).alias("precision"),
            rate_struct(F.col("_tp"), F.col("_truth")).alias("recall"),
        )
    )


def outcome_rates(cases: DataFrame) -> DataFrame:
    """Review and unknown rates.  ``cases``: needs_review, is_unknown."""
    n = F.count(F.lit(1))
    return cases.agg(
        n.alias("cases"),
        rate_struct(F.count_if("needs_review"), n).alias("review_rate"),
        rate_struct(F.count_if("is_unknown"), n).alias("unknown_rate"),
    )


def _at(text: str) -> datetime:
    return datetime.fromisoformat(text.replace("Z", "+00:00"))


@dataclass(frozen=True)
class PilotProtocol:
    """Locked windows and rule versions; the holdout starts when calibration is over."""

    pilot_id: str
    calibration: tuple[str, str]
    holdout: tuple[str, str]
    rule_versions: Mapping[str, str]

    @staticmethod
    def lock(
        pilot_id: str,
        calibration: tuple[str, str],
        holdout: tuple[str, str],
        rules: Sequence[Rule] = RULES,
    ) -> PilotProtocol:
        ordered = (
            _at(calibration[0]) < _at(calibration[1])
            and _at(holdout[0]) < _at(holdout[1])
            and _at(calibration[1]) <= _at(holdout[0])
        )
        if not ordered:
            raise ValueError("calibration and holdout must be separate, holdout last")
        return PilotProtocol(pilot_id, calibration, holdout, {r.rule_id: r.version for r in rules})

    def check_rules(self, rules: Sequence[Rule] = RULES) -> None:
        """Refuse to evaluate two systems as one."""
        current = {r.rule_id: r.version for r in rules}
        drifted = sorted(
            rule_id
            for rule_id in current.keys() | self.rule_versions.keys()
            if current.get(rule_id) != self.rule_versions.get(rule_id)
        )
        if drifted:
            raise ValueError(f"rule versions drifted since the pilot was locked: {drifted}")

    def check_sealed(self, now: str) -> None:
        if _at(now) < _at(self.holdout[1]):
            raise ValueError(f"the holdout is sealed until {self.holdout[1]}")

    def interval(self, at: str) -> Column:
        t = ms(at)

        def inside(window: tuple[str, str]) -> Column:
            begin, end = (int(_at(w).timestamp() * 1000) for w in window)
            return (t >= begin) & (t < end)

        return (
            F.when(inside(self.calibration), F.lit("calibration"))
            .when(inside(self.holdout), F.lit("holdout"))
            .otherwise(F.lit("outside"))
        )


def evaluate_pilot(
    protocol: PilotProtocol,
    cases: DataFrame,
    deciders: Mapping[str, Column],
    actual: Column,
    occurred_at: str,
    now: str,
) -> DataFrame:
    """Metrics per interval; cases outside both windows are counted under ``outside``."""
    protocol.check_rules()
    protocol.check_sealed(now)
    return decider_metrics(
        cases.withColumn("interval", protocol.interval(occurred_at)), deciders, actual, ["interval"]
    )


def pilot_verdict(
    evaluation: DataFrame,
    precision_floor: float,
    recall_floor: float,
    min_cases: int,
    avoided_dispatches: int,
    dispatch_cost: float,
    candidate: str = "classifier",
) -> DataFrame:
    """Go, conditional or no-go from the cautious end of the holdout intervals.

    The saving is a model: avoided dispatches times a cost the customer supplied.
    """
    held = evaluation.filter((F.col("interval") == "holdout") & (F.col("decider") == candidate))
    low = held.groupBy().agg(
        F.coalesce(F.max("cases"), F.lit(0)).alias("holdout_cases"),
        F.max("precision.ci95_lower").alias("precision_lower"),
        F.max("recall.ci95_lower").alias("recall_lower"),
    )
    few = F.col("holdout_cases") < min_cases
    reasons = F.array_compact(
        F.array(
            F.when(few, F.lit("too_few_holdout_cases")),
            F.when(F.col("precision_lower") < precision_floor, F.lit("precision_below_floor")),
            F.when(F.col("recall_lower") < recall_floor, F.lit("recall_below_floor")),
        )
    )
    return low.select(
        "*",
        reasons.alias("reasons"),
        F.when(F.size(reasons) == 0, F.lit("go"))
        .when(few, F.lit("conditional"))
        .otherwise(F.lit("no_go"))
        .alias("verdict"),
        F.lit(float(avoided_dispatches * dispatch_cost)).alias("modelled_saving"),
    )
