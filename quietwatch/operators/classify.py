"""Classification as one narrow projection over the facts of an episode.

Nothing here moves a row: suppression, bands, urgency and the unknown outcome are expressions over
the ten rule outcomes an episode carries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.operators.rules import (
    CONTRADICTIONS,
    RULES,
    Contradiction,
    Rule,
    holds_kleene,
    outcomes,
)

# Order of evidence bands.
BAND_RANK = {"direct": 3, "corroborated": 2, "weak": 1, "indeterminate": 0}
UNKNOWN_REASON = "the evidence is missing, in conflict, or below the threshold"


def band_rank(band: Column) -> Column:
    ranks = F.when(band == "direct", 3)
    for name, rank in list(BAND_RANK.items())[1:]:
        ranks = ranks.when(band == name, rank)
    return ranks


def cap_band(band: Column, cap: str) -> Column:
    """A cap only ever lowers."""
    return F.when(band_rank(band) <= BAND_RANK[cap], band).otherwise(F.lit(cap))


def _verdict(c: Contradiction) -> Column:
    """What a contradiction does to the row: suppress, withhold, or NULL when it does not apply."""
    exception = F.lit(False)
    for predicate in c.unless:
        exception = exception | holds_kleene(predicate)
    codes = F.transform("fired", lambda f: f["code"])
    active = F.array_contains(codes, c.suppressor) & F.array_contains(codes, c.suppressed)
    return (
        F.when(~active, F.lit(None))
        .when(exception.isNull(), F.lit("withhold"))
        .when(~exception, F.lit("suppress"))
    )


def _entry(f: Column, contradictions: Sequence[Contradiction]) -> Column:
    notes, suppressors = [], [F.lit(None).cast("string")]
    for i, c in enumerate(contradictions):
        verdict = F.col(f"_c{i}")
        touched = (f["code"] == c.suppressed) & verdict.isNotNull()
        direct = f["strength"] == "direct"
        notes.append(
            F.when(
                touched & direct,
                F.lit(
                    f"a {c.suppressor} incident is concurrently active; this direct signal is "
                    "preserved and shown alongside it"
                ),
            )
            .when(
                touched & (verdict == "withhold"),
                F.lit(
                    f"suppression by {c.suppressor} withheld: its exception condition could not be "
                    "evaluated from the available facts"
                ),
            )
            .when(touched, F.lit(f"suppressed: {c.rationale}"))
        )
        suppressors.append(F.when(touched & ~direct & (verdict == "suppress"), F.lit(c.suppressor)))
    suppressed_by = F.coalesce(*reversed(suppressors))
    counter = (
        F.concat(f["counterevidence"], F.array_compact(F.array(*notes)))
        if notes
        else f["counterevidence"]
    )
    band = (
        F.when(suppressed_by.isNotNull(), cap_band(f["strength"], "weak"))
        .when((f["strength"] == "corroborated") & (F.size(counter) > 0), F.lit("weak"))
        .otherwise(f["strength"])
    )
    return F.struct(
        f["code"].alias("code"),
        f["rule_id"].alias("rule_id"),
        f["rule_version"].alias("rule_version"),
        band.alias("band"),
        f["family"].alias("family"),
        f["summary"].alias("summary"),
        counter.alias("counterevidence"),
        f["missing"].alias("missing_expected"),
        f["human_review"].alias("human_review"),
        suppressed_by.alias("suppressed_by"),
        f["factor"].alias("factor"),
        f["effect"].alias("effect"),
    )


def supports_urgent_action(evidence: Column) -> Column:
    """Direct evidence, or corroboration from two families; a cell prior never counts."""
    usable = F.filter(evidence, lambda e: e["family"] != "cell_prior")
    families = F.array_distinct(
        F.transform(
            F.filter(usable, lambda e: e["band"] == "corroborated"), lambda e: e["family"]
        )
    )
    return F.exists(usable, lambda e: e["band"] == "direct") | (F.size(families) >= 2)


def explain_actionability(evidence: Column) -> Column:
    """The urgency decision with the evidence that counted, was excluded, and the reason."""
    counted = F.filter(evidence, lambda e: e["family"] != "cell_prior")
    excluded = F.filter(evidence, lambda e: e["family"] == "cell_prior")
    actionable = supports_urgent_action(evidence)
    direct = F.filter(counted, lambda e: e["band"] == "direct")
    families = F.array_distinct(
        F.transform(
            F.filter(counted, lambda e: e["band"] == "corroborated"), lambda e: e["family"]
        )
    )
    none = F.lit("no direct or independently corroborated evidence")
    reason = (
        F.when(
            actionable & (F.size(direct) > 0),
            F.concat(F.lit("direct evidence from "), F.get(direct, F.lit(0))["family"]),
        )
        .when(
            actionable,
            F.concat(
                F.lit("corroborated across "),
                F.size(families).cast("string"),
                F.lit(" independent evidence families"),
            ),
        )
        .when(
            F.size(excluded) > 0,
            F.concat(
                none,
                F.lit(
                    "; a cell prior is present but is context only and cannot meet the threshold "
                    "on its own"
                ),
            ),
        )
        .otherwise(none)
    )
    return F.struct(
        actionable.alias("actionable"),
        reason.alias("reason"),
        counted.alias("counted"),
        excluded.alias("excluded"),
    )


def evaluate(facts: DataFrame, at: Column, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Add ``outcomes``: every effective rule as fired, did_not_fire or not_applicable."""
    return facts.withColumn("outcomes", outcomes(at, rules))


def rule_outcomes(facts: DataFrame, at: Column, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Outcomes in long form, one row per episode and rule."""
    evaluated = evaluate(facts, at, rules)
    keys = [c for c in facts.columns if c not in ("facts", "unavailable")]
    return evaluated.select(*keys, F.inline("outcomes"))


def classify(
    facts: DataFrame,
    at: Column,
    rules: Sequence[Rule] = RULES,
    contradictions: Sequence[Contradiction] = CONTRADICTIONS,
) -> DataFrame:
    """Add hypotheses, the unknown outcome, inapplicable rules, priority factors and urgency."""
    judged = evaluate(facts, at, rules).withColumn(
        "fired", F.filter("outcomes", lambda o: o["kind"] == "fired")
    )
    judged = judged.withColumns({f"_c{i}": _verdict(c) for i, c in enumerate(contradictions)})
    judged = judged.withColumn(
        "hypotheses", F.transform("fired", lambda f: _entry(f, contradictions))
    )
    admissible = F.filter(
        "hypotheses", lambda h: h["suppressed_by"].isNull() & (h["effect"] == "raise")
    )
    missing = F.array_sort(
        F.array_distinct(F.flatten(F.transform("outcomes", lambda o: o["missing"])))
    )
    return judged.withColumns(
        {
            "urgent_eligible": supports_urgent_action(admissible),
            "priority_factors": F.transform(
                "hypotheses",
                lambda h: F.struct(
                    h["factor"].alias("factor"),
                    F.when(h["suppressed_by"].isNull(), h["effect"])
                    .otherwise(F.lit("none"))
                    .alias("effect"),
                    h["rule_id"].alias("from_rule"),
                ),
            ),
            "unknown": F.when(
                F.size("hypotheses") == 0,
                F.struct(
                    F.lit("H-UNKNOWN").alias("code"),
                    F.lit(UNKNOWN_REASON).alias("reason"),
                    missing.alias("missing_expected"),
                ),
            ),
            "not_applicable": F.transform(
                F.filter("outcomes", lambda o: o["kind"] == "not_applicable"),
                lambda o: F.struct(
                    o["code"].alias("code"),
                    o["rule_id"].alias("rule_id"),
                    o["missing"].alias("missing_facts"),
                ),
            ),
        }
    ).drop("outcomes", "fired", *[f"_c{i}" for i in range(len(contradictions))])


def summarise(classified: DataFrame, key: str) -> DataFrame:
    """Fired codes, bands, suppressed codes, unknown and urgency, per episode."""
    hypotheses = F.col("hypotheses")
    codes = F.transform(hypotheses, lambda h: h["code"])
    # Two rules of one hypothesis collapse to the later band.
    bands = F.aggregate(
        hypotheses,
        F.create_map().cast("map<string,string>"),
        lambda acc, h: F.map_concat(
            F.map_filter(acc, lambda k, _: k != h["code"]), F.create_map(h["code"], h["band"])
        ),
    )
    return classified.select(
        key,
        F.array_sort(codes).alias("fired"),
        bands.alias("bands"),
        F.array_sort(
            F.transform(
                F.filter(hypotheses, lambda h: h["suppressed_by"].isNotNull()), lambda h: h["code"]
            )
        ).alias("suppressed"),
        F.col("unknown").isNotNull().alias("is_unknown"),
        "urgent_eligible",
    )


def diff_summaries(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Keys whose summary was added, removed or changed between two runs."""
    def packed(df: DataFrame, name: str) -> DataFrame:
        body = F.struct(
            "fired",
            F.array_sort(F.map_entries("bands")).alias("bands"),
            "suppressed",
            "is_unknown",
            "urgent_eligible",
        )
        return df.select(key, body.alias(name))

    joined = packed(before, "before").join(packed(after, "after"), key, "full_outer")
    kind = (
        F.when(F.col("before").isNull(), F.lit("added"))
        .when(F.col("after").isNull(), F.lit("removed"))
        .when(~F.col("before").eqNullSafe(F.col("after")), F.lit("changed"))
    )
    return joined.withColumn("kind", kind).filter(F.col("kind").isNotNull())
