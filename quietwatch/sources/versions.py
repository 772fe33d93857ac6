"""Observation versions: a newer adapter is a second opinion, never an overwrite."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The three times no step may rewrite.
IMMUTABLE_TIMES = ("received_at", "vendor_received_at", "device_time")


def enrich(observations: DataFrame, additions: dict[str, Column]) -> DataFrame:
    """Add derived columns; replacing one of the three times is refused before planning."""
    overwritten = sorted(set(additions) & set(IMMUTABLE_TIMES))
    if overwritten:
        raise ValueError(f"refusing to overwrite {overwritten}")
    return observations.withColumns(additions)


def next_versions(decoded: DataFrame, existing: DataFrame) -> DataFrame:
    """Rows to append for a new decode: ``max(version) + 1`` per identity.

    An identity this adapter version already decoded gives no row, and neither does one that was
    never stored.  ``existing``: identity, version, adapter_version.
    """
    highest = existing.groupBy("identity").agg(F.max("version").alias("_highest"))
    known = existing.select("identity", "adapter_version").distinct()
    return (
        decoded.join(known, ["identity", "adapter_version"], "left_anti")
        .join(highest, "identity")
        .withColumn("version", F.col("_highest") + 1)
        .drop("_highest")
    )


def current_versions(versions: DataFrame) -> DataFrame:
    """Highest version of each identity that is not superseded."""
    rest = F.struct(*[c for c in versions.columns if c != "identity"])
    return (
        versions.filter(~F.col("superseded"))
        .groupBy("identity")
        .agg(F.max_by(rest, "version").alias("_v"))
        .select("identity", "_v.*")
    )


def diff_versions(before: DataFrame, after: DataFrame, payload: str = "payload") -> DataFrame:
    """Per identity and top-level field: whether a re-decode changed it.

    ``payload`` is a VARIANT; absent and explicit null differ.
    """
    def fields(df: DataFrame, name: str) -> DataFrame:
        as_fields = F.transform_values(
            F.try_variant_get(payload, "$", "map<string,variant>"), lambda _, v: F.to_json(v)
        )
        return df.select("identity", as_fields.alias(name))

    both = fields(before, "_b").join(fields(after, "_a"), "identity")
    names = F.array_sort(F.array_union(F.map_keys("_b"), F.map_keys("_a")))
    return both.select("identity", "_b", "_a", F.explode(names).alias("field")).select(
        "identity",
        "field",
        (~F.try_element_at("_b", F.col("field")).eqNullSafe(F.try_element_at("_a", F.col("field")))).alias(
            "changed"
        ),
    )


def trace(observations: DataFrame, receipts: DataFrame, stored: DataFrame) -> DataFrame:
    """Observation to receipt to stored bytes, hashed again.

    ``stored``: raw_sha256, content.  A receipt hash may occur once per resend, so receipts are
    reduced to their hash first.
    """
    kept = receipts.groupBy("raw_sha256").agg(
        F.count(F.lit(1)).alias("receipt_count"), F.min("received_at").alias("first_received_at")
    )
    return (
        observations.join(kept, "raw_sha256", "left")
        .join(
            stored.select("raw_sha256", (F.sha2("content", 256) == F.col("raw_sha256")).alias("_same")),
            "raw_sha256",
            "left",
        )
        .withColumn(
            "trace_status",
            F.when(F.col("receipt_count").isNull(), F.lit("no_receipt"))
            .when(F.col("_same").isNull(), F.lit("no_payload"))
            .when(F.col("_same"), F.lit("verified"))
            .otherwise(F.lit("hash_mismatch")),
        )
        .drop("_same")
    )


def verify_sample(keys: DataFrame, stored: DataFrame, sample_size: int, seed: int) -> DataFrame:
    """A reproducible sample of stored payloads: verified, missing or hash_mismatch.

    The sample is the lowest seeded hashes of the keys, a top-n that never sorts the whole list.
    ``keys``: raw_sha256.  ``stored``: raw_sha256, content.
    """
    picked = (
        keys.select("raw_sha256")
        .distinct()
        .orderBy(F.sha2(F.concat_ws(":", "raw_sha256", F.lit(str(seed))), 256), "raw_sha256")
        .limit(sample_size)
    )
    hashed = stored.join(F.broadcast(picked), "raw_sha256", "left_semi").select(
        "raw_sha256", F.sha2("content", 256).alias("_actual")
    )
    return picked.join(hashed, "raw_sha256", "left").select(
        "raw_sha256",
        F.when(F.col("_actual").isNull(), F.lit("missing"))
        .when(F.col("_actual") == F.col("raw_sha256"), F.lit("verified"))
        .otherwise(F.lit("hash_mismatch"))
        .alias("status"),
    )


def versions_of(versions: DataFrame, identity: str) -> DataFrame:
    return versions.filter(F.col("identity") == identity).orderBy("version")
