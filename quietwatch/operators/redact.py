"""Sensitive-text scanning, redaction, and the fail-closed findings bundle."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# What counts as sensitive in free text.  Word characters and borders are ASCII.
SENSITIVE_PATTERNS = {
    "coordinates": r"-?\d{1,3}\.\d{4,}\s*[,;]\s*-?\d{1,3}\.\d{4,}",
    "lat_lon_field": r'(?i)"(lat|latitude|lon|lng|longitude)"\s*:\s*-?\d{1,3}\.\d{3,}',
    "msisdn": r"(?:\+?254|0)7\d{8}",
    "imei": r"(?<![A-Za-z0-9_])\d{15}(?![A-Za-z0-9_])",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
}
REDACTED = "[REDACTED]"
EXCERPT_CHARS = 40

# Field names whose value must not appear in a diagnostic.
SENSITIVE_HINTS = (
    "lat", "lon", "latitude", "longitude", "imsi", "iccid", "imei", "msisdn", "phone",
    "name", "address", "plate", "vin", "borrower", "raw", "payload",
)

# Thresholds and vocabularies of a publishable bundle.
MAX_H3_RESOLUTION = 6
MIN_COHORT_SIZE = 25
MIN_TIME_BUCKET_S = 3600
BUNDLE_VERSION = "0.1.0"
ALLOWED_FIELDS = (
    "bundle_version", "generated_at", "container_version", "analyser_versions", "tenant_label",
    "source_labels", "period_start", "period_end", "thresholds", "reasoning", "content_hashes",
    "vendor", "model", "firmware", "source", "day", "hour_bucket", "h3_cell", "h3_resolution",
    "denominator", "numerator", "excluded", "exclusion_reasons", "device_count", "observation_count",
    "count", "p50", "p95", "p99", "min", "max", "field_group", "completeness", "platform_lag_s",
    "total_lag_s", "device_to_vendor_lag_s", "duplicate_rate", "out_of_order_rate", "backfill_rate",
    "impossible_value_counts", "episode_type", "episode_count", "duration_s", "suppressed_count",
    "weak_basis_count", "devices_with_episodes", "devices_observed", "assignment_coverage",
    "unmapped_device_count", "destructive_settings", "retention_findings", "blocking_findings",
    "setting", "effect", "enabled", "default_enabled", "raw_days", "customer_reducible", "sufficient",
)
COORDINATE_FIELDS = ("lat", "lon", "latitude", "longitude", "coordinates", "position", "geometry")
IDENTIFIER_FIELDS = (
    "device_ref", "asset_ref", "sim_ref", "imei", "iccid", "imsi", "msisdn", "phone", "serial",
    "plate", "vin", "borrower", "name", "address", "event_id", "event_identity", "raw_sha256",
)
FREE_KEY_PARENTS = (
    "analyser_versions", "content_hashes", "thresholds", "exclusion_reasons", "impossible_value_counts",
)
COORDINATE_VALUE = r"^-?\d{1,3}\.\d{4,}$"
LONG_DIGITS = r"^\d{11,}$"


def scan_sensitive(text: Column) -> Column:
    """First match of each kind as ``array<struct<kind, excerpt>>``."""
    findings = []
    for kind, pattern in SENSITIVE_PATTERNS.items():
        hit = F.regexp_extract(text, pattern, 0)
        findings.append(
            F.when(
                hit != "",
                F.struct(F.lit(kind).alias("kind"), F.substring(hit, 1, EXCERPT_CHARS).alias("excerpt")),
            )
        )
    return F.array_compact(F.array(*findings))


def sensitive_counts(texts: DataFrame, column: str, by: list[str]) -> DataFrame:
    """Rows with at least one match, and all matches, per kind."""
    per_kind = F.inline(
        F.array(
            *[
                F.struct(F.lit(k).alias("kind"), F.regexp_count(F.col(column), F.lit(p)).alias("n"))
                for k, p in SENSITIVE_PATTERNS.items()
            ]
        )
    )
    return (
        texts.select(*by, per_kind)
        .filter(F.col("n") > 0)
        .groupBy(*by, "kind")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("matches"))
    )


def redact(text: Column) -> Column:
    """Every sensitive match replaced in turn, visibly."""
    for pattern in SENSITIVE_PATTERNS.values():
        text = F.regexp_replace(text, pattern, REDACTED.replace("[", r"\[").replace("]", r"\]"))
    return text


def is_safe_diagnostic(text: Column) -> Column:
    """No labelled sensitive value, no coordinate pair, no run of eleven digits."""
    lowered = F.lower(text)
    labelled = F.lit(False)
    for hint in SENSITIVE_HINTS:
        labelled = labelled | F.contains(lowered, F.lit(f"{hint}=")) | F.contains(lowered, F.lit(f'"{hint}":'))
    pair = text.rlike(r"-?\d{1,3}\.\d{4,}\s*,\s*-?\d{1,3}\.\d{4,}")
    return ~labelled & ~pair & ~text.rlike(r"\d{11,}")


def suppress_small_cohorts(rows: DataFrame, floor: int = MIN_COHORT_SIZE) -> DataFrame:
    return rows.filter(F.col("device_count") >= floor)


def suppressed_rows(rows: DataFrame, floor: int = MIN_COHORT_SIZE) -> DataFrame:
    return rows.agg(
        F.count_if(F.col("device_count") >= floor).alias("published"),
        F.count_if(~F.coalesce(F.col("device_count") >= floor, F.lit(False))).alias("suppressed"),
    )


@dataclass(frozen=True)
class Violation:
    code: str
    path: str


def _name_violations(name: str, path: str, free: bool) -> list[Violation]:
    lowered = name.lower()
    found = []
    if lowered in COORDINATE_FIELDS:
        found.append(Violation("COORDINATE_PRESENT", path))
    if lowered in IDENTIFIER_FIELDS:
        found.append(Violation("IDENTIFIER_PRESENT", path))
    if not free and name not in ALLOWED_FIELDS:
        found.append(Violation("FIELD_NOT_ALLOWLISTED", path))
    return found


def _value_checks(
    value: Column, kind: T.DataType, path: str, name: str | None
) -> list[tuple[str, str, Column]]:
    """Checks on one leaf as (code, path, boolean column), walking nested types."""
    checks: list[tuple[str, str, Column]] = []
    if name == "h3_resolution" and isinstance(kind, T.NumericType):
        checks.append(("H3_TOO_FINE", path, value > MAX_H3_RESOLUTION))
    if name == "device_count" and isinstance(kind, T.NumericType):
        checks.append(("COHORT_BELOW_FLOOR", path, (value > 0) & (value < MIN_COHORT_SIZE)))
    if isinstance(kind, T.StringType):
        checks.append(("COORDINATE_PRESENT", path, value.rlike(COORDINATE_VALUE)))
        checks.append(("IDENTIFIER_PRESENT", path, value.rlike(LONG_DIGITS)))
    elif isinstance(kind, T.StructType):
        for f in kind.fields:
            checks += _value_checks(value.getField(f.name), f.dataType, f"{path}/{f.name}", f.name.lower())
    elif isinstance(kind, T.ArrayType):
        element = kind.elementType
        inner = [
            (code, at)
            for code, at, _ in _value_checks(F.lit(None).cast(element), element, f"{path}/*", None)
        ]

        def element_check(position: int):
            return lambda x: F.coalesce(
                _value_checks(x, element, f"{path}/*", None)[position][2], F.lit(False)
            )

        for i, (code, at) in enumerate(inner):
            checks.append((code, at, F.exists(value, element_check(i))))
    elif isinstance(kind, T.MapType):
        checks.append(
            ("COORDINATE_PRESENT", f"{path}/*", F.exists(F.map_keys(value), lambda k: k.rlike(COORDINATE_VALUE)))
        )
        checks.append(
            ("IDENTIFIER_PRESENT", f"{path}/*", F.exists(F.map_keys(value), lambda k: k.rlike(LONG_DIGITS)))
        )
        lowered = F.transform(F.map_keys(value), lambda k: F.lower(k))
        checks.append(
            ("COORDINATE_PRESENT", f"{path}/*", F.arrays_overlap(lowered, F.array(*map(F.lit, COORDINATE_FIELDS))))
        )
        checks.append(
            ("IDENTIFIER_PRESENT", f"{path}/*", F.arrays_overlap(lowered, F.array(*map(F.lit, IDENTIFIER_FIELDS))))
        )
        if name not in FREE_KEY_PARENTS:
            strange = F.array_except(F.map_keys(value), F.array(*map(F.lit, ALLOWED_FIELDS)))
            checks.append(("FIELD_NOT_ALLOWLISTED", f"{path}/*", F.size(strange) > 0))
        if isinstance(kind.valueType, T.StringType):
            values = F.map_values(value)
            looks_placed = F.exists(values, lambda v: F.coalesce(v.rlike(COORDINATE_VALUE), F.lit(False)))
            looks_named = F.exists(values, lambda v: F.coalesce(v.rlike(LONG_DIGITS), F.lit(False)))
            checks.append(("COORDINATE_PRESENT", f"{path}/*", looks_placed))
            checks.append(("IDENTIFIER_PRESENT", f"{path}/*", looks_named))
    elif isinstance(kind, (T.DoubleType, T.FloatType)) and name is None:
        # An unlabelled number in the range and precision of a coordinate.
        text = F.abs(value).cast("decimal(38,18)").cast("string")
        decimals = F.length(F.regexp_extract(text, r"\.(\d*?)0*$", 1))
        checks.append(
            ("COORDINATE_PRESENT", path, (F.abs(value) > 0) & (F.abs(value) <= 180) & (decimals >= 4))
        )
    return checks


def _field_names(kind: T.DataType, path: str, free: bool = False) -> list[Violation]:
    found: list[Violation] = []
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            at = f"{path}/{f.name}"
            found += _name_violations(f.name, at, free)
            found += _field_names(f.dataType, at, f.name in FREE_KEY_PARENTS)
    elif isinstance(kind, T.ArrayType):
        found += _field_names(kind.elementType, f"{path}/*", free)
    elif isinstance(kind, T.MapType):
        found += _field_names(kind.valueType, f"{path}/*", free)
    return found


def check_redaction(sections: Mapping[str, DataFrame]) -> list[Violation]:
    """Everything in the sections that could identify a person or a vehicle, as paths only.

    Field names come from the schema; values of every leaf are tested in one aggregate per section.
    """
    found: list[Violation] = []
    for section, rows in sections.items():
        root = f"/sections/{section}"
        found += _field_names(rows.schema, root)
        checks = []
        for f in rows.schema.fields:
            checks += _value_checks(F.col(f"`{f.name}`"), f.dataType, f"{root}/{f.name}", f.name.lower())
        if checks:
            hits = rows.agg(
                *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"c{i}") for i, (_, _, c) in enumerate(checks)]
            ).first()
            found += [Violation(code, at) for (code, at, _), hit in zip(checks, hits, strict=True) if hit]
    return list(dict.fromkeys(found))


def section_hash(rows: DataFrame) -> DataFrame:
    """Order-free sha256 of a published section.

    Row hashes are sorted and hashed inside 4,096 buckets by their own prefix, then the bucket
    hashes are hashed in order; no task gathers a whole section.
    """
    each = F.sha2(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}), 256)
    buckets = (
        rows.select(each.alias("h"))
        .groupBy(F.substring("h", 1, 3).alias("bucket"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("b"),
        )
    )
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("bucket", "b"))), lambda x: x["b"])
    return buckets.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows"),
        F.sha2(F.array_join(ordered, ""), 256).alias("sha256"),
    )


@dataclass
class Bundle:
    """A bundle that passed, or the violations that stopped it."""

    ok: bool
    sections: dict[str, DataFrame]
    violations: list[Violation]
    contents: list[str]
    content_hashes: dict[str, str]
    suppressed: int
    manifest: dict = field(default_factory=dict)


def emit_bundle(
    sections: Mapping[str, DataFrame],
    manifest: Mapping[str, object],
    single_rows: tuple[str, ...] = (),
) -> Bundle:
    """Suppress small cohorts, check, hash and list; refuse on any violation.

    ``single_rows`` names sections that are one aggregate: below the floor they are dropped whole.
    A section without ``device_count`` is never suppressed.
    """
    kept: dict[str, DataFrame] = {}
    suppressed = 0
    for name, rows in sections.items():
        if "device_count" not in rows.columns:
            kept[name] = rows
            continue
        counts = suppressed_rows(rows).first()
        suppressed += counts["suppressed"]
        if name in single_rows and counts["suppressed"]:
            continue
        kept[name] = suppress_small_cohorts(rows)
    violations = check_redaction(kept)
    hashes, contents = {}, [
        f"manifest: bundle {BUNDLE_VERSION}",
        f"thresholds: H3 res <= {MAX_H3_RESOLUTION}, cohort >= {MIN_COHORT_SIZE} devices",
    ]
    for name, rows in kept.items():
        result = section_hash(rows).first()
        hashes[name] = result["sha256"]
        contents.append(f"{name}: {result['rows']} row(s), sha256 {result['sha256'][:12]}")
    contents.append(
        f"{suppressed} row(s) suppressed for falling below the cohort floor" if suppressed else "no rows suppressed"
    )
    full = {
        "bundle_version": BUNDLE_VERSION,
        "thresholds": {
            "max_h3_resolution": MAX_H3_RESOLUTION,
            "min_cohort_size": MIN_COHORT_SIZE,
            "min_time_bucket_s": MIN_TIME_BUCKET_S,
        },
        **manifest,
        "content_hashes": hashes,
    }
    ok = not violations
    return Bundle(ok, kept if ok else {}, violations, contents, hashes, suppressed, full)


def write_bundle(bundle: Bundle, path: str) -> None:
    """Write the sections of a bundle that passed; checked again, approval is no bypass."""
    if not bundle.ok or check_redaction(bundle.sections):
        raise PermissionError("refusing to write a bundle with redaction violations")
    for name, rows in bundle.sections.items():
        rows.write.mode("overwrite").json(f"{path}/sections/{name}")
