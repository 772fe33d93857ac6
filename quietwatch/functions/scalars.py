"""Column builders shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The 95 % score used by both Wilson bounds, and the mean earth radius in metres.
WILSON_Z = 1.96
EARTH_RADIUS_M = 6_371_000.0


def ms(column: Column | str) -> Column:
    """Epoch milliseconds of a timestamp."""
    return F.unix_millis(F.col(column) if isinstance(column, str) else column)


def from_ms(column: Column | str) -> Column:
    return F.timestamp_millis(F.col(column) if isinstance(column, str) else column)


def seconds_between(later: Column | str, earlier: Column | str) -> Column:
    return (ms(later) - ms(earlier)) / F.lit(1000.0)


def round_half_up(column: Column) -> Column:
    """Nearest integer with halves going up; SQL ``round`` sends negative halves away from zero."""
    return F.floor(column + F.lit(0.5))


def ratio(numerator: Column, denominator: Column) -> Column:
    """NULL over an empty population: unknown, not zero."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def _wilson_parts(successes: Column, trials: Column) -> tuple[Column, Column, Column]:
    n = trials.cast("double")
    p = F.try_divide(successes.cast("double"), n)
    z2 = F.lit(WILSON_Z * WILSON_Z)
    scale = F.lit(1.0) + F.try_divide(z2, n)
    centre = p + F.try_divide(z2, F.lit(2.0) * n)
    margin = F.lit(WILSON_Z) * F.sqrt(
        F.try_divide(p * (F.lit(1.0) - p), n) + F.try_divide(z2, F.lit(4.0) * n * n)
    )
    return scale, centre, margin


def wilson_lower(successes: Column, trials: Column) -> Column:
    """Lower 95 % bound; 0 with no trials, NaN when successes exceed trials."""
    scale, centre, margin = _wilson_parts(successes, trials)
    return F.when(trials == 0, F.lit(0.0)).otherwise(
        F.greatest(F.lit(0.0), (centre - margin) / scale)
    )


def wilson_upper(successes: Column, trials: Column) -> Column:
    """Upper 95 % bound; 1 with no trials, NaN when successes exceed trials."""
    scale, centre, margin = _wilson_parts(successes, trials)
    bound = (centre + margin) / scale
    return F.when(trials == 0, F.lit(1.0)).otherwise(
        F.when(F.isnan(bound), bound).otherwise(F.least(F.lit(1.0), bound))
    )


def exceeds(bound: Column, threshold: Column) -> Column:
    """``bound > threshold`` with NaN never exceeding; Spark orders NaN above every number."""
    return F.when(F.isnan(bound), F.lit(False)).otherwise(bound > threshold)


def rate_struct(numerator: Column, denominator: Column) -> Column:
    """A proportion with its interval; all of it NULL over an empty population."""
    empty = denominator == 0
    return F.struct(
        numerator.cast("bigint").alias("numerator"),
        denominator.cast("bigint").alias("denominator"),
        ratio(numerator, denominator).alias("value"),
        F.when(~empty, wilson_lower(numerator, denominator)).alias("ci95_lower"),
        F.when(~empty, wilson_upper(numerator, denominator)).alias("ci95_upper"),
    )


def great_circle_m(lat_a: Column, lon_a: Column, lat_b: Column, lon_b: Column) -> Column:
    """Haversine distance in metres."""
    half_lat = F.radians(lat_b - lat_a) / 2
    half_lon = F.radians(lon_b - lon_a) / 2
    h = F.pow(F.sin(half_lat), 2) + F.cos(F.radians(lat_a)) * F.cos(F.radians(lat_b)) * F.pow(
        F.sin(half_lon), 2
    )
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def grid_cell(lat: Column, lon: Column, degrees: float) -> Column:
    """Square latitude/longitude cell id, standing in for a hexagon id."""
    return F.concat_ws(
        ":",
        F.lit(f"g{degrees:g}"),
        F.floor(lat / F.lit(degrees)).cast("string"),
        F.floor(lon / F.lit(degrees)).cast("string"),
    )


def any_of(flags: Iterable[Column]) -> Column:
    """Three-valued OR where a readable false beats an unreadable branch."""
    array = F.array(*flags)
    return (
        F.when(F.exists(array, lambda x: F.coalesce(x, F.lit(False))), F.lit(True))
        .when(F.exists(array, lambda x: F.coalesce(~x, F.lit(False))), F.lit(False))
        .otherwise(F.lit(None).cast("boolean"))
    )


def utc_iso(column: Column) -> Column:
    """ISO-8601 text with milliseconds."""
    return F.date_format(column, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def evaluate_once(df, columns: list[str] | None = None):
    """The same rows, with every column computed here and nowhere else.

    The optimizer copies the expression behind a column into each later filter on it, and an
    expression used by another is copied in turn; for parsed documents that multiplies the parsing.
    Passing a row through a one-element generator stops the copying without moving any data.
    """
    names = columns or df.columns
    return df.select(F.inline(F.array(F.struct(*names))))
