"""Ordered work per key that survives a hot key.

A window over ``partitionBy(key)`` puts a whole key in one task.  The rows of keys with more than
``hot_rows`` rows are therefore dealt out by ranges of ``(key, order)`` and cut into slices of equal
count: a slice begins with each ``hot_rows``-th row of its range and with each new range.  So no slice
holds more than ``hot_rows`` rows, whatever the instants are: an outlier does not widen a slice, and
equal instants are cut by the next order column.  The window runs over ``(key, slice)``, and only the
value that crosses a slice border travels in a side table, a segmented scan over the slices.

Size of the side tables: ``N`` rows hold fewer than ``N / hot_rows`` hot keys and at most ``N / hot_rows``
slices more than there are ranges and hot keys.  A side table is broadcast where that bound, known from
a count, is at most ``MAX_SIDE_ROWS``, and joined by a shuffle beyond.  Without hot keys none of the
side tables is planned at all.  NULL keys are one key like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 500_000

#: Rows, of some dozen bytes, up to which a side table is broadcast.
MAX_SIDE_ROWS = 200_000

#: Rows of one task; where the session's shuffle partitions would hold more, there are more partitions.
ROWS_PER_TASK = 1_000_000

SLICE = "_slice"
_HOT = "_hot"
_TIE = "_tie"
#: Bits of ``monotonically_increasing_id`` that number the rows of one partition.
_ROW_BITS = 33


@dataclass(frozen=True)
class Sliced:
    """Rows with a slice number, whether any key needed slicing, and a bound on the number of slices."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]
    has_hot: bool
    slices: int = 0

    @property
    def window(self):
        return Window.partitionBy(*self.keys, SLICE).orderBy(*self.order)

    def hot_rows(self) -> DataFrame:
        return self.rows.filter(_HOT)

    def with_rows(self, rows: DataFrame) -> Sliced:
        return Sliced(rows, self.keys, self.order, self.has_hot, self.slices)

    def finished(self) -> DataFrame:
        return self.rows.drop(SLICE, _HOT, _TIE)

    def join_side(self, side: DataFrame, names: Sequence[str], rows: DataFrame | None = None) -> DataFrame:
        """Left join with a side table of at most a row for each slice."""
        return _join_side(self.rows if rows is None else rows, side, names, self.slices)


def _join_side(rows: DataFrame, side: DataFrame, names: Sequence[str], bound: int) -> DataFrame:
    """Left join on ``names`` in which NULL meets NULL; the side is broadcast if its bound allows."""
    there = {n: f"_side_{n}" for n in names}
    side = side.withColumnsRenamed(there)
    on = [rows[n].eqNullSafe(side[there[n]]) for n in names]
    return rows.join(F.broadcast(side) if bound <= MAX_SIDE_ROWS else side, on, "left").drop(*there.values())


def spread(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Rows partitioned by their keys so that a task sorts about ``ROWS_PER_TASK`` of them, however many there are."""
    tasks = -(-rows // ROWS_PER_TASK)
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(tasks, *keys) if tasks > usual else df


def slice_hot_keys(
    df: DataFrame,
    keys: Sequence[str],
    time_ms: str,
    order: Sequence[str],
    hot_rows: int = HOT_ROWS,
) -> Sliced:
    """Number slices so that no ``(key, slice)`` of a hot key holds more than ``hot_rows`` rows.

    ``order`` must start with ``time_ms``.  Slice numbers rise with the order.  Rows equal in the whole
    order are told apart by a hash of all their columns, so a task that runs again cuts them alike.
    """
    keys, order = tuple(keys), tuple(order)
    if order[0] != time_ms:
        raise ValueError("order must start with the time")
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    is_hot = F.col("_n") > hot_rows
    number, total, rows = counts.agg(
        F.count_if(is_hot), F.coalesce(F.sum(F.when(is_hot, F.col("_n"))), F.lit(0)), F.coalesce(F.sum("_n"), F.lit(0))
    ).first()
    hot = counts.filter(is_hot)
    if not number:
        return Sliced(spread(df, keys, rows).withColumn(SLICE, F.lit(0).cast("bigint")), keys, order, False)
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    marked = _join_side(df, hot.select(*keys, F.lit(True).alias(_HOT)), keys, number)
    cold = marked.filter(F.col(_HOT).isNull()).withColumns(
        {_HOT: F.lit(False), _TIE: F.lit(0).cast("bigint"), SLICE: F.lit(0).cast("bigint")}
    )
    place = F.monotonically_increasing_id()
    in_range = place.bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    dealt = marked.filter(_HOT).withColumn(_TIE, F.xxhash64(*df.columns))
    dealt = (
        dealt.repartitionByRange(*keys, *order, _TIE)
        .sortWithinPartitions(*keys, *order, _TIE)
        # the range above, the slice inside it below: numbers rise along each key
        .withColumn(SLICE, place - in_range + F.floor(in_range / hot_rows))
    )
    slices = total // hot_rows + number + ranges
    return Sliced(cold.unionByName(dealt), keys, (*order, _TIE), True, slices)


def _neighbour(sliced: Sliced, value: Column, name: str, forward: bool) -> Sliced:
    step = F.lead if forward else F.lag
    rows = sliced.rows.withColumn(name, step(value).over(sliced.window))
    if sliced.has_hot:
        position = F.struct(*[F.col(c) for c in sliced.order])
        edge = F.min_by if forward else F.max_by
        across = Window.partitionBy(*sliced.keys).orderBy(SLICE)
        carry = (
            sliced.hot_rows()
            .groupBy(*sliced.keys, SLICE)
            .agg(edge(value, position).alias("_edge"))
            .select(*sliced.keys, SLICE, step("_edge").over(across).alias("_carry"))
        )
        rows = (
            sliced.join_side(carry, [*sliced.keys, SLICE], rows)
            .withColumn(name, F.coalesce(name, "_carry"))
            .drop("_carry")
        )
    return sliced.with_rows(rows)


def with_previous(sliced: Sliced, value: Column, name: str) -> Sliced:
    """``lag`` of a never-NULL value (a struct) over the whole key."""
    return _neighbour(sliced, value, name, forward=False)


def with_next(sliced: Sliced, value: Column, name: str) -> Sliced:
    """``lead`` of a never-NULL value (a struct) over the whole key."""
    return _neighbour(sliced, value, name, forward=True)


def with_running_max(sliced: Sliced, value: Column, name: str, include_self: bool) -> Sliced:
    """Maximum over the rows before this one (or up to and including it) within the key."""
    end = 0 if include_self else -1
    frame = sliced.window.rowsBetween(Window.unboundedPreceding, end)
    rows = sliced.rows.withColumn(name, F.max(value).over(frame))
    if sliced.has_hot:
        across = (
            Window.partitionBy(*sliced.keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            sliced.hot_rows()
            .groupBy(*sliced.keys, SLICE)
            .agg(F.max(value).alias("_edge"))
            .select(*sliced.keys, SLICE, F.max("_edge").over(across).alias("_carry"))
        )
        rows = (
            sliced.join_side(carry, [*sliced.keys, SLICE], rows)
            .withColumn(name, F.greatest(name, "_carry"))
            .drop("_carry")
        )
    return sliced.with_rows(rows)


def with_last_seen(sliced: Sliced, value: Column, name: str) -> Sliced:
    """Latest non-NULL value at or before this row within the key."""
    frame = sliced.window.rowsBetween(Window.unboundedPreceding, 0)
    rows = sliced.rows.withColumn(name, F.last(value, ignorenulls=True).over(frame))
    if sliced.has_hot:
        position = F.struct(*[F.col(c) for c in sliced.order])
        across = (
            Window.partitionBy(*sliced.keys)
            .orderBy(SLICE)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            sliced.hot_rows()
            .groupBy(*sliced.keys, SLICE)
            .agg(F.max_by(value, F.when(value.isNotNull(), position)).alias("_edge"))
            .select(
                *sliced.keys, SLICE, F.last("_edge", ignorenulls=True).over(across).alias("_carry")
            )
        )
        rows = (
            sliced.join_side(carry, [*sliced.keys, SLICE], rows)
            .withColumn(name, F.coalesce(name, "_carry"))
            .drop("_carry")
        )
    return sliced.with_rows(rows)


def with_all_true(sliced: Sliced, flag: Column, name: str) -> Sliced:
    """Whether ``flag`` holds on every row of the key, repeated on each row."""
    whole = Window.partitionBy(*sliced.keys, SLICE)
    rows = sliced.rows.withColumn(name, F.bool_and(flag).over(whole))
    if sliced.has_hot:
        carry = (
            sliced.hot_rows().groupBy(*sliced.keys).agg(F.bool_and(flag).alias("_carry"))
        )
        rows = (
            sliced.join_side(carry, list(sliced.keys), rows)
            .withColumn(name, F.coalesce("_carry", name))
            .drop("_carry")
        )
    return sliced.with_rows(rows)


def prefix_states(
    items: Column,
    first: Column,
    step: Callable[[Column, Column], Column],
    chunk: int = 256,
    kind: str = "int",
) -> Column:
    """State before each item of a left fold over an array; ``kind`` is the type of the state.

    Appending to one long accumulator copies it each time, so the fold runs over chunks and only
    joins their results; the cost stays close to linear.
    """
    def state(value: Column) -> Column:
        return value.cast(kind)

    empty = F.array().cast(f"array<{kind}>")
    chunks = F.sequence(F.lit(0), F.greatest(F.floor((F.size(items) - 1) / chunk), F.lit(0)))

    def run_chunk(accumulated: Column, index: Column) -> Column:
        part = F.slice(items, (index * chunk + 1).cast("int"), F.lit(chunk))
        done = F.aggregate(
            part,
            F.struct(accumulated["state"].alias("state"), empty.alias("seen")),
            lambda acc, item: F.struct(
                state(step(acc["state"], item)).alias("state"),
                F.concat(acc["seen"], F.array(acc["state"])).alias("seen"),
            ),
        )
        return F.struct(
            done["state"].alias("state"),
            F.concat(accumulated["parts"], F.array(done["seen"])).alias("parts"),
        )

    start = F.struct(
        state(first).alias("state"), F.array().cast(f"array<array<{kind}>>").alias("parts")
    )
    return F.flatten(F.aggregate(chunks, start, run_chunk)["parts"])
