"""Overlapping intervals of a key flattened to disjoint segments, each with the one interval that holds there.

Once intervals are disjoint, the one at an instant is the last that starts at or before it: a search in a sorted array
or one merge in time order, without candidates to compare.  A sweep reads the intervals of a key by their start and
keeps those in force; its memory is what is in force at one instant.  Keys with more than ``hot_rows`` intervals are
swept by many tasks: each range first reports what is in force at its end, a small pass carries that along the ranges,
and each range then sweeps its own with what it was handed.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quietwatch.functions.ordered import HOT_ROWS
from quietwatch.session import written

START, END, ORDER, RANK, VALUE = "_start", "_end", "_order", "_rank", "_value"
FROM, TO = "_from", "_to"
#: Segments of a key are searched by blocks of so many, first the block, then inside it.
BLOCK = 256
_BATCH = 10_000


class _Sweep:
    """What is in force, the strongest first; a piece goes out when another interval takes its place."""

    def __init__(self, active: Iterable[tuple[int, int, object]] = (), at: int | None = None):
        self.heap: list[tuple] = [(-rank, -n, end, value) for n, (rank, end, value) in enumerate(active)]
        heapq.heapify(self.heap)
        self.at = at
        self.count = len(self.heap)
        self.piece: tuple | None = None  # entry, from, to

    def to(self, instant: int | None, emit) -> None:
        """Go on to an instant, or to the end of all intervals."""
        while self.heap and (instant is None or self.at < instant):
            entry = self.heap[0]
            if entry[2] <= self.at:
                heapq.heappop(self.heap)
                continue
            stop = entry[2] if instant is None else min(entry[2], instant)
            if self.piece and self.piece[0] is entry and self.piece[2] == self.at:
                self.piece = (entry, self.piece[1], stop)
            else:
                self.flush(emit)
                self.piece = (entry, self.at, stop)
            self.at = stop
        if instant is not None:
            self.at = instant

    def flush(self, emit) -> None:
        if self.piece:
            emit(self.piece[1], self.piece[2], self.piece[0][3])
        self.piece = None

    def add(self, rank: int, end: int, value) -> None:
        self.count += 1
        heapq.heappush(self.heap, (-rank, -self.count, end, value))

    def in_force(self) -> list[tuple[int, int, object]]:
        """What can still hold later: an interval that ends no later than a stronger one cannot."""
        out, reach = [], None
        for negative, _, end, value in sorted(self.heap, key=lambda e: e[:2]):
            if end > self.at and (reach is None or end > reach):
                out.append((-negative, end, value))
                reach = end
        return out


def _rows(batches: Iterable[pa.RecordBatch], names: Sequence[str]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch[n].to_pylist() for n in names), strict=True)


def _batches(rows: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == _BATCH:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _swept(rows: Iterable[tuple], width: int, ranked: bool, carry=(), at=None, until=None) -> Iterator[tuple]:
    """Segments of sorted rows (key columns, start, end, rank, value); the first key goes on with ``carry`` from ``at``
    and the last one ends at ``until``."""
    out: list[tuple] = []
    sweep, key = None, None
    for n, row in enumerate(rows):
        start, end, rank, value = row[width:]
        if sweep is None or row[:width] != key:
            if sweep is not None:
                sweep.to(None, emit)
                sweep.flush(emit)
            sweep = _Sweep(carry, at) if key is None and carry else _Sweep(at=start)
            key = row[:width]
            own = key

            def emit(begin, stop, found, own=own):
                out.append((*own, begin, stop, found))

        sweep.to(start, emit)
        sweep.add(rank if ranked else n, end, value)
        if len(out) >= _BATCH:
            yield from out
            out.clear()
    if sweep is not None:
        sweep.to(until, emit)
        sweep.flush(emit)
    yield from out


def disjoint(intervals: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """``keys``, ``_from``, ``_to``, ``_value`` of disjoint segments.

    ``intervals`` has ``keys``, ``_start`` and ``_end`` (bigint, half-open, no NULL, start before end), ``_order`` and
    ``_value``; of intervals in force together the one with the highest ``_rank`` holds, or, without that column, the
    one that starts last, then the highest ``_order``.  Equal ranks go to the later start.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    keys = list(keys)
    ranked = RANK in intervals.columns
    rows = intervals.select(
        *keys, START, END, F.col(RANK).cast("bigint") if ranked else F.lit(0).cast("bigint").alias(RANK), VALUE, ORDER
    )
    segment = T.StructType(
        [rows.schema[k] for k in keys]
        + [T.StructField(FROM, T.LongType()), T.StructField(TO, T.LongType()), rows.schema[VALUE]]
    )
    target = to_arrow_schema(segment)
    names, width = [*keys, START, END, RANK, VALUE], len(keys)

    def sweep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(_swept(_rows(batches, names), width, ranked), target)

    hot = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows).drop("_n")
    if hot.isEmpty():
        return rows.repartition(*keys).sortWithinPartitions(*keys, START, ORDER).mapInArrow(sweep, segment)
    cold = rows.join(hot, keys, "left_anti").repartition(*keys).sortWithinPartitions(*keys, START, ORDER)
    return cold.mapInArrow(sweep, segment).unionByName(
        _disjoint_ranges(rows.join(hot, keys, "left_semi"), keys, names, segment, target, ranked)
    )


def _disjoint_ranges(rows, keys, names, segment, target, ranked) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    width = len(keys)
    active = T.ArrayType(
        T.StructType(
            [T.StructField(RANK, T.LongType()), T.StructField(END, T.LongType()), rows.schema[VALUE]]
        )
    )
    ranged = written(
        rows.repartitionByRange(*keys, START, ORDER)
        .sortWithinPartitions(*keys, START, ORDER)
        .select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_place"))
        .withColumn("_key", F.to_json(F.struct(*keys))),
        "interval-ranges",
    )
    tail_type = T.StructType(
        [
            T.StructField("_range", T.IntegerType()),
            T.StructField("first_key", T.StringType()),
            T.StructField("last_key", T.StringType()),
            T.StructField("first_start", T.LongType()),
            T.StructField("active", active),
        ]
    )
    carry_type = T.StructType(
        [tail_type["_range"], tail_type["active"], T.StructField("at", T.LongType()), T.StructField("until", T.LongType())]
    )
    tail_schema, carry_schema = to_arrow_schema(tail_type), to_arrow_schema(carry_type)

    def in_order(table: pa.Table) -> pa.Table:
        return table.sort_by("_place")

    def as_active(found) -> list[dict]:
        return [{RANK: r, END: e, VALUE: v} for r, e, v in found]

    def tail(table: pa.Table) -> pa.Table:
        """What the last key of a range has in force at the last start there, from this range alone."""
        table = in_order(table)
        own = table["_key"].to_pylist()
        begin = own.index(own[-1])
        last = table.slice(begin)
        sweep = _Sweep(at=last[START][0].as_py())
        for n, (start, end, rank, value) in enumerate(_rows(last.to_batches(), names[width:])):
            sweep.at = start
            sweep.add(rank if ranked else n, end, value)
        row = (table["_range"][0].as_py(), own[0], own[-1], table[START][0].as_py(), as_active(sweep.in_force()))
        return pa.Table.from_batches([_batch([row], tail_schema)])

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What each range is handed, and where its last key is taken on; rows as many as ranges."""

        def handed():
            before, key, held = [], None, None
            for number, first, last, start, found in _rows(batches, tail_schema.names):
                goes_on = key == first
                if held:
                    yield (*held, start if goes_on else None)
                carried = _Sweep([(a[RANK], a[END], a[VALUE]) for a in before], start).in_force() if goes_on else []
                # without ranks what comes from earlier ranges is weaker than all that starts here
                given = [(r if ranked else n - len(carried), e, v) for n, (r, e, v) in enumerate(reversed(carried))]
                held = (number, as_active(given), start)
                stay = given if first == last else []
                both = [*stay, *((a[RANK], a[END], a[VALUE]) for a in found)]
                merged = _Sweep([(r if ranked else n, e, v) for n, (r, e, v) in enumerate(_by_rank(both))], start)
                before, key = as_active(merged.in_force()), last
            if held:
                yield (*held, None)

        yield from _batches(handed(), carry_schema)

    def finish(table: pa.Table, carry: pa.Table) -> pa.Table:
        (given,) = carry.to_pylist()
        held = [(a[RANK], a[END], a[VALUE]) for a in given["active"]]
        found = _swept(_rows(in_order(table).to_batches(), names), width, ranked, held, given["at"], given["until"])
        return pa.Table.from_batches(_batches(found, target), schema=target)

    tails = ranged.groupBy("_range").applyInArrow(tail, tail_type)
    carry = written(
        tails.repartition(1).sortWithinPartitions("_range").mapInArrow(fold, carry_type), "interval-carry"
    )
    return ranged.groupBy("_range").cogroup(carry.groupBy("_range")).applyInArrow(finish, segment)


def _by_rank(found: Sequence[tuple]) -> list[tuple]:
    return sorted(found, key=lambda f: f[0])


def searchable(segments: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The first instants of a key's blocks (``_firsts``), and the blocks by ``keys`` and ``_block`` (``_segments``).

    A probe row meets one short array and one block, never the whole history of its key.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(FROM)) - 1
    blocks = (
        segments.withColumn("_block", F.floor(place / BLOCK))
        .groupBy(*keys, "_block")
        .agg(F.sort_array(F.collect_list(F.struct(FROM, TO, VALUE))).alias("_segments"))
    )
    firsts = blocks.groupBy(*keys).agg(F.sort_array(F.collect_list(F.get("_segments", F.lit(0))[FROM])).alias("_firsts"))
    return firsts, blocks


def _not_after(items: str, first: Callable[[Column], Column], instant: Column, most: int) -> Column:
    """How many of the sorted items start at or before the instant: a binary search, halving steps down to one."""
    steps = F.array(*[F.lit(1 << k) for k in range(most.bit_length() - 1, -1, -1)])

    def onward(found: Column, step: Column) -> Column:
        there = F.get(items, found + step - 1)
        return F.when(first(there) <= instant, found + step).otherwise(found)

    return F.aggregate(steps, F.lit(0), onward)


def block_at(instant: Column) -> Column:
    """The block that an instant falls into, -1 before the first one."""
    return _not_after("_firsts", lambda first: first, instant, 1 << 22).cast("bigint") - 1


def found_at(instant: Column) -> Column:
    """The value in ``_segments`` at an instant in milliseconds, NULL where nothing is in force."""
    segment = F.get("_segments", _not_after("_segments", lambda s: s[FROM], instant, BLOCK) - 1)
    return F.when(instant < segment[TO], segment[VALUE])
