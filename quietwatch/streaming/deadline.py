"""Live deadline monitor: silence becomes an episode when its deadline passes, and late reports revise it.

The clock of the monitor is receipt time: a deadline has passed when reports received later than it (and a delay) are
there.  Only that clock carries the watermark.  The reports themselves have none, so Spark drops no report, however
late it comes; it is laid into the device's history, and the episodes beside it are opened, closed anew or withdrawn.

The output is a log of changes.  The last row of a device and start says what holds, see ``current_episodes``: the same
relation, whatever the order in which the reports came, and the one that a batch over all reports gives.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quietwatch.functions.scalars import ms
from quietwatch.operators.policy import ReportingPolicy, deadline_ms, interval_for, motion_state

OUTPUT_SCHEMA = (
    "device_ref string, seq bigint, action string, start_ms bigint, end_ms bigint, deadline_ms bigint"
)
_REPORT = "device_ref", "at_ms", "deadline_ms"
_EDGE_SCHEMA = (
    "last_ms bigint, deadline_ms bigint, is_open boolean, seq bigint, floor_ms bigint, floor_deadline_ms bigint,"
    " parts binary"
)
_CHANGE = Row("device_ref", "seq", "action", "start_ms", "end_ms", "deadline_ms")
DAY_MS = 86_400_000
KEEP_DAYS = 30
#: Reports in a part of a device's history, at most.
PART_REPORTS = 2_048
#: What a report without a time or deadline counts as.
NO_TIME = np.iinfo(np.int64).min


def on_clock(reports: DataFrame, clock: str | Column, delay: str = "0 seconds") -> DataFrame:
    """Reports (``device_ref, at_ms, deadline_ms``) for the monitor, with ``clock`` as its only watermark.

    The clock is watched on a branch of the stream that gives no row; the reports pass beside it.
    """
    clock = F.col(clock) if isinstance(clock, str) else clock
    ticks = reports.withColumn("clock", clock).withWatermark("clock", delay).filter(F.col("clock").isNull())
    rows = reports.withColumn("clock", F.lit(None).cast("timestamp"))
    return ticks.select(*_REPORT, "clock").unionByName(rows.select(*_REPORT, "clock"))


def reports_with_deadline(
    events: DataFrame, policy: ReportingPolicy, lag_p95_s: float = 0.0, delay: str = "0 seconds"
) -> DataFrame:
    """The stream a monitor needs: device, report time, the deadline that report sets, and the receipt clock."""
    chosen = policy.column()
    at = ms(F.coalesce("device_time", "received_at"))
    reports = events.select(
        "device_ref",
        at.alias("at_ms"),
        deadline_ms(
            at, interval_for(chosen, motion_state()), chosen["grace_factor"], lag_p95_s
        ).alias("deadline_ms"),
        "received_at",
    )
    return on_clock(reports, "received_at", delay)


def _distinct(at: np.ndarray, due: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Reports in order; of those at one instant the latest deadline holds."""
    order = np.lexsort((due, at))
    at, due = at[order], due[order]
    last = np.append(at[1:] != at[:-1], True) if len(at) else np.zeros(0, bool)
    return at[last], due[last]


def _gaps(at: np.ndarray, due: np.ndarray) -> dict[int, tuple[int | None, int]]:
    """Closed episodes by their start: end and deadline."""
    missed = np.flatnonzero(at[1:] > due[:-1])
    return {int(at[i]): (int(at[i + 1]), int(due[i])) for i in missed}


class DeadlineMonitor(StatefulProcessor):
    """History of a device in parts, and its last report with a timer on its deadline.

    A part holds a run of at most ``PART_REPORTS`` reports; the edge lists the parts by number and first instant.  Each
    call to the state store is a round trip, so a batch reads and writes only the parts its reports fall into, most
    often one: what lies beside a part is known from the list.

    Reports are kept for ``keep_days`` before the clock, and the one before them.  A report older than that changes
    nothing and leaves as ``too_late``, so it can be handled by a batch.  ``keep_days`` of None keeps all.
    """

    def __init__(self, keep_days: int | None = KEEP_DAYS):
        self.keep_days = keep_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._edge = handle.getValueState("edge", _EDGE_SCHEMA)
        self._parts = handle.getMapState("parts", "part bigint", "reports binary")

    def _load(self, part: int) -> tuple[np.ndarray, np.ndarray]:
        both = np.frombuffer(bytes(self._parts.getValue((int(part),))[0]), np.int64).reshape(-1, 2)
        return both[:, 0], both[:, 1]

    def _store(self, part: int, at: np.ndarray, due: np.ndarray) -> None:
        self._parts.updateValue((int(part),), (np.column_stack([at, due]).tobytes(),))

    def _forget(self, parts: np.ndarray, cut: int) -> tuple[np.ndarray, int, int]:
        """The list of parts without the reports before ``cut``, and the last one of these."""
        n = int(np.searchsorted(parts[:, 1], cut))
        for part in parts[: n - 1, 0].tolist():
            self._parts.removeKey((part,))
        at, due = self._load(parts[n - 1, 0])
        gone = int(np.searchsorted(at, cut))
        rest = parts[n:]
        if gone < len(at):
            self._store(parts[n - 1, 0], at[gone:], due[gone:])
            rest = np.concatenate([[[parts[n - 1, 0], at[gone]]], rest])
        else:
            self._parts.removeKey((int(parts[n - 1, 0]),))
        return rest, int(at[gone - 1]), int(due[gone - 1])

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        (device,) = key
        read = [(NO_TIME if r.at_ms is None else r.at_ms, NO_TIME if r.deadline_ms is None else r.deadline_ms) for r in rows]
        at, due = _distinct(*np.array(read, np.int64).T)
        edge = self._edge.get() or (None, None, False, 0, None, None, b"")
        last, deadline, is_open, seq, floor, floor_due, listed = edge
        parts = np.frombuffer(bytes(listed), np.int64).reshape(-1, 2)
        out = []

        def put(action, start, end=None, due_at=None):
            nonlocal seq
            seq += 1
            out.append(_CHANGE(device, seq, action, start, end, due_at))

        clock = timerValues.getCurrentWatermarkInMs()
        if self.keep_days is not None and last is not None and clock > 0:
            cut = min(clock // DAY_MS - self.keep_days, last // DAY_MS) * DAY_MS
            if len(parts) and parts[0, 1] < cut:
                parts, floor, floor_due = self._forget(parts, cut)
            if floor is not None:
                early = at <= floor
                for t in at[early].tolist():
                    put("too_late", t)
                at, due = at[~early], due[~early]
        if len(at):
            before, after, listing = {}, {}, []
            newest, newest_due = last, deadline
            number = int(parts[:, 0].max()) + 1 if len(parts) else 0
            place = np.maximum(np.searchsorted(parts[:, 1], at, "right") - 1, 0)
            for k in range(max(len(parts), 1)):
                own = place == k
                if not own.any():
                    listing.append(parts[k : k + 1])
                    continue
                old_at, old_due = self._load(parts[k, 0]) if len(parts) else (at[:0], due[:0])
                new_at, new_due = _distinct(np.append(old_at, at[own]), np.append(old_due, due[own]))
                # long parts are halved until none is too long; the first piece keeps the number
                pieces = -(-len(new_at) // PART_REPORTS)
                cuts = [len(new_at) * i // pieces for i in range(pieces + 1)]
                for i in range(pieces):
                    piece = slice(cuts[i], cuts[i + 1])
                    name = parts[k, 0] if len(parts) and not i else number
                    number += name == number
                    self._store(name, new_at[piece], new_due[piece])
                    listing.append(np.array([[name, new_at[cuts[i]]]], np.int64))
                if k + 1 >= len(parts):
                    if last is None or new_at[-1] >= last:
                        newest, newest_due = int(new_at[-1]), int(new_due[-1])
                ends = [(floor, floor_due)] if floor is not None and not k else []
                starts = [(int(parts[k + 1, 1]), 0)] if k + 1 < len(parts) else []
                before |= _gaps(*_between(ends, old_at, old_due, starts))
                after |= _gaps(*_between(ends, new_at, new_due, starts))
            parts = np.concatenate(listing)
            still = is_open and (newest, newest_due) == (last, deadline)
            if is_open:
                before[last] = (None, deadline)
                if still:
                    after[last] = (None, deadline)
            for start in sorted(before.keys() | after.keys()):
                if start not in after:
                    put("withdrawn", start, None, before[start][1])
                elif after[start] != before.get(start):
                    put("recovered", start, *after[start])
            if not still:
                # an open silence has had its timer; otherwise one waits for the deadline
                waits = last is not None and not is_open
                if waits and deadline != newest_due:
                    self._handle.deleteTimer(deadline)
                if not waits or deadline != newest_due:
                    self._handle.registerTimer(newest_due)
            last, deadline, is_open = newest, newest_due, still
        if last is not None:
            self._edge.update((last, deadline, is_open, seq, floor, floor_due, parts.tobytes()))
        yield from out

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        (device,) = key
        last, deadline, is_open, seq, *rest = self._edge.get()
        if is_open or expiredTimerInfo.getExpiryTimeInMs() < deadline:
            return
        self._edge.update((last, deadline, True, seq + 1, *rest))
        yield _CHANGE(device, seq + 1, "opened", last, None, deadline)

    def close(self) -> None:
        pass


def _between(ends: list, at: np.ndarray, due: np.ndarray, starts: list) -> tuple[np.ndarray, np.ndarray]:
    """The reports of a part with the one before it, if any, and the one after it."""
    if not ends and not starts:
        return at, due
    first, last = (np.array(x, np.int64).reshape(-1, 2) for x in (ends, starts))
    return np.concatenate([first[:, 0], at, last[:, 0]]), np.concatenate([first[:, 1], due, last[:, 1]])


def monitor_deadlines(reports: DataFrame, keep_days: int | None = KEEP_DAYS) -> DataFrame:
    """Change log of a stream from ``reports_with_deadline`` or ``on_clock``: ``opened`` when a deadline passes,
    ``recovered`` when the next report is known (again, if a late report becomes it), ``withdrawn`` when a late report
    shows that there was no such silence, ``too_late`` for a report before the kept history.

    The session must use the RocksDB state store
    (``spark.sql.streaming.stateStore.providerClass``).
    """
    return reports.groupBy("device_ref").transformWithState(
        statefulProcessor=DeadlineMonitor(keep_days),
        outputStructType=OUTPUT_SCHEMA,
        outputMode="Append",
        timeMode="EventTime",
    )


def current_episodes(changes: DataFrame) -> DataFrame:
    """What holds after a log of changes: one row for a silence, its end NULL while it lasts."""
    newest = Window.partitionBy("device_ref", "start_ms").orderBy(F.desc("seq"))
    return (
        changes.filter(F.col("action") != "too_late")
        .withColumn("_n", F.row_number().over(newest))
        .filter((F.col("_n") == 1) & (F.col("action") != "withdrawn"))
        .select("device_ref", "start_ms", "end_ms", "deadline_ms")
    )
