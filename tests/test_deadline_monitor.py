"""The live monitor against a plain reading of all reports, whatever their order of arrival."""

import random
import tempfile
from datetime import datetime, timezone

import pytest

from quietwatch.streaming import deadline

SCHEMA = "device_ref string, at_ms bigint, deadline_ms bigint, received_at timestamp"
DAY = deadline.DAY_MS


def by_hand(reports, clock):
    found = set()
    for device in {r[0] for r in reports}:
        due = {}
        for d, at, dl in reports:
            if d == device:
                due[at] = max(dl, due.get(at, dl))
        order = sorted(due)
        for a, b in zip(order, order[1:]):
            if b > due[a]:
                found.add((device, a, b, due[a]))
        if due[order[-1]] < clock:
            found.add((device, order[-1], None, due[order[-1]]))
    return found


def run(spark, batches, **options):
    base, out = tempfile.mkdtemp(prefix="quietwatch-mon-"), tempfile.mkdtemp(prefix="quietwatch-mon-out-")
    for received, rows in batches:
        at = datetime.fromtimestamp(received / 1000, timezone.utc)
        spark.createDataFrame([(*r, at) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(base)
        stream = spark.readStream.schema(SCHEMA).parquet(base)
        (
            deadline.monitor_deadlines(deadline.on_clock(stream, "received_at"), **options)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}/cp")
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )
    return spark.read.schema(deadline.OUTPUT_SCHEMA).parquet(out)


def current(changes):
    return {tuple(r) for r in deadline.current_episodes(changes).collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_any_order_of_arrival_gives_the_batch_result(spark, seed):
    rng = random.Random(seed)
    reports = []
    for d in range(5):
        at = DAY * 10
        for _ in range(30):
            at += rng.choice([0, 1000, 60_000, DAY // 3, DAY // 2, 2 * DAY])
            reports.append((f"d{d}", at, at + rng.choice([30_000, DAY // 4, DAY])))
    rng.shuffle(reports)
    clock = max(r[1] for r in reports)
    cut = [reports[i::4] for i in range(4)]
    changes = run(spark, [(clock - (3 - i) * DAY, rows) for i, rows in enumerate(cut)], keep_days=None)
    assert current(changes) == by_hand(reports, clock)
    actions = {r.action for r in changes.select("action").distinct().collect()}
    assert actions == {"opened", "recovered", "withdrawn"}


def test_a_late_report_withdraws_an_opening(spark):
    minute = 60_000
    changes = run(
        spark,
        [
            (DAY, [("a", 100 * minute, 110 * minute), ("b", 100 * minute, 110 * minute)]),
            (2 * DAY, [("a", 105 * minute, 3 * DAY), ("b", 130 * minute, 3 * DAY)]),
            (2 * DAY, [("b", 120 * minute, 131 * minute)]),
        ],
    )
    rows = [tuple(r)[:5] for r in changes.orderBy("device_ref", "seq").collect()]
    assert rows == [
        ("a", 1, "opened", 100 * minute, None),
        ("a", 2, "withdrawn", 100 * minute, None),
        ("b", 1, "opened", 100 * minute, None),
        ("b", 2, "recovered", 100 * minute, 130 * minute),
        ("b", 3, "recovered", 100 * minute, 120 * minute),
    ]
    assert current(changes) == {("b", 100 * minute, 120 * minute, 110 * minute)}


def test_reports_before_the_kept_history_are_named(spark):
    hour = DAY // 24
    changes = run(
        spark,
        [
            (10 * DAY, [("a", 2 * DAY, 2 * DAY + hour), ("a", 3 * DAY, 3 * DAY + hour), ("a", 10 * DAY, 30 * DAY)]),
            (10 * DAY, [("a", 2 * DAY + 2 * hour, 3 * DAY), ("a", 3 * DAY + 2 * hour, 4 * DAY)]),
        ],
        keep_days=3,
    )
    late = [r.start_ms for r in changes.filter("action = 'too_late'").collect()]
    assert late == [2 * DAY + 2 * hour]
    assert current(changes) == {
        ("a", 2 * DAY, 3 * DAY, 2 * DAY + hour),
        ("a", 3 * DAY, 3 * DAY + 2 * hour, 3 * DAY + hour),
        ("a", 3 * DAY + 2 * hour, 10 * DAY, 4 * DAY),
    }
