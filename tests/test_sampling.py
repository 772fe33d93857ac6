"""The sampler against a plain sequential reading of its rules, with and without hot devices."""

import random

import pytest
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators import episodes, quality
from quietwatch.operators.policy import ReportingPolicy, suppression_windows

POLICY = ReportingPolicy()
INTERVALS = {"moving": 60, "ignition_on": 120, "parked": 300, "sleep": 3600}
SCHEMA = (
    "device_ref string, received int, device int, lat double, valid boolean, motion string,"
    " sleep string, arrival bigint"
)


def random_rows(seed, devices=6, reports=60):
    rng = random.Random(seed)
    rows, arrival = [], 0
    for d in range(devices):
        at, lat = 0, 1.0
        for _ in range(reports):
            at += rng.choice([30, 60, 60, 80, 200, 1000, 4000])
            lat = lat if rng.random() < 0.8 else lat + 1
            device = at - rng.choice([0, 5, 10, 1200]) if d % 3 == 1 else at
            rows.append(
                (
                    f"dev_{d}",
                    at,
                    None if d % 3 == 2 and rng.random() < 0.1 else device,
                    None if rng.random() < 0.05 else lat,
                    rng.random() < 0.85,
                    rng.choice(["moving", "stationary", None]),
                    rng.choice(["awake", "awake", "deep_sleep", None]),
                    arrival,
                )
            )
            arrival += 1
    return rows


def events_frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).select(
        "device_ref",
        "arrival",
        from_ms((F.col("received") * 1000).cast("bigint")).alias("received_at"),
        from_ms((F.col("device") * 1000).cast("bigint")).alias("device_time"),
        F.struct("lat", F.lit(2.0).alias("lon"), "valid").alias("position"),
        F.struct(F.col("motion").alias("motion_state"), F.lit(None).cast("string").alias("ignition")).alias("motion"),
        F.struct(F.col("sleep").alias("sleep_state")).alias("device"),
    )


def sequential(rows):
    found = set()
    by_device = {}
    for r in rows:
        by_device.setdefault(r[0], []).append(r)
    for device, reports in by_device.items():
        reports.sort(key=lambda r: (r[1], r[7]))
        clocks = [r[2] for r in reports]
        usable = None not in clocks and all(a <= b for a, b in zip(clocks, clocks[1:]))
        run = 0
        for prev, cur in zip(reports, reports[1:]):
            a, b = (prev[2], cur[2]) if usable else (prev[1], cur[1])
            state = "sleep" if prev[6] == "deep_sleep" else "moving" if prev[5] == "moving" else "parked"
            run = run + 1 if prev[3] is not None and prev[3] == cur[3] else 0
            interval = INTERVALS[state]
            if b <= a + interval * 1.5:
                if run >= 3 and cur[4]:
                    found.add((device, "stale_position", a, b, 0))
                    run = 0
                if not cur[4]:
                    found.add((device, "gnss_only_loss", a, b, 0))
                continue
            held = cur[2] is not None and cur[1] - cur[2] > 900
            kind = "vendor_ingestion_delay" if held else "total_silence"
            found.add((device, kind, a, b, max(1, (b - a) // interval - 1)))
    return found


def sampled(frame, **options):
    found = episodes.sample_episodes(frame, POLICY, **options)
    return {
        (r.device_ref, r.type, r.s // 1000, r.e // 1000, r.missed_reports)
        for r in found.select(
            "device_ref", "type", ms("start_at").alias("s"), ms("end_at").alias("e"), "missed_reports"
        ).collect()
    }


@pytest.mark.parametrize("hot_rows", [500_000, 7])
def test_sampler_equals_the_sequential_rule(spark, hot_rows):
    rows = random_rows(3)
    assert sampled(events_frame(spark, rows), hot_rows=hot_rows) == sequential(rows)


def test_one_report_gives_nothing(spark):
    assert sampled(events_frame(spark, random_rows(1, devices=3, reports=1))) == set()


def test_suppression_is_recorded_not_dropped(spark):
    rows = [("d", 0, 0, 1.0, True, "moving", None, 0), ("d", 5000, 5000, 1.0, True, "moving", None, 1)]
    windows = suppression_windows(spark, [("maintenance", None, None, "x")]).select(
        "ord", "reason", from_ms(F.lit(0)).alias("from_at"), from_ms(F.lit(1000)).alias("to_at"), "approved_by"
    )
    found = episodes.sample_episodes(events_frame(spark, rows), POLICY, windows=windows).collect()
    assert [(r.type, r.suppressed_by) for r in found] == [("total_silence", "maintenance")]


def test_out_of_order_with_a_hot_device(spark):
    frame = events_frame(spark, random_rows(5))
    plain = quality.out_of_order(frame).first()[0]
    assert plain > 0
    assert quality.out_of_order(frame, hot_rows=5).first()[0] == plain


def test_bounding_fixes_look_both_ways(spark):
    rows = [
        ("d", 0, 0, 1.0, True, "moving", None, 0),
        ("d", 60, 60, 2.0, False, "moving", None, 1),
        ("d", 5000, 5000, 3.0, False, "moving", None, 2),
        ("d", 5060, 5060, 4.0, True, "moving", None, 3),
    ]
    frame = events_frame(spark, rows)
    found = episodes.with_episode_id(episodes.sample_episodes(frame, POLICY)).filter("type = 'total_silence'")
    row = episodes.last_and_next_fix(found, frame).first()
    assert (row.last_fix.lat, row.next_fix.lat) == (1.0, 4.0)


def test_many_windows_take_the_bucketed_join(spark, monkeypatch):
    from quietwatch.operators import policy

    rows = spark.range(50).select("id", from_ms((F.col("id") * 7_000_000).cast("bigint")).alias("at"))
    windows = spark.range(6).select(
        F.col("id").cast("int").alias("ord"),
        F.concat(F.lit("w"), F.col("id").cast("string")).alias("reason"),
        from_ms((F.col("id") * 40_000_000).cast("bigint")).alias("from_at"),
        from_ms((F.col("id") * 40_000_000 + 60_000_000).cast("bigint")).alias("to_at"),
        F.lit("x").alias("approved_by"),
    )
    small = sorted(policy.suppressed_by(rows, "at", windows, "why").collect())
    monkeypatch.setattr(policy, "MAX_BROADCAST_WINDOWS", 0)
    assert sorted(policy.suppressed_by(rows, "at", windows, "why").collect()) == small
    assert {r.why for r in small} >= {"w0", "w1", None}
