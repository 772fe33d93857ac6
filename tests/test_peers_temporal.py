"""Peer bursts and as-of resolution against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms
from quietwatch.operators import peers, temporal

MEMBERS = "tenant_id string, episode_id string, device_ref string, asset_ref string, start_ms bigint, dimension string, key string"


@pytest.mark.parametrize("hot_rows", [500_000, 10])
def test_bursts_are_anchored_on_their_first_start(spark, hot_rows):
    rng = random.Random(7)
    rows, expected = [], {}
    for k in range(8):
        at, starts = 0, []
        for i in range(150):
            at += rng.choice([1, 50, 300, 900, 1500, 4000]) * 1000
            starts.append(at)
            rows.append(("t", f"{k}-{i}", f"d{i % 5}", None, at, "source", f"k{k}"))
        anchor = None
        for i, s in enumerate(starts):
            anchor = s if anchor is None or s - anchor > 1_800_000 else anchor
            expected[f"{k}-{i}"] = anchor
    found = peers.assign_clusters(spark.createDataFrame(rows, MEMBERS), 1800, hot_rows)
    assert {r.episode_id: r.cluster_start_ms for r in found.collect()} == expected


def test_witnesses_collapse_devices_and_assets(spark):
    rows = [
        ("t", "e1", "d1", "a1", 0, "source", "s"),
        ("t", "e2", "d1", "a1", 1000, "source", "s"),
        ("t", "e3", "d2", "a1", 2000, "source", "s"),
        ("t", "e4", "d3", None, 3000, "source", "s"),
    ]
    assigned = peers.assign_clusters(spark.createDataFrame(rows, MEMBERS), 1800)
    cluster = peers.clusters(assigned).first()
    assert (cluster.member_devices, cluster.independent_count, cluster.meets_minimum) == (3, 2, False)
    assert cluster.affected_fraction is None
    found = {(r.device_ref, r.reason, r.counted_as) for r in peers.exclusions(assigned).collect()}
    assert found == {("d1", "duplicate_device", "d1"), ("d2", "shares_asset", "d1")}


def test_mixed_tenants_are_refused(spark):
    frame = spark.createDataFrame([("a",), ("b",)], "tenant_id string")
    with pytest.raises(Exception, match="refusing to correlate"):
        peers.single_tenant(frame, "a").collect()


def history(spark, rng, keys=4, records=25):
    rows, n = [], 0
    for k in range(keys):
        for _ in range(records):
            start = rng.randrange(0, 400) * 43_200_000
            length = rng.choice([0, 1, 3, 20, 90]) * 43_200_000
            rows.append((f"k{k}", n, start, None if rng.random() < 0.05 else start + length))
            n += 1
    frame = spark.createDataFrame(rows, "key string, record_id bigint, s bigint, e bigint").select(
        "key", "record_id", from_ms("s").alias("valid_from"), from_ms("e").alias("valid_to")
    )
    return rows, frame


@pytest.mark.parametrize("options", [{}, {"max_broadcast": 0}, {"max_broadcast": 0, "hot_rows": 15}])
def test_as_of_resolution_is_containment(spark, options):
    rng = random.Random(11)
    rows, frame = history(spark, rng)
    probes = [(f"k{i % 5}", i, rng.randrange(0, 500) * 43_200_000) for i in range(300)]
    probe = spark.createDataFrame(probes, "key string, n int, t bigint").select("key", "n", from_ms("t").alias("at"))
    expected = {}
    for key, n, t in probes:
        holding = [(s, i) for k, i, s, e in rows if k == key and s <= t and (e is None or t < e) and (e is None or e > s)]
        expected[n] = max(holding)[1] if holding else None
    found = temporal.resolve_at(probe, frame, ["key"], "at", ["record_id"], "record_id", **options)
    assert {r.n: r.r for r in found.select("n", F.col("resolved.record_id").alias("r")).collect()} == expected


def test_overlaps_and_gaps(spark):
    rng = random.Random(2)
    rows, frame = history(spark, rng)
    sound = [r for r in rows if r[3] is None or r[3] > r[2]]
    pairs = {
        (a[1], b[1])
        for a in sound
        for b in sound
        if a[0] == b[0] and (a[2], a[1]) < (b[2], b[1]) and (a[3] is None or b[2] < a[3])
    }
    found = temporal.overlapping_pairs(frame, "key", "record_id").collect()
    assert len(found) == len(pairs)
    assert {(r.earlier_id, r.later_id) for r in found} == pairs
    plain = temporal.history_gaps(frame, "key", "record_id").collect()
    hot = temporal.history_gaps(frame, "key", "record_id", hot_rows=6).collect()
    assert sorted(plain) == sorted(hot)


def test_coverage_of_nothing_is_whole(spark):
    empty = spark.createDataFrame([], "device_ref string, resolved string")
    assert temporal.coverage(empty).first().coverage == 1.0
