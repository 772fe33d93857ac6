"""Overlapping intervals flattened to disjoint segments, against containment at every instant."""

import random

import pytest
from pyspark.sql import functions as F

from quietwatch.functions.scalars import from_ms
from quietwatch.operators import segments, temporal

SCHEMA = "key string, _start bigint, _end bigint, _order bigint, _rank bigint"


def intervals(seed, keys=3, number=60):
    rng = random.Random(seed)
    rows, n = [], 0
    for k in range(keys):
        for _ in range(number):
            start = rng.randrange(0, 80)
            rows.append((f"k{k}", start, start + rng.choice([1, 2, 5, 30, 200]), n, rng.randrange(0, 9)))
            n += 1
    return rows


@pytest.mark.parametrize("ranked", [True, False])
@pytest.mark.parametrize("hot_rows", [500_000, 7])
def test_one_interval_holds_at_each_instant(spark, ranked, hot_rows):
    rows = intervals(4)
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("_value", F.struct("_order")).repartition(3)
    found = segments.disjoint(frame if ranked else frame.drop("_rank"), ["key"], hot_rows).collect()
    at = {}
    for r in found:
        assert r._from < r._to
        for t in range(r._from, r._to):
            assert (r.key, t) not in at  # disjoint
            at[r.key, t] = r._value._order
    for key in ("k0", "k1", "k2"):
        for t in range(0, 290):
            held = [r for r in rows if r[0] == key and r[1] <= t < r[2]]
            if not held:
                assert (key, t) not in at
            elif ranked:
                assert max(r[4] for r in held) == next(r[4] for r in rows if r[3] == at[key, t])
                assert any(r[3] == at[key, t] for r in held)
            else:
                assert at[key, t] == max((r[1], r[3]) for r in held)[1]


def test_search_in_a_long_history(spark):
    """One key with more segments than a block, gaps between them, and probes at every border."""
    number = 3 * segments.BLOCK + 5
    flat = spark.range(number).select(
        F.lit("k").alias("key"), (F.col("id") * 10).alias("_from"), (F.col("id") * 10 + 7).alias("_to"),
        F.struct("id").alias("_value"),
    )
    probe = spark.range(-1, number * 10 + 20).select(F.lit("k").alias("key"), F.col("id").alias("t"))
    for way in (temporal.look_up, temporal.merge_up):
        found = way(probe, flat, ["key"], F.col("t"), "v").select("t", "v.id").collect()
        assert len(found) == number * 10 + 21
        for t, v in found:
            assert v == (t // 10 if 0 <= t < number * 10 and t % 10 < 7 else None)


def test_a_window_list_of_equal_order_and_unknown_bounds(spark):
    from quietwatch.operators import policy

    windows = spark.createDataFrame(
        [(0, "a", 10, 20), (0, "b", 12, 30), (1, "c", None, 50), (2, "d", 40, 40), (3, "e", 0, 100)],
        "ord int, reason string, f bigint, t bigint",
    ).select("ord", "reason", from_ms("f").alias("from_at"), from_ms("t").alias("to_at"), F.lit("x").alias("approved_by"))
    rows = spark.range(0, 110).select("id", from_ms("id").alias("at"))
    found = {r.id: r.why for r in policy.suppressed_by(rows, "at", windows, "why").collect()}
    assert found[5] == "e" and found[11] == "a" and found[25] == "b" and found[45] == "e" and found[105] is None
