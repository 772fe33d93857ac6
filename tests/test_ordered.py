"""Slices of hot keys: bounded by count whatever the instants are, and scans over them like plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from quietwatch.functions import ordered

SCHEMA = "key string, t bigint, n bigint, flag boolean"


def rows_of(kind):
    rng = random.Random(3)
    out = []
    for key, number in ((None, 400), ("hot", 500), ("cold", 20)):
        for i in range(number):
            t = {
                "outlier": 5_000_000_000_000 if i == 0 else 1_700_000_000_000 + rng.randrange(1000),
                "equal": 1_700_000_000_000,
                "repeated": 1_700_000_000_000 + i // 90,
            }[kind]
            out.append((key, t, 7 if kind == "repeated" and i % 90 < 60 else i, rng.random() < 0.99))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("kind", ["outlier", "equal", "repeated"])
def test_no_slice_is_longer_than_the_bound(spark, kind):
    """One wrong year, one instant for all, and rows equal in the whole order."""
    frame = spark.createDataFrame(rows_of(kind), SCHEMA).repartition(3)
    sliced = ordered.slice_hot_keys(frame, ["key"], "t", ["t", "n"], hot_rows=25)
    assert sliced.has_hot
    sizes = sliced.rows.groupBy("key", ordered.SLICE).count().collect()
    assert max(r["count"] for r in sizes) <= 25
    assert len(sizes) <= sliced.slices + 1
    assert sliced.finished().columns == frame.columns
    assert sorted(map(str, sliced.finished().collect())) == sorted(map(str, frame.collect()))


@pytest.mark.parametrize("kind", ["outlier", "equal"])
@pytest.mark.parametrize("max_side", [ordered.MAX_SIDE_ROWS, 0])
def test_scans_equal_plain_windows(spark, monkeypatch, kind, max_side):
    """NULL is a hot key here; side tables are joined by a shuffle where none may be broadcast."""
    monkeypatch.setattr(ordered, "MAX_SIDE_ROWS", max_side)
    frame = spark.createDataFrame(rows_of(kind), SCHEMA).repartition(3)
    value = F.struct("t", "n")
    sometimes = F.when(F.col("n") % 7 == 3, F.col("n"))
    sliced = ordered.slice_hot_keys(frame, ["key"], "t", ["t", "n"], hot_rows=25)
    sliced = ordered.with_previous(sliced, value, "before")
    sliced = ordered.with_next(sliced, value, "after")
    sliced = ordered.with_running_max(sliced, F.col("n") % 100, "most", include_self=False)
    sliced = ordered.with_last_seen(sliced, sometimes, "seen")
    sliced = ordered.with_all_true(sliced, F.col("flag"), "every")
    w = Window.partitionBy("key").orderBy("t", "n")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    plain = frame.withColumns(
        {
            "before": F.lag(value).over(w),
            "after": F.lead(value).over(w),
            "most": F.max(F.col("n") % 100).over(w.rowsBetween(Window.unboundedPreceding, -1)),
            "seen": F.last(sometimes, ignorenulls=True).over(so_far),
            "every": F.bool_and("flag").over(Window.partitionBy("key")),
        }
    )
    assert sorted(map(str, sliced.finished().collect())) == sorted(map(str, plain.collect()))
