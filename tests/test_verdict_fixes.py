"""Rows with unknown keys or instants, and equal requests, get one defined answer."""

from datetime import datetime

from pyspark.sql import functions as F

from quietwatch.operators import queue, temporal

T = [datetime(2024, 1, d) for d in range(1, 10)]


def test_as_of_is_the_same_on_both_paths(spark):
    records = spark.createDataFrame(
        [("a", T[0], T[4], 1, "x"), ("a", T[1], T[2], 2, "y"), (None, T[0], None, 3, "z"), ("b", None, None, 4, "w")],
        "k string, valid_from timestamp, valid_to timestamp, id int, v string",
    )
    probe = spark.createDataFrame(
        [(1, "a", T[1]), (2, "a", T[3]), (3, "a", None), (4, None, T[1]), (5, "b", T[1]), (6, "a", T[6])],
        "n int, k string, at timestamp",
    )
    answers = []
    for limit in (100, 0):
        out = temporal.resolve_at(probe, records, ["k"], "at", ["v"], "id", max_broadcast=limit)
        answers.append({r.n: r.v for r in out.select("n", F.col("resolved.v").alias("v")).collect()})
    assert answers[0] == answers[1] == {1: "y", 2: "x", 3: None, 4: None, 5: None, 6: None}


def test_one_of_two_equal_requests_wins(spark):
    items = spark.createDataFrame([("e", "old", 1), ("f", "old", 1)], "episode_id string, owner string, version int")
    asked = [("e", "u", 1, T[0]), ("e", "u", 1, T[0]), ("e", "v", 2, T[0]), ("f", "u", 1, None)]
    requests = spark.createDataFrame(asked, "episode_id string, owner string, expected_version int, requested_at timestamp")
    rows = queue.merge_assignments(items, requests).collect()
    assert sorted(r.outcome for r in rows if r.episode_id == "e") == ["assigned", "conflict", "conflict"]
    assert {(r.owner, r.version) for r in rows if r.episode_id == "e"} == {("u", 2)}
    assert [r.outcome for r in rows if r.episode_id == "f"] == ["assigned"]
