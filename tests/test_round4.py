"""Tables without due rows, inputs of many files, histories of many keys."""

from __future__ import annotations

import tempfile
from datetime import datetime

from pyspark.sql import functions as F

from quietwatch.catalog import registry


def _folder() -> str:
    return tempfile.mkdtemp(prefix="quietwatch-tables-")


def test_retention_without_due_rows(spark):
    sf_dir = _folder()
    spark.createDataFrame(
        [(k, k, datetime(1992, 1, 1)) for k in range(8)], "o_orderkey bigint, o_custkey bigint, o_orderdate timestamp"
    ).write.parquet(f"{sf_dir}/orders.parquet")
    spark.createDataFrame(
        [(k, 7, 9500.0) for k in range(5)], "c_custkey bigint, c_nationkey bigint, c_acctbal double"
    ).write.parquet(f"{sf_dir}/customer.parquet")
    found = registry.QUERIES["retention_applied"](spark, sf_dir).collect()
    assert [(r.kept, r.tombstones, r.deleted_again) for r in found] == [(1, 0, 0)] * 8


def _events(spark, rows: int) -> str:
    sf_dir = _folder()
    n = F.col("id")
    spark.range(rows).select(
        n.alias("event_id"),
        (F.lit(datetime(2024, 1, 1)).cast("timestamp") + F.make_dt_interval(mins=(n * 7).cast("int"))).alias("ts"),
        (n % 20).alias("user_id"),
        F.element_at(F.array(F.lit("view"), F.lit("click"), F.lit("error")), (n % 3 + 1).cast("int")).alias("event_type"),
        n.cast("double").alias("value"),
        F.format_string('{"k": %d}', n % 100).alias("props"),
    ).coalesce(1).write.parquet(f"{sf_dir}/events.parquet")
    return sf_dir


def test_lines_lie_in_files_of_bounded_size(spark, monkeypatch):
    from quietwatch.catalog import source_queries

    monkeypatch.setattr(source_queries, "LINES_PER_FILE", 25)
    sf_dir = _events(spark, 400)
    assert source_queries.event_lines(spark, sf_dir).rdd.getNumPartitions() == 16
    found = {r.label: r.rows for r in registry.QUERIES["ndjson_files"](spark, sf_dir).collect()}
    assert (found["last_row"], found["numbers"]) == (400, 400)


def test_short_histories_meet_by_their_key(spark):
    from quietwatch.operators import temporal

    day = lambda d: datetime(2024, 1, 1 + d)
    rows = [(k * 10 + i, f"a{k}", f"d{k}", "primary", "x", day(i), day(i + 2) if i else None) for k in range(3) for i in range(4)]
    rows.append((99, None, None, "primary", "x", day(0), None))
    records = spark.createDataFrame(
        rows,
        "record_id bigint, asset_ref string, device_ref string, role string, installer_ref string,"
        " valid_from timestamp, valid_to timestamp",
    )
    sims = records.select("record_id", "device_ref", F.lit("s").alias("sim_ref"), F.lit("p").alias("provider_ref"), "valid_from", "valid_to")
    asked = records.select("asset_ref", F.col("valid_from").alias("at")).distinct()
    key = lambda r: tuple(map(str, r))
    pairs = {n: sorted(map(key, temporal.overlapping_pairs(records, "device_ref", "record_id", max_compared=n).collect())) for n in (0, 128)}
    assert pairs[0] == pairs[128] and len(pairs[0]) == 15
    found = {n: sorted(map(key, temporal.resolve_asset(asked, records, sims, "at", max_compared=n).select("queried_asset_ref", "at", "device_ref", "assignment", "sim").collect())) for n in (0, 128)}
    assert found[0] == found[128] and len(found[0]) == 27
    plan = temporal.overlapping_pairs(records, "device_ref", "record_id")._jdf.queryExecution().toString()
    assert "explode" not in plan


def test_busy_keys_fold_by_blocks(spark):
    from quietwatch.operators import peers

    assert peers.PIECE_ROWS <= 20_000
    starts = spark.range(3_000).select(
        F.lit("t").alias("tenant_id"), F.lit("source").alias("dimension"), F.lit("k").alias("key"),
        (F.col("id") * 7_919 % 50_000_000).alias("start_ms"), F.col("id").alias("episode_id"),
    )
    rows = lambda hot: sorted(map(tuple, peers.assign_clusters(starts, 1_800, hot).select("episode_id", "cluster_start_ms").collect()))
    assert rows(100) == rows(10**9)


def test_large_merges_take_more_tasks(spark, monkeypatch):
    from quietwatch.functions import ordered

    monkeypatch.setattr(ordered, "ROWS_PER_TASK", 10)
    rows = spark.range(200).select((F.col("id") % 50).alias("k"), F.col("id").alias("t"))
    sliced = ordered.slice_hot_keys(rows, ["k"], "t", ["t"])
    assert sliced.rows.rdd.getNumPartitions() == 20
    assert ordered.with_previous(sliced, F.struct("t"), "p").finished().filter("p.t = t - 50").count() == 150


def test_rounds_of_a_search_broadcast_nothing(spark):
    from quietwatch.operators import corridor

    edges = spark.createDataFrame([(i, i + 1, 1.0) for i in range(6)], "node bigint, next_node bigint, length_m double")
    asked = spark.createDataFrame([(1, 0, 4.0)], "request_id bigint, node bigint, budget_m double")
    plans = []

    def admit(rows):
        kept = rows.join(asked.select("request_id", "budget_m").hint("merge"), "request_id").filter("dist <= budget_m")
        plans.append(kept._jdf.queryExecution().executedPlan().toString())
        return kept

    start = asked.select("request_id", "node", F.lit(0.0).alias("dist"))
    found = corridor._shorten(start, edges, ["request_id"], admit)
    assert sorted(r.node for r in found.collect()) == [0, 1, 2, 3, 4]
    assert len(plans) == 5 and not any("Broadcast" in p for p in plans)
