"""Late data, transitions, decisions, retention, replay, corridors, redaction, listing, pilot."""

import tempfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quietwatch.functions.scalars import exceeds, from_ms, wilson_lower
from quietwatch.operators import corridor, evaluation, lifecycle, listing, redact, replay, retention
from quietwatch.streaming import late

T0 = datetime(2026, 8, 5, 6)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def version(episode, state="monitoring", end=3600):
    return (
        episode, "d", 1, state, "total_silence", at(0), None if end is None else at(end), "opened", "s", "r",
        at(0), None, "device_time", "1", at(86_400),
    )


VERSION_SCHEMA = (
    "episode_id string, device_ref string, version bigint, state string, type string, start_at timestamp,"
    " end_at timestamp, cause string, actor string, reason string, at timestamp, supersedes bigint,"
    " clock_basis string, policy_version string, finalisation_watermark_at timestamp"
)

REPORTS = {
    "none": [],
    "closed": [(3600, True), (3900, True), (4000, True)],
    "retracted": [(60, True), (200, True), (900, True)],
    "split": [(1000, True), (1200, True), (1500, True)],
    "annotated": [(1000, True), (1001, True), (1002, True)],
    "invalid": [(1000, False), (1200, False), (1500, False)],
}


def test_late_data_verdicts(spark):
    versions = spark.createDataFrame([version(e) for e in REPORTS], VERSION_SCHEMA)
    reports = spark.createDataFrame(
        [(e, at(s), v) for e, rs in REPORTS.items() for s, v in rs], "episode_id string, at timestamp, valid boolean"
    )
    found = lifecycle.late_data_verdicts(lifecycle.current_versions(versions), reports, 3, 300.0)
    verdicts = {r.episode_id: r for r in found.collect()}
    assert {e: r.verdict for e, r in verdicts.items()} == {
        "none": "no_change", "closed": "closed", "retracted": "retracted", "split": "split",
        "annotated": "annotated", "invalid": "annotated",
    }
    assert verdicts["closed"].end_at == at(3600)
    no_actions = spark.createDataFrame([], "episode_id string")
    now = F.lit(at(7200)).cast("timestamp")
    rows = lifecycle.apply_verdicts(lifecycle.current_versions(versions), found, no_actions, now, now).collect()
    by_id = {r.episode_id: r for r in rows}
    assert set(by_id) == {"closed", "retracted", "split", "split-a", "split-b"}
    assert by_id["split"].state == "retracted" and by_id["split-a"].end_at == at(1000)
    assert by_id["split-b"].start_at == at(1500) and by_id["split-b"].end_at == at(3600)


def test_acted_upon_episodes_need_approval_once_final(spark):
    current = lifecycle.current_versions(
        spark.createDataFrame([version("a", "resolved"), version("b", "monitoring")], VERSION_SCHEMA)
    )
    actions = spark.createDataFrame([("a",), ("b",)], "episode_id string")
    request = lambda by: spark.createDataFrame(
        [("a", "classified", "human_decision", "u", "why", at(0), by), ("b", "action_open", "human_decision", "u", "why", at(0), by)],
        "episode_id string, to_state string, cause string, actor string, reason string, at timestamp, approved_by string",
    )
    later = F.lit(at(100_000)).cast("timestamp")
    plain = {r.episode_id: r.status for r in lifecycle.apply_transitions(current, request(None), actions, later).collect()}
    assert plain == {"a": "approval_required", "b": "illegal"}
    approved = {r.episode_id: r for r in lifecycle.apply_transitions(current, request("boss"), actions, later).collect()}
    assert (approved["a"].status, approved["a"].cause, approved["a"].actor) == ("applied", "controlled_reopening", "boss")


def test_late_stream_equals_batch(spark):
    reports = [("split", s, v) for s, v in REPORTS["split"]] + [("closed", s, v) for s, v in REPORTS["closed"]]
    schema = "episode_id string, at timestamp, valid boolean"
    frame = lambda rows: spark.createDataFrame([(e, at(s), v) for e, s, v in rows], schema)
    versions = spark.createDataFrame([version("split"), version("closed")], VERSION_SCHEMA)

    def outcome(batches):
        base = tempfile.mkdtemp(prefix="quietwatch-late-")
        late.store_versions(spark, versions, base)
        for epoch, rows in enumerate(batches):
            for _ in range(2):  # a repeated epoch changes nothing
                late.revise_epoch(frame(rows), epoch, base, 3, 300.0, at(7200), at(7200))
        table = spark.read.parquet(f"{base}/versions")
        return sorted(
            (r.episode_id, r.state, str(r.start_at), str(r.end_at)) for r in lifecycle.current_versions(table).collect()
        )

    timely = outcome([reports])
    assert timely == outcome([reports[:2], reports[2:5], reports[5:]])
    assert [r[0] for r in timely] == ["closed", "split", "split-a", "split-b"]


EDGES = "from_node string, to_node string, length_m double, motorcycle_access boolean, car_access boolean, one_way boolean, road_name string"


def road(a, b, name=None, length=100.0):
    return (a, b, length, True, True, False, name)


def test_only_the_bridge_is_unavoidable(spark):
    """Two routes either side of one bridge, and a second graph without any shared stretch."""
    edges = [
        road("a", "b"), road("a", "c"), road("b", "m", "bridge road"), road("c", "m"),
        road("m", "d"), road("m", "e"), road("d", "z"), road("e", "z"),
        road("p", "q"), road("p", "r"), road("q", "s"), road("r", "s"),
    ]
    nodes = [(n, f"cell_{n}") for n in "abcmdezpqrs"]
    requests = [("bridge", "a", "z", 60.0, 60.0), ("two_ways", "p", "s", 60.0, 60.0), ("too_far", "a", "z", 1.0, 60.0)]
    frames = (
        spark.createDataFrame(requests, "request_id string, from_node string, to_node string, elapsed_s double, max_speed_kph double"),
        spark.createDataFrame(nodes, "node_id string, cell string"),
        spark.createDataFrame(edges, EDGES),
    )
    summary, cells = corridor.project_corridors(*frames)
    assert {r.request_id: r.status for r in summary.collect()} == {
        "bridge": "corridor", "two_ways": "corridor_ambiguous", "too_far": "infeasible",
    }
    held = {(r.cell, r.role) for r in cells.filter("request_id = 'bridge' and role <> 'feasible'").collect()}
    assert held == {("cell_a", "endpoint"), ("cell_z", "endpoint"), ("cell_m", "unavoidable")}


def test_nan_bounds_exceed_nothing(spark):
    bound = wilson_lower(F.lit(5), F.lit(2))
    assert spark.range(1).select(exceeds(bound, F.lit(0.1))).first()[0] is False


def test_retention_deletes_once_and_leaves_a_tombstone(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-ret-")
    rows = [("r1", "raw_receipt", 100), ("r2", "raw_receipt", 1), ("r3", "map_snapshot", 1), ("r4", "raw_receipt", 100)]
    now = datetime(2026, 8, 5)
    items = spark.createDataFrame(
        [(r, c, "t", now - timedelta(days=d), "e", "held" if r == "r4" else "dev", None, False) for r, c, d in rows],
        "ref string, data_class string, tenant_id string, created_at timestamp, episode_id string, device_ref string,"
        " tombstoned_at timestamp, needed_for_reproduction boolean",
    )
    holds = spark.createDataFrame(
        [(1, "h1", "t", False, [], ["held"], None)],
        "ord int, hold_id string, tenant_id string, entire_tenant boolean, episode_ids array<string>,"
        " device_refs array<string>, released_at timestamp",
    )
    plan = retention.plan_retention(items, holds, F.lit(now).cast("timestamp"))
    assert {r.ref: r.reason for r in plan.collect()} == {"r1": None, "r2": "not_due", "r3": None, "r4": "legal_hold"}
    items.write.partitionBy("data_class").parquet(f"{base}/data")

    def apply(n):
        return retention.apply_retention(
            spark, plan, f"{base}/data", f"{base}/stones", f"{base}/staging{n}", "data_class", "run",
            F.lit(now).cast("timestamp"), "1",
        )

    assert (apply(1), apply(2)) == (2, 0)
    left = spark.read.schema(items.schema).parquet(f"{base}/data")
    assert sorted(r.ref for r in left.collect()) == ["r2", "r4"]
    assert sorted(r.ref for r in spark.read.parquet(f"{base}/stones").collect()) == ["r1", "r3"]
    with pytest.raises(ValueError):
        retention.check_policy({"normalized_telemetry": 181})


def test_replay_resumes_at_the_failed_window(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-replay-")
    begin = datetime(2026, 8, 1)
    scope = replay.ReplayScope("run", "t", "s", begin, begin + timedelta(days=3, hours=1), "boss", "why")
    rows = spark.range(80).select((F.lit(begin).cast("timestamp") + F.make_dt_interval(hours=F.col("id").cast("int"))).alias("received_at"))
    seen, broken = [], [2]

    def process(window, start, end):
        if len(seen) == broken[0]:
            broken[0] = -1
            raise RuntimeError("lost")
        seen.append((start, window.count()))

    first = replay.run_replay(spark, scope, rows, process, f"{base}/runs")
    assert (first.status, first.windows_processed) == ("failed", 2)
    second = replay.run_replay(spark, scope, rows, process, f"{base}/runs")
    assert (second.status, second.windows_processed) == ("completed", 4)
    assert [n for _, n in seen] == [24, 24, 24, 1]
    assert replay.check_scope(scope, begin - timedelta(days=1)) == ["future_interval"]


def test_bundle_fails_closed(spark):
    good = spark.createDataFrame([("m", 30, 0.5), ("n", 3, 0.5)], "model string, device_count int, completeness double")
    bundle = redact.emit_bundle({"completeness": good}, {})
    assert bundle.ok and bundle.suppressed == 1 and bundle.sections["completeness"].count() == 1
    leaks = spark.createDataFrame(
        [("m", 30, "-1.28641", "356938035643809", [36.81721])],
        "model string, device_count int, day string, source string, duration_s array<double>",
    ).withColumn("device_ref", F.lit("x"))
    bad = redact.emit_bundle({"s": leaks}, {})
    assert not bad.ok and not bad.sections
    assert {(v.code, v.path) for v in bad.violations} >= {
        ("COORDINATE_PRESENT", "/sections/s/day"),
        ("IDENTIFIER_PRESENT", "/sections/s/source"),
        ("COORDINATE_PRESENT", "/sections/s/duration_s/*"),
        ("IDENTIFIER_PRESENT", "/sections/s/device_ref"),
        ("FIELD_NOT_ALLOWLISTED", "/sections/s/device_ref"),
    }
    with pytest.raises(PermissionError):
        redact.write_bundle(bad, "/tmp/never")


def test_redaction_is_visible(spark):
    line = spark.createDataFrame([("at -1.28641, 36.81721 call 0712345678 or a.b@c.io",)], "t string")
    assert line.select(redact.redact(F.col("t"))).first()[0] == "at [REDACTED] call [REDACTED] or [REDACTED]"
    kinds = [f.kind for f in line.select(redact.scan_sensitive(F.col("t"))).first()[0]]
    assert kinds == ["coordinates", "msisdn", "email"]


def test_pages_cover_the_list_without_repeats(spark):
    rows = spark.range(7).select(
        from_ms((F.floor(F.col("id") / 2) * 1000).cast("bigint")).alias("start_at"),
        F.concat(F.lit("ep"), F.col("id").cast("string")).alias("episode_id"),
    )
    seen, cursor = [], None
    while True:
        items, cursor = listing.list_episodes(rows, limit=3, cursor=cursor)
        seen += [r.episode_id for r in items]
        if cursor is None:
            break
    assert seen == [f"ep{i}" for i in range(7)]
    with pytest.raises(ValueError):
        listing.decode_cursor("garbage")
    with pytest.raises(PermissionError):
        listing.page_rows(rows, cell="x")
    assert listing.tenant_rows(rows.withColumn("tenant_id", F.lit("t")), None).count() == 0


def test_pilot_guards():
    with pytest.raises(ValueError):
        evaluation.PilotProtocol.lock("p", ("2026-01-01T00:00:00Z", "2026-03-01T00:00:00Z"), ("2026-02-01T00:00:00Z", "2026-04-01T00:00:00Z"))
    protocol = evaluation.PilotProtocol.lock("p", ("2026-01-01T00:00:00Z", "2026-02-01T00:00:00Z"), ("2026-02-01T00:00:00Z", "2026-03-01T00:00:00Z"))
    with pytest.raises(ValueError, match="sealed"):
        protocol.check_sealed("2026-02-15T00:00:00Z")
    with pytest.raises(ValueError, match="drifted"):
        protocol.check_rules([])
