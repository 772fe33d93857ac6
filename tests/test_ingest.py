"""Batch and streaming import, readers, and the audit from files to a bundle."""

import json
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quietwatch.operators.policy import ReportingPolicy
from quietwatch.plans.audit import run_audit
from quietwatch.sources import ingest, readers, versions
from quietwatch.streaming import deadline
from quietwatch.streaming import ingest as stream_ingest

RUN = ingest.ImportRun("t1", "s", datetime(2026, 8, 5, tzinfo=timezone.utc))
BASE = {
    "schema_version": "0.1.0", "tenant_id": "t1", "source": "s",
    "event_identity": {"basis": "vendor_event_id", "value": "1"},
    "asset_ref": "ast_0123456789", "device_ref": "dev_0123456789", "received_at": "2026-08-05T06:00:00.000Z",
    "quality": {"raw_sha256": "a" * 64, "adapter_version": "x-1"},
}


def event(**changes):
    return {**json.loads(json.dumps(BASE)), **changes}


VALID = [
    event(),
    event(position={"lat": -1.2, "lon": 36.8, "valid": True, "fix_type": "gps"}, motion={"speed_kph": 40.5, "ignition": "on"}),
    event(alerts=[{"code": "power_cut", "source_code": "x"}]),
    event(device={"sleep_state": "deep_sleep", "model": None}),
    event(device_time="2026-08-05T02:00:00Z", vendor_received_at=None),
    event(motion={"ignition": "unknown", "motion_state": None}, position=None, power={}),
    event(event_identity={"basis": "synthesised", "value": "h:1", "algorithm": "sha256"}),
    event(ext={"adapter": {"deep": {"x": 1}}}, alerts=[]),
]
INVALID = [
    (event(motion={"speed_kph": "12"}), "/motion/speed_kph"),
    (event(motion={"ignition": False}), "/motion/ignition"),
    (event(event_identity={"basis": "synthesised", "value": "h:1"}), "/event_identity"),
    (event(vendor_extra=1), "/"),
    (event(asset_ref="John"), "/asset_ref"),
    (event(quality={}), "/quality"),
    (event(position={"lat": 91, "lon": 0, "valid": True}), "/position/lat"),
    (event(schema_version="9.9.9"), "/schema_version"),
    (event(ext={"adapter": 1}), "/ext/adapter"),
    (event(received_at="yesterday"), "/received_at"),
    (event(alerts=[None]), "/alerts/0"),
]


def lines_frame(spark, lines):
    rows = [("f", i + 1, line) for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, "file string, row_number bigint, line string")


def test_valid_and_invalid_events(spark):
    lines = [json.dumps(e) for e in VALID] + [json.dumps(e) for e, _ in INVALID]
    routed = ingest.route(readers.parse_ndjson(lines_frame(spark, lines)), RUN)
    paths = {r.row_number: r.field_paths for r in routed.collect()}
    for i in range(len(VALID)):
        assert paths[i + 1] == [], VALID[i]
    for i, (_, path) in enumerate(INVALID):
        assert path in paths[len(VALID) + i + 1], path


def test_a_bad_row_does_not_block_a_good_one(spark):
    lines = [json.dumps(event()), "{broken", "[1]", json.dumps(event(tenant_id="other")), json.dumps(event(motion={"x": "y" * 400}))]
    small = ingest.ImportRun("t1", "s", RUN.received_at, max_row_bytes=500)
    done = ingest.import_rows(readers.parse_ndjson(lines_frame(spark, lines)), small)
    codes = {r.row_number: r.code for r in done.quarantine.collect()}
    assert codes == {2: "MALFORMED_JSON", 3: "MALFORMED_JSON", 4: "TENANT_MISMATCH", 5: "ROW_TOO_LARGE"}
    assert done.observations.count() == 1


def test_resends_keep_receipts_and_one_observation(spark):
    five = [json.dumps(event(event_identity={"basis": "vendor_event_id", "value": str(i)})) for i in range(5)]
    rows = [(f"batch_{b}", i + 1, line) for b in range(100) for i, line in enumerate(five)]
    frame = spark.createDataFrame(rows, "file string, row_number bigint, line string")
    done = ingest.import_rows(readers.parse_ndjson(frame), RUN)
    assert done.observations.count() == 5
    assert done.receipts.count() == 600
    again = ingest.import_rows(readers.parse_ndjson(frame), RUN, done.observations)
    assert again.observations.count() == 0


def test_readers_number_and_refuse(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-files-")
    with open(f"{base}/a.ndjson", "w") as f:
        f.write('{"a": 1}\n\n  \n[1]\n{"a": null}\n')
    with open(f"{base}/b.csv", "w") as f:
        f.write('a,b,"c,d"\n1,"x,""y",null\n\n2,,z\n3,"bad,1\n4,5\n')
    spark.range(2).write.parquet(f"{base}/c.parquet")
    with open(f"{base}/bad.parquet", "w") as f:
        f.write("PAR1garbage")
    rows = [
        (r.row_number, r.j, r.parse_error)
        for r in readers.read_batch(spark, [f"{base}/a.ndjson"]).select("row_number", F.to_json("raw").alias("j"), "parse_error").orderBy("row_number").collect()
    ]
    assert rows == [(1, '{"a":1}', None), (2, None, "MALFORMED_JSON"), (3, '{"a":null}', None)]
    csv = readers.read_batch(spark, [f"{base}/b.csv"]).select("row_number", F.to_json("raw").alias("j"), "parse_error").orderBy("row_number").collect()
    assert [r.j for r in csv] == ['{"a":"1","b":"x,\\"y","c,d":null}', '{"a":"2","c,d":"z"}', None, None]
    assert [r.parse_error for r in csv][2:] == ["MALFORMED_CSV_ROW"] * 2
    mixed = readers.read_batch(spark, [f"{base}/c.parquet", f"{base}/bad.parquet"])
    assert {r.parse_error: r["count"] for r in mixed.groupBy("parse_error").count().collect()} == {None: 2, "MALFORMED_PARQUET": 1}
    with pytest.raises(ValueError):
        readers.format_of("x.xlsx")
    with pytest.raises(ValueError):
        versions.enrich(mixed, {"received_at": F.lit(1)})


def fleet_lines(devices=30, reports=6):
    lines = []
    for d in range(devices):
        for i in range(reports):
            when = datetime(2026, 8, 5, tzinfo=timezone.utc) + timedelta(seconds=60 * i + (3600 if i > 3 else 0))
            lines.append(
                json.dumps(
                    event(
                        event_identity={"basis": "vendor_event_id", "value": f"{d}-{i}"},
                        device_ref=f"dev_{d:08x}",
                        received_at=when.isoformat().replace("+00:00", "Z"),
                        device_time=when.isoformat().replace("+00:00", "Z"),
                        motion={"motion_state": "moving"},
                    )
                )
            )
    return lines


def test_audit_from_files_to_bundle(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-audit-")
    lines = fleet_lines()
    with open(f"{base}/a.ndjson", "w") as f:
        f.write("\n".join(lines[:90] + ["{broken"]))
    with open(f"{base}/b.ndjson", "w") as f:
        f.write("\n".join(lines[80:]))
    report = run_audit(spark, [f"{base}/a.ndjson", f"{base}/b.ndjson"], RUN, ReportingPolicy(), {"tenant_label": "demo"})
    assert report.bundle.ok, report.bundle.violations
    episodes = report.bundle.sections["episodes"].first()
    assert (episodes.episode_count, episodes.devices_observed, episodes.device_count) == (30, 30, 30)
    summary = {r.batch_id[-8:]: r for r in report.imported.summary.collect()}
    assert (summary["a.ndjson"].quarantined, summary["b.ndjson"].duplicates) == (1, 10)
    assert set(report.bundle.content_hashes) == set(report.bundle.sections)


def test_stream_import_is_effectively_once(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-in-")
    out = tempfile.mkdtemp(prefix="quietwatch-out-")
    for name in ("a", "b"):
        with open(f"{base}/{name}.ndjson", "w") as f:
            f.write("\n".join([json.dumps(event()), "{broken"]))
        stream_ingest.stream_ndjson(spark, base, RUN, out, f"{out}/checkpoint").awaitTermination()
    counts = [spark.read.parquet(f"{out}/{t}").count() for t in ("observations", "quarantine", "receipts")]
    assert counts == [1, 2, 4]
    candidates = readers.parse_ndjson(lines_frame(spark, [json.dumps(event())]))
    stream_ingest.import_epoch(candidates, 7, RUN, out)
    stream_ingest.import_epoch(candidates, 7, RUN, out)
    assert spark.read.parquet(f"{out}/receipts").count() == 6


def test_deadline_monitor_opens_and_recovers(spark):
    base = tempfile.mkdtemp(prefix="quietwatch-mon-")
    out = tempfile.mkdtemp(prefix="quietwatch-mon-out-")
    schema = "device_ref string, at timestamp, at_ms bigint, deadline_ms bigint"

    def put(rows):
        frame = spark.createDataFrame(
            [(d, datetime.fromtimestamp(t, timezone.utc), t * 1000, (t + 90) * 1000) for d, t in rows], schema
        )
        frame.coalesce(1).write.mode("append").parquet(base)
        stream = spark.readStream.schema(schema).parquet(base).withWatermark("at", "0 seconds")
        (
            deadline.monitor_deadlines(stream)
            .writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}/cp")
            .outputMode("append").trigger(availableNow=True).start().awaitTermination()
        )

    put([("a", 1000), ("b", 1000)])
    put([("b", 1060), ("b", 1120)])
    put([("c", 2000)])
    put([("a", 2100)])
    rows = spark.read.parquet(out).collect()
    found = {(r.device_ref, r.action, r.start_ms, r.end_ms) for r in rows}
    assert ("a", "opened", 1_000_000, None) in found and ("a", "recovered", 1_000_000, 2_100_000) in found
    assert ("b", "opened", 1_120_000, None) in found
    assert len([r for r in rows if r.action == "opened" and r.device_ref == "a"]) == 1
