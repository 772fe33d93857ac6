"""What a continuous import keeps on disk: packed files, one table of judged rows at a time, no old shuffle files."""

import json
import os
import tempfile
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import DataFrame

from quietwatch.catalog import registry, source_queries
from quietwatch.session import DROP_SHUFFLES, shuffles_dropped
from quietwatch.sources import ingest, readers
from quietwatch.streaming import ingest as stream_ingest

RUN = ingest.ImportRun("t1", "s", datetime(2026, 8, 5, tzinfo=timezone.utc))
EVENT = {
    "schema_version": "0.1.0", "tenant_id": "t1", "source": "s",
    "event_identity": {"basis": "vendor_event_id", "value": "1"},
    "asset_ref": "ast_0123456789", "device_ref": "dev_0123456789", "received_at": "2026-08-05T06:00:00.000Z",
    "quality": {"raw_sha256": "a" * 64, "adapter_version": "x-1"}, "power": None, "motion": {}, "alerts": [],
    "ext": {"adapter": {"deep": 1}}, "device": {"sleep_state": "deep_sleep"},
}


def test_judged_rows_are_those_of_the_import_and_hold_no_foreign_value(spark, monkeypatch):
    """A micro-batch kept its rows in a cache with raw and typed values of each, good or not."""
    cached, seen = [], []
    monkeypatch.setattr(DataFrame, "persist", lambda self, *_: cached.append(self) or self)
    drop = stream_ingest.discard

    def look(session, path):
        seen.append((path, [r.asDict(True) for r in session.read.parquet(path).collect()]))
        drop(session, path)

    monkeypatch.setattr(stream_ingest, "discard", look)
    lines = [json.dumps(EVENT), "{broken", "[]", json.dumps(EVENT | {"tenant_id": "t2"}), json.dumps(EVENT | {"asset_ref": "John"})]
    lines += [json.dumps(EVENT | {"event_identity": {"basis": "vendor_event_id", "value": "2"}, "power": {}})]
    rows = spark.createDataFrame([("f", i + 1, line) for i, line in enumerate(lines)], "file string, row_number bigint, line string")
    candidates = readers.parse_ndjson(rows)
    out = tempfile.mkdtemp(prefix="quietwatch-out-")
    stream_ingest.import_epoch(candidates, 0, RUN, out)
    assert not cached
    ((path, staged),) = seen
    assert not os.path.exists(path)
    kept = {"file", "row_number", "row_sha256", "code", "field_paths"}
    assert all(v is None for r in staged if r["code"] for k, v in r.items() if k not in kept)
    want = ingest.import_rows(candidates, RUN)
    for name, frame in (("observations", want.observations.drop("raw", "ext")), ("quarantine", want.quarantine), ("receipts", want.receipts)):
        got = spark.read.parquet(f"{out}/{name}").drop("epoch")
        assert got.columns == frame.columns
        assert sorted(map(str, got.collect())) == sorted(map(str, frame.collect()))
    assert [r["code"] for r in sorted(staged, key=lambda r: r["row_number"])].count(None) == 2


def test_landed_files_are_packed(spark, monkeypatch):
    """Both copies of all lines lay in a folder as plain text: two thirds of the disk that the import took."""
    events = [(i, datetime(2024, 1, 1) + timedelta(minutes=i), i % 40, "view", i / 7, json.dumps({"k": i % 100})) for i in range(4_000)]
    folder = tempfile.mkdtemp(prefix="quietwatch-tables-")
    schema = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"
    spark.createDataFrame(events, schema).write.parquet(f"{folder}/events.parquet")

    class Landed(Exception):
        pass

    def stop(_spark, landed, *_, **options):
        raise Landed(landed, options)

    monkeypatch.setattr(source_queries.stream_ingest, "stream_ndjson", stop)
    with pytest.raises(Landed) as caught:
        registry.QUERIES["stream_import"](spark, folder)
    landed, options = caught.value.args
    lines = [r.value for r in spark.read.text(landed).collect()]
    want = [r.line for r in source_queries.event_lines(spark, folder).collect()]
    assert sorted(lines) == sorted(2 * want)
    path = landed.removeprefix("file:")
    parts = [f"{path}/{f}" for f in os.listdir(path) if f.startswith("part-")]
    assert len(parts) == 4 * options["files_per_batch"]
    assert sum(map(os.path.getsize, parts)) < sum(map(len, lines)) / 3


def test_shuffle_files_are_dropped_inside_only(spark):
    before = spark.conf.get(DROP_SHUFFLES, None)
    with pytest.raises(ValueError, match="x"), shuffles_dropped(spark):
        assert spark.conf.get(DROP_SHUFFLES) == "true"
        raise ValueError("x")
    assert spark.conf.get(DROP_SHUFFLES, None) == before
