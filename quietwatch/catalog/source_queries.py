"""Queries over texts, batch import, versions, corridors, streams and the audit."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import functions as F

from quietwatch.catalog.views import POLICY, TELEMETRY_SQL, TENANT, epoch_ms, table, telemetry
from quietwatch.functions.scalars import evaluate_once, great_circle_m, grid_cell, ms, utc_iso
from quietwatch.operators import corridor, redact
from quietwatch.plans.audit import audit_sections
from quietwatch.session import scratch_path, shuffles_dropped
from quietwatch.sources import ingest, readers, vendor, versions
from quietwatch.streaming import deadline
from quietwatch.streaming import ingest as stream_ingest
from quietwatch.streaming.tables import read_table

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str | None = None, view: str = "none AS (SELECT 1)"):
    def register(function):
        QUERIES[name] = function
        if sql is not None:
            ORACLE[name] = f"WITH RECURSIVE {view.strip()}\n{sql.strip()}"
        return function

    return register


# ------------------------------------------------------------------ free text

_COORD = r"-?\d{1,3}\.\d{4,}\s*[,;]\s*-?\d{1,3}\.\d{4,}"
_LATLON = r'(?i)"(lat|latitude|lon|lng|longitude)"\s*:\s*-?\d{1,3}\.\d{3,}'
_SQL_PATTERNS = {
    "coordinates": _COORD,
    "lat_lon_field": _LATLON,
    "msisdn": r"(?:\+?254|0)7\d{8}",
    "imei": r"\b\d{15}\b",
    "email": r"[\w.+-]+@[\w-]+\.[\w.]+",
}
TEXTS_SQL = """texts AS (SELECT 'documents' AS origin, doc_id AS id, text FROM documents
  UNION ALL SELECT 'pages', page_id, html FROM pages
  UNION ALL SELECT 'conversations', conv_id * 1000 + turn, text FROM conversations)"""


def texts(spark, sf_dir):
    documents = table(spark, sf_dir, "documents").select(
        F.lit("documents").alias("origin"), F.col("doc_id").alias("id"), "text"
    )
    pages = table(spark, sf_dir, "pages").select(
        F.lit("pages").alias("origin"), F.col("page_id").alias("id"), F.col("html").alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select(
        F.lit("conversations").alias("origin"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text"
    )
    return documents.unionByName(pages).unionByName(turns)


_SCAN_SQL = " UNION ALL ".join(
    f"SELECT origin, id, '{k}' AS kind, substr(regexp_extract(text, '{p}'), 1, 40) AS excerpt FROM texts WHERE regexp_matches(text, '{p}')"
    for k, p in _SQL_PATTERNS.items()
)


@query("sensitive_findings", _SCAN_SQL, TEXTS_SQL)
def sensitive_findings(spark, sf_dir):
    found = texts(spark, sf_dir).select("origin", "id", F.inline(redact.scan_sensitive(F.col("text"))))
    return found.select("origin", "id", "kind", "excerpt")


@query(
    "sensitive_counts",
    "SELECT origin, kind, count(*) AS rows, CAST(sum(n) AS BIGINT) AS matches FROM ("
    + " UNION ALL ".join(
        f"SELECT origin, '{k}' AS kind, len(regexp_extract_all(text, '{p}')) AS n FROM texts" for k, p in _SQL_PATTERNS.items()
    )
    + ") WHERE n > 0 GROUP BY ALL",
    TEXTS_SQL,
)
def sensitive_counts(spark, sf_dir):
    return redact.sensitive_counts(texts(spark, sf_dir), "text", ["origin"])


_REDACT_SQL = "text"
for _p in _SQL_PATTERNS.values():
    _REDACT_SQL = f"regexp_replace({_REDACT_SQL}, '{_p}', '[REDACTED]', 'g')"


@query("redacted_texts", f"SELECT origin, id, sha256({_REDACT_SQL}) AS digest FROM texts", TEXTS_SQL)
def redacted_texts(spark, sf_dir):
    return texts(spark, sf_dir).select(
        "origin", "id", F.sha2(redact.redact(F.col("text")), 256).alias("digest")
    )


_HINTS_SQL = " OR ".join(
    f"contains(lower(text), '{h}=') OR contains(lower(text), '\"{h}\":')" for h in redact.SENSITIVE_HINTS
)


@query(
    "safe_diagnostics",
    f"""SELECT origin, NOT ({_HINTS_SQL}) AND NOT regexp_matches(text, '-?\\d{{1,3}}\\.\\d{{4,}}\\s*,\\s*-?\\d{{1,3}}\\.\\d{{4,}}')
      AND NOT regexp_matches(text, '\\d{{11,}}') AS safe, count(*) AS rows FROM texts GROUP BY ALL""",
    TEXTS_SQL,
)
def safe_diagnostics(spark, sf_dir):
    return (
        texts(spark, sf_dir)
        .groupBy("origin", redact.is_safe_diagnostic(F.col("text")).alias("safe"))
        .agg(F.count(F.lit(1)).alias("rows"))
    )


# ------------------------------------------------------------------ batch import

RUN = ingest.ImportRun(TENANT, "fleet", datetime(2026, 8, 5, tzinfo=timezone.utc))


LINES_PER_FILE = 250_000


def _file_count(spark, sf_dir):
    """How many files of bounded size the lines of all events make."""
    return -(-table(spark, sf_dir, "events").count() // LINES_PER_FILE)


def event_lines(spark, sf_dir):
    """NDJSON lines made of the telemetry view; some are broken, foreign, untyped or resent."""
    # The supplied file is one small split; real batches arrive as many.
    parts = max(spark.sparkContext.defaultParallelism, _file_count(spark, sf_dir))
    e = telemetry(spark, sf_dir).repartition(parts)
    n = F.col("arrival")
    good = F.to_json(
        F.struct(
            F.lit("0.1.0").alias("schema_version"),
            F.when(n % 103 == 0, F.lit("tenant_b")).otherwise(F.col("tenant_id")).alias("tenant_id"),
            "source",
            F.struct("event_identity.basis", "event_identity.value").alias("event_identity"),
            F.when(n % 107 == 0, F.lit("John")).otherwise(F.col("asset_ref")).alias("asset_ref"),
            "device_ref",
            utc_iso(F.col("received_at")).alias("received_at"),
            utc_iso(F.col("vendor_received_at")).alias("vendor_received_at"),
            utc_iso(F.col("device_time")).alias("device_time"),
            F.when(
                F.col("position.lat").isNotNull() & (F.col("position.lat") < 90), F.col("position")
            ).alias("position"),
            F.struct("motion.ignition", "motion.motion_state").alias("motion"),
            "power",
            "network",
            "device",
            "alerts",
            F.struct(
                F.sha2(n.cast("string"), 256).alias("raw_sha256"), F.lit("view-1").alias("adapter_version")
            ).alias("quality"),
        )
    )
    line = (
        F.when(n % 101 == 0, F.substring(good, 1, 40))
        .when(n % 109 == 0, F.replace(good, F.lit('"schema_version":"0.1.0"'), F.lit('"schema_version":"9"')))
        .otherwise(good)
    )
    return evaluate_once(
        e.select(
            F.concat(F.lit("batch_"), "source").alias("file"),
            (n + 1).alias("row_number"),
            line.alias("line"),
        )
    )


IMPORT_SQL = """lines AS (
  SELECT 'batch_' || event_type AS file, event_id AS n, user_id || '-' || (epoch_us(ts) // 1000 // 7200000) AS identity_value,
    CASE WHEN event_id % 101 = 0 THEN 'MALFORMED_JSON' WHEN event_id % 103 = 0 THEN 'TENANT_MISMATCH'
      WHEN event_id % 107 = 0 OR event_id % 109 = 0 THEN 'SCHEMA_VALIDATION_FAILED' END AS code,
    CASE WHEN event_id % 101 = 0 THEN '' WHEN event_id % 103 = 0 THEN '/tenant_id' ELSE concat_ws(',',
      CASE WHEN event_id % 109 = 0 THEN '/schema_version' END, CASE WHEN event_id % 107 = 0 THEN '/asset_ref' END) END AS paths
  FROM events
), first_lines AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY identity_value ORDER BY file, n) AS r
  FROM lines WHERE code IS NULL) WHERE r = 1)"""


def _imported(spark, sf_dir):
    return ingest.import_rows(readers.parse_ndjson(event_lines(spark, sf_dir)), RUN)


@query(
    "import_quarantine",
    "SELECT file, n + 1 AS row_number, code, paths FROM lines WHERE code IS NOT NULL",
    IMPORT_SQL,
)
def import_quarantine(spark, sf_dir):
    return _imported(spark, sf_dir).quarantine.select(
        "file", "row_number", "code", F.array_join("field_paths", ",").alias("paths")
    )


@query(
    "import_observations",
    "SELECT file, n + 1 AS row_number, identity_value FROM first_lines",
    IMPORT_SQL,
)
def import_observations(spark, sf_dir):
    return _imported(spark, sf_dir).observations.select(
        "file", "row_number", F.col("event_identity.value").alias("identity_value")
    )


@query(
    "import_summary",
    """SELECT l.file AS batch_id, count(*) AS rows_read, count(f.n) AS accepted, count(*) FILTER (l.code IS NULL) - count(f.n) AS duplicates,
    count(l.code) AS quarantined, count(*) FILTER (l.code IS NULL) + 1 AS receipts
    FROM lines l LEFT JOIN first_lines f ON f.n = l.n GROUP BY l.file""",
    IMPORT_SQL,
)
def import_summary(spark, sf_dir):
    return _imported(spark, sf_dir).summary


@query(
    "import_receipts",
    """SELECT file AS batch_id, count(*) FILTER (code IS NULL) + 1 AS receipts FROM lines GROUP BY file""",
    IMPORT_SQL,
)
def import_receipts(spark, sf_dir):
    return ingest.counts_by(_imported(spark, sf_dir).receipts, "batch_id").withColumnRenamed("rows", "receipts")


@query(
    "import_typed_fields",
    """SELECT source, count(*) AS observations, count(*) FILTER (has_position) AS positions, count(*) FILTER (has_power) AS powers,
      count(*) FILTER (has_network) AS networks, count(device_ms) AS device_times, max(received_ms) AS last_received_ms FROM (
      SELECT f.file[7:] AS source, has_position AND lat < 90 AS has_position, has_power, has_network, device_ms, received_ms
      FROM first_lines f JOIN telemetry t ON t.arrival = f.n) GROUP BY source""",
    IMPORT_SQL + ", " + TELEMETRY_SQL,
)
def import_typed_fields(spark, sf_dir):
    return _imported(spark, sf_dir).observations.groupBy("source").agg(
        F.count(F.lit(1)).alias("observations"),
        F.count("position").alias("positions"),
        F.count("power").alias("powers"),
        F.count("network").alias("networks"),
        F.count("device_time").alias("device_times"),
        F.max(ms("received_at")).alias("last_received_ms"),
    )


@query(
    "derived_identities",
    """SELECT arrival, CASE WHEN arrival % 3 = 0 THEN 'vendor_event_id' WHEN arrival % 3 = 1 THEN 'vendor_sequence' ELSE 'synthesised' END AS basis,
    CASE WHEN arrival % 3 < 2 THEN CAST(arrival AS VARCHAR) ELSE 'h:' || substr(sha256(concat_ws('|', tenant_id, source, device_ref,
      coalesce(CAST(device_ms AS VARCHAR), ''), 'row' || arrival)), 1, 32) END AS value FROM telemetry""",
    TELEMETRY_SQL,
)
def derived_identities(spark, sf_dir):
    n = F.col("arrival")
    identity = ingest.derive_identity(
        F.col("tenant_id"),
        F.col("source"),
        F.col("device_ref"),
        ms("device_time"),
        F.concat(F.lit("row"), n.cast("string")),
        F.when(n % 3 == 0, n),
        F.when(n % 3 == 1, n),
    )
    return telemetry(spark, sf_dir).select("arrival", identity.alias("i")).select("arrival", "i.basis", "i.value")


@query(
    "csv_cells",
    """SELECT status, absent, explicit_null, count(*) AS rows FROM (SELECT CASE WHEN c_custkey % 13 = 0 OR c_custkey % 17 = 0 THEN 'MALFORMED_CSV_ROW' END AS status,
      c_custkey % 5 = 0 AND status IS NULL AS absent, c_custkey % 5 = 1 AND status IS NULL AS explicit_null FROM customer) GROUP BY ALL""",
)
def csv_cells(spark, sf_dir):
    key = F.col("c_custkey")
    cell = F.when(key % 5 == 0, F.lit("")).when(key % 5 == 1, F.lit("null")).otherwise(F.lit('"a ""quoted"", cell"'))
    line = F.concat_ws(",", key.cast("string"), cell, F.col("c_mktsegment"))
    broken = (
        F.when(key % 13 == 0, F.concat(line, F.lit(",extra")))
        .when(key % 17 == 0, F.concat(line, F.lit('"')))
        .otherwise(line)
    )
    lines = table(spark, sf_dir, "customer").select(
        F.lit("customers.csv").alias("file"), (key + 1).alias("row_number"), broken.alias("line")
    )
    parsed = readers.parse_csv(lines, ["key", "note", "segment"])
    fields = F.try_variant_get("raw", "$", "map<string,variant>")
    note = F.try_element_at(fields, F.lit("note"))
    sound = F.col("parse_error").isNull()
    return parsed.groupBy(
        F.col("parse_error").alias("status"),
        (sound & ~F.coalesce(F.map_contains_key(fields, "note"), F.lit(False))).alias("absent"),
        (sound & F.coalesce(F.is_variant_null(note), F.lit(False))).alias("explicit_null"),
    ).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "csv_files",
    """SELECT 'wide' AS kind, count(*) AS rows, 0 AS malformed, sum(c_custkey) AS keys, sum(c_custkey + 599) AS others FROM customer
    UNION ALL SELECT 'blank', count(*), 0, sum(c_custkey), sum(c_custkey + 1) FROM customer""",
)
def csv_files(spark, sf_dir):
    """Customers as CSV files of 600 columns, and with a blank header cell, through the file reader."""
    key = F.col("c_custkey")
    result = None
    for kind, names in (("wide", [f"k{i}" for i in range(600)]), ("blank", ["k0", "", "k2"])):
        path = scratch_path(spark, f"csv-{kind}")
        cells = [(key + i).cast("string").alias(f"k{i}") for i in range(len(names))]
        table(spark, sf_dir, "customer").select(*cells).toDF(*names).write.option("header", "true").csv(path)
        fields = F.try_variant_get("raw", "$", "map<string,string>")
        cell = lambda name, fields=fields: F.try_element_at(fields, F.lit(name)).cast("bigint")
        rows = readers.read_csv(spark, [path]).agg(
            F.lit(kind).alias("kind"),
            F.count(F.lit(1)).alias("rows"),
            F.count("parse_error").alias("malformed"),
            F.sum(cell("k0")).alias("keys"),
            F.sum(cell(names[-1] if kind == "wide" else "")).alias("others"),
        )
        result = rows if result is None else result.unionByName(rows)
    return result


@query(
    "vendor_mapping",
    """SELECT ignition, motion_state, alert, external_state, warning, decoded, count(*) AS events, max(speed) AS fastest_kph FROM (
      SELECT CASE k % 4 WHEN 0 THEN 'on' WHEN 1 THEN 'off' WHEN 2 THEN 'unknown' END AS ignition,
        CASE k % 3 WHEN 0 THEN 'moving' WHEN 1 THEN 'stationary' END AS motion_state,
        CASE event_type WHEN 'error' THEN 'power_cut' WHEN 'view' THEN 'unplug' WHEN 'click' THEN 'other' END AS alert,
        CASE WHEN k % 5 = 0 THEN 'present' WHEN k % 5 = 1 THEN 'absent' END AS external_state, event_id % 7 = 0 AS warning,
        event_id % 19 <> 0 AS decoded, CASE WHEN event_id % 19 <> 0 THEN floor(value * 1.852::DOUBLE * 10 + 0.5) / 10.0::DOUBLE END AS speed
      FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
      WHERE event_id % 19 <> 0
      UNION ALL SELECT NULL, NULL, NULL, NULL, false, false, NULL FROM events WHERE event_id % 19 = 0) GROUP BY ALL""",
)
def vendor_mapping(spark, sf_dir):
    n, kind = F.col("event_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("int")
    # A boolean, a word that is neither, or nothing at all.
    ignition = F.when(k % 4 == 0, F.lit("true")).when(k % 4 == 1, F.lit("false")).when(k % 4 == 2, F.lit('"maybe"'))
    motion = F.when(k % 3 == 0, F.lit("true")).when(k % 3 == 1, F.lit("false"))
    charge = F.when(k % 5 == 0, F.lit("true")).when(k % 5 == 1, F.lit("false"))
    alarm = F.when(kind == "error", F.lit('"powerCut"')).when(kind == "view", F.lit('"removing"')).when(
        kind == "click", F.lit('"neverSeen"')
    )

    def pair(name, value):
        return F.concat(F.lit(f'"{name}":'), value)

    attributes = F.concat_ws(
        ",",
        *[
            F.when(v.isNotNull(), pair(name, v))
            for name, v in (("ignition", ignition), ("motion", motion), ("charge", charge), ("alarm", alarm))
        ],
        F.lit('"extra":1'),
    )
    when = utc_iso(F.col("ts").cast("timestamp"))
    position = F.concat(
        F.lit('{"id":'), n.cast("string"), F.lit(',"latitude":-1.2,"longitude":36.8,"valid":true,"speed":'),
        F.col("value").cast("string"),
        F.lit(',"deviceTime":"'), when, F.lit('","fixTime":"'),
        F.when(n % 7 == 0, F.lit("2020-01-01T00:00:00.000Z")).otherwise(when),
        F.lit('","attributes":{'), attributes, F.lit("}}"),
    )
    payload = F.when(n % 19 == 0, F.lit('{"device":{"uniqueId":"x"}}')).otherwise(
        F.concat(F.lit('{"position":'), position, F.lit("}"))
    )
    payloads = table(spark, sf_dir, "events").select(
        F.parse_json(payload).alias("payload"),
        F.lit("ast_00000001").alias("asset_ref"),
        F.lit("dev_00000001").alias("device_ref"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    decoded = vendor.decode(payloads, TENANT, "forwarder")
    return decoded.groupBy(
        "motion.ignition",
        "motion.motion_state",
        F.get("alerts", F.lit(0))["code"].alias("alert"),
        "power.external_state",
        F.col("quality.parse_warnings").isNotNull().alias("warning"),
        F.col("decode_error").isNull().alias("decoded"),
    ).agg(F.count(F.lit(1)).alias("events"), F.max("motion.speed_kph").alias("fastest_kph"))


# ------------------------------------------------------------------ observation versions

VERSION_SQL = """versions AS (
  SELECT l_orderkey AS identity, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) AS version,
    'adapter-' || l_linenumber AS adapter_version, l_returnflag = 'R' AS superseded FROM lineitem)"""


def observation_versions(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("identity"),
        F.row_number().over(w).cast("bigint").alias("version"),
        F.concat(F.lit("adapter-"), F.col("l_linenumber").cast("string")).alias("adapter_version"),
        (F.col("l_returnflag") == "R").alias("superseded"),
    )


@query(
    "next_versions",
    """SELECT o_orderkey AS identity, 'adapter-3' AS adapter_version, max(version) + 1 AS version FROM orders JOIN versions ON identity = o_orderkey
    GROUP BY o_orderkey HAVING count(*) FILTER (adapter_version = 'adapter-3') = 0""",
    VERSION_SQL,
)
def next_versions(spark, sf_dir):
    decoded = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("identity"), F.lit("adapter-3").alias("adapter_version")
    )
    return versions.next_versions(decoded, observation_versions(spark, sf_dir))


@query(
    "current_observation_versions",
    "SELECT identity, max(version) AS version, arg_max(adapter_version, version) AS adapter_version FROM versions WHERE NOT superseded GROUP BY identity",
    VERSION_SQL,
)
def current_observation_versions(spark, sf_dir):
    return versions.current_versions(observation_versions(spark, sf_dir)).select("identity", "version", "adapter_version")


@query(
    "version_diff",
    """SELECT d.f AS field, d.c AS changed, count(*) AS identities FROM (SELECT unnest([{'f': 'status', 'c': o_orderstatus = 'P'},
      {'f': 'price', 'c': false}, CASE WHEN o_orderkey % 3 = 0 THEN {'f': 'note', 'c': true} END]) AS d FROM orders) WHERE d IS NOT NULL GROUP BY ALL""",
)
def version_diff(spark, sf_dir):
    o = table(spark, sf_dir, "orders")

    def payload(status, note):
        fields = F.create_map(
            F.lit("status"), status, F.lit("price"), F.col("o_totalprice").cast("string"), F.lit("note"), note
        )
        kept = F.map_filter(fields, lambda _, v: v.isNotNull())
        return F.parse_json(F.to_json(kept))

    status = F.col("o_orderstatus")
    before = o.select(F.col("o_orderkey").alias("identity"), payload(status, F.lit(None).cast("string")).alias("payload"))
    after = o.select(
        F.col("o_orderkey").alias("identity"),
        payload(
            F.when(status == "P", F.lit("F")).otherwise(status), F.when(F.col("o_orderkey") % 3 == 0, F.lit("new"))
        ).alias("payload"),
    )
    return versions.diff_versions(before, after).groupBy("field", "changed").agg(F.count(F.lit(1)).alias("identities"))


def _stored(spark, sf_dir):
    """Documents as stored payloads; some are lost and some have rotted."""
    d = table(spark, sf_dir, "documents")
    return d.filter(F.col("doc_id") % 31 != 0).select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("raw_sha256"),
        F.encode(
            F.concat(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), F.when(F.col("doc_id") % 37 == 0, F.lit("x")).otherwise(F.lit(""))),
            "utf-8",
        ).alias("content"),
    )


@query(
    "receipt_trace",
    """SELECT trace_status, count(*) AS observations FROM (SELECT CASE WHEN doc_id % 29 = 0 THEN 'no_receipt' WHEN doc_id % 31 = 0 THEN 'no_payload'
      WHEN doc_id % 37 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS trace_status FROM documents) GROUP BY trace_status""",
)
def receipt_trace(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    digest = F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("raw_sha256")
    observed = d.select("doc_id", digest)
    kept = d.filter(F.col("doc_id") % 29 != 0).select(digest, F.lit(datetime(2026, 8, 5)).alias("received_at"))
    return versions.trace(observed, kept, _stored(spark, sf_dir)).groupBy("trace_status").agg(
        F.count(F.lit(1)).alias("observations")
    )


@query(
    "payload_sample",
    """SELECT raw_sha256, CASE WHEN doc_id % 31 = 0 THEN 'missing' WHEN doc_id % 37 = 0 THEN 'hash_mismatch' ELSE 'verified' END AS status
    FROM (SELECT doc_id, sha256(concat_ws('|', doc_id, text)) AS raw_sha256 FROM documents) ORDER BY sha256(raw_sha256 || ':7') LIMIT 64""",
)
def payload_sample(spark, sf_dir):
    """A seeded sample of the stored payloads, verified by hashing again."""
    keys = table(spark, sf_dir, "documents").select(
        F.sha2(F.concat_ws("|", F.col("doc_id").cast("string"), "text"), 256).alias("raw_sha256")
    )
    return versions.verify_sample(keys, _stored(spark, sf_dir), 64, 7)


# ------------------------------------------------------------------ geometry and corridors

@query(
    "segment_keys",
    """SELECT s_suppkey, 'seg_' || substr(sha256(printf('%.6f,%.6f', lon, lat) || ';' || printf('%.6f,%.6f', lon + 0.25::DOUBLE, lat + 0.5::DOUBLE)), 1, 24)
      AS segment_key FROM (SELECT s_suppkey, s_acctbal / 50.0::DOUBLE AS lon, s_nationkey / 8.0::DOUBLE AS lat FROM supplier)""",
)
def segment_keys(spark, sf_dir):
    lon, lat = F.col("s_acctbal") / F.lit(50.0), F.col("s_nationkey") / F.lit(8.0)
    points = F.array(
        F.struct(lon.alias("lon"), lat.alias("lat")),
        F.struct((lon + 0.25).alias("lon"), (lat + 0.5).alias("lat")),
    )
    return table(spark, sf_dir, "supplier").select("s_suppkey", corridor.segment_key(points).alias("segment_key"))


@query(
    "grid_cells",
    """SELECT 'g0.5:' || CAST(floor((c_acctbal / 150.0::DOUBLE) / 0.5::DOUBLE) AS BIGINT) || ':' || CAST(floor(((c_custkey % 360) - 180.0::DOUBLE) / 0.5::DOUBLE) AS BIGINT) AS cell,
    least(c_nationkey % 9, 6) AS resolution, count(*) AS customers FROM customer GROUP BY ALL""",
)
def grid_cells(spark, sf_dir):
    lat, lon = F.col("c_acctbal") / F.lit(150.0), (F.col("c_custkey") % 360) - F.lit(180.0)
    return (
        table(spark, sf_dir, "customer")
        .groupBy(grid_cell(lat, lon, 0.5).alias("cell"), corridor.coarsen(F.col("c_nationkey") % 9).alias("resolution"))
        .agg(F.count(F.lit(1)).alias("customers"))
    )


_HAVERSINE = """12742000.0::DOUBLE * asin(least(1, sqrt(pow(sin(radians({b} - {a}) / 2), 2)
  + cos(radians({a})) * cos(radians({b})) * pow(sin(radians({d} - {c}) / 2), 2))))"""
_POINTS_SQL = """points AS (SELECT c_custkey AS point_id, c_acctbal / 150.0::DOUBLE AS lat, (c_custkey % 360) - 180.0::DOUBLE AS lon FROM customer),
nodes AS (SELECT n_nationkey AS node_id, n_nationkey * 3 - 30.0::DOUBLE AS lat, n_nationkey * 13 - 160.0::DOUBLE AS lon FROM nation)"""


def _points(spark, sf_dir):
    points = table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("point_id"),
        (F.col("c_acctbal") / F.lit(150.0)).alias("lat"),
        ((F.col("c_custkey") % 360) - F.lit(180.0)).alias("lon"),
    )
    nodes = table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("node_id"),
        (F.col("n_nationkey") * 3 - F.lit(30.0)).alias("lat"),
        (F.col("n_nationkey") * 13 - F.lit(160.0)).alias("lon"),
    )
    return points, nodes


@query(
    "great_circle",
    f"SELECT point_id, round({_HAVERSINE.format(a='p.lat', b='0.0::DOUBLE', c='p.lon', d='36.8::DOUBLE')}, 3) AS distance_m FROM points p",
    _POINTS_SQL,
)
def great_circle(spark, sf_dir):
    points, _ = _points(spark, sf_dir)
    away = great_circle_m(F.col("lat"), F.col("lon"), F.lit(0.0), F.lit(36.8))
    return points.select("point_id", F.round(away, 3).alias("distance_m"))


@query(
    "nearest_nodes",
    f"""SELECT point_id, arg_min(node_id, (d, node_id)) AS node_id, round(min(d), 3) AS distance_m FROM (
      SELECT p.point_id, n.node_id, {_HAVERSINE.format(a='p.lat', b='n.lat', c='p.lon', d='n.lon')} AS d FROM points p, nodes n) GROUP BY point_id""",
    _POINTS_SQL,
)
def nearest_nodes(spark, sf_dir):
    points, nodes = _points(spark, sf_dir)
    found = corridor.nearest_node(points, nodes, degrees=8.0)
    return found.select("point_id", "node_id", F.round("distance_m", 3).alias("distance_m"))


ROADS_SQL = """edges AS (
  SELECT c_custkey AS a, c_custkey + 1 AS b, 100.0::DOUBLE + c_nationkey AS w FROM customer
  UNION ALL SELECT c_custkey + 1, c_custkey, 100.0::DOUBLE + c_nationkey FROM customer
  UNION ALL SELECT c_custkey, c_custkey + 4, 450.0::DOUBLE FROM customer WHERE c_mktsegment = 'BUILDING'
), nodes AS (SELECT c_custkey AS node, c_custkey // 2 AS cell FROM customer),
requests AS (SELECT s_suppkey AS request_id, s_suppkey * 15 AS a, s_suppkey * 15 + 6 + s_nationkey % 5 AS b,
  (60.0::DOUBLE + s_nationkey % 3) * (30.0::DOUBLE - s_suppkey % 4) / 3.6::DOUBLE * 2 AS budget FROM supplier),
go AS (
  SELECT request_id, a AS node, 0.0::DOUBLE AS dist, budget FROM requests
  UNION
  SELECT g.request_id, e.b, g.dist + e.w, g.budget FROM go g JOIN edges e ON e.a = g.node WHERE g.dist + e.w <= g.budget
), back AS (
  SELECT request_id, b AS node, 0.0::DOUBLE AS dist, budget FROM requests
  UNION
  SELECT g.request_id, e.a, g.dist + e.w, g.budget FROM back g JOIN edges e ON e.b = g.node WHERE g.dist + e.w <= g.budget
), feasible AS (
  SELECT g.request_id, g.node, n.cell FROM (SELECT request_id, node, min(dist) AS d, min(budget) AS budget FROM go GROUP BY ALL) g
  JOIN (SELECT request_id, node, min(dist) AS d FROM back GROUP BY ALL) h USING (request_id, node) JOIN nodes n USING (node)
  WHERE g.d + h.d <= g.budget
)"""


def roads(spark, sf_dir):
    """Customers along a road, with one-way bypasses at one market segment."""
    c = table(spark, sf_dir, "customer")
    along = c.select(
        F.col("c_custkey").alias("from_node"),
        (F.col("c_custkey") + 1).alias("to_node"),
        (F.lit(100.0) + F.col("c_nationkey")).alias("length_m"),
        F.lit(False).alias("one_way"),
        F.concat(F.lit("road "), F.col("c_nationkey").cast("string")).alias("road_name"),
    )
    bypass = c.filter(F.col("c_mktsegment") == "BUILDING").select(
        F.col("c_custkey").alias("from_node"),
        (F.col("c_custkey") + 4).alias("to_node"),
        F.lit(450.0).alias("length_m"),
        F.lit(True).alias("one_way"),
        F.lit(None).cast("string").alias("road_name"),
    )
    edges = along.unionByName(bypass).withColumns(
        {"motorcycle_access": F.lit(True), "car_access": F.col("one_way")}
    )
    nodes = c.select(F.col("c_custkey").alias("node_id"), F.floor(F.col("c_custkey") / 2).alias("cell"))
    key, nation = F.col("s_suppkey"), F.col("s_nationkey")
    asked = table(spark, sf_dir, "supplier").select(
        key.alias("request_id"),
        (key * 15).alias("from_node"),
        (key * 15 + 6 + nation % 5).alias("to_node"),
        (F.lit(60.0) + nation % 3).alias("elapsed_s"),
        ((F.lit(30.0) - key % 4) * 2).alias("max_speed_kph"),
    )
    return asked, nodes, edges


@query(
    "feasible_region",
    "SELECT request_id, count(*) AS feasible_nodes, count(DISTINCT cell) AS feasible_cells FROM feasible GROUP BY request_id",
    ROADS_SQL,
)
def feasible_region(spark, sf_dir):
    requests, nodes, edges = roads(spark, sf_dir)
    asked = requests.withColumn("budget_m", F.col("elapsed_s") * F.col("max_speed_kph") / F.lit(3.6))
    found = corridor.feasible_nodes(asked, corridor.passable_edges(edges))
    return (
        found.join(nodes.withColumnRenamed("node_id", "node"), "node")
        .groupBy("request_id")
        .agg(F.count(F.lit(1)).alias("feasible_nodes"), F.count_distinct("cell").alias("feasible_cells"))
    )


CORRIDOR_SQL = ROADS_SQL + """, trials AS (
  SELECT DISTINCT f.request_id, f.cell FROM feasible f JOIN requests r USING (request_id) WHERE f.cell NOT IN (r.a // 2, r.b // 2)
), again AS (
  SELECT t.request_id, t.cell, r.a AS node, 0.0::DOUBLE AS dist, r.budget FROM trials t JOIN requests r USING (request_id)
  UNION
  SELECT g.request_id, g.cell, e.b, g.dist + e.w, g.budget FROM again g JOIN edges e ON e.a = g.node WHERE g.dist + e.w <= g.budget AND e.b // 2 <> g.cell
), unavoidable AS (
  SELECT request_id, cell FROM trials t WHERE NOT EXISTS (SELECT 1 FROM again g JOIN requests r USING (request_id)
    WHERE g.request_id = t.request_id AND g.cell = t.cell AND g.node = r.b)
), statuses AS (
  SELECT r.request_id, CASE WHEN count(f.node) FILTER (f.node = r.b) = 0 THEN 'infeasible'
    WHEN (SELECT count(*) FROM unavoidable u WHERE u.request_id = r.request_id) < 1 THEN 'corridor_ambiguous' ELSE 'corridor' END AS status,
    CAST(floor(r.budget + 0.5) AS BIGINT) AS budget_m, count(f.node) AS feasible_nodes,
    (SELECT count(*) FROM unavoidable u WHERE u.request_id = r.request_id) AS interior_cells
  FROM requests r LEFT JOIN feasible f USING (request_id) GROUP BY r.request_id, r.budget
)"""


@query("corridor_status", "SELECT * FROM statuses", CORRIDOR_SQL)
def corridor_status(spark, sf_dir):
    return corridor.project_corridors(*roads(spark, sf_dir))[0].drop("claim")


@query(
    "corridor_cells",
    """SELECT request_id, cell, 'unavoidable' AS role FROM unavoidable JOIN statuses USING (request_id) WHERE status = 'corridor'
    UNION ALL SELECT DISTINCT r.request_id, unnest([r.a // 2, r.b // 2]), 'endpoint' FROM requests r JOIN statuses USING (request_id) WHERE status = 'corridor'
    UNION ALL SELECT DISTINCT request_id, cell, 'feasible' FROM feasible JOIN statuses USING (request_id) WHERE status <> 'infeasible'""",
    CORRIDOR_SQL,
)
def corridor_cells(spark, sf_dir):
    return corridor.project_corridors(*roads(spark, sf_dir))[1]


@query(
    "corridor_roads",
    """, held AS (
      SELECT request_id, cell FROM unavoidable JOIN statuses USING (request_id) WHERE status = 'corridor'
      UNION SELECT r.request_id, unnest([r.a // 2, r.b // 2]) FROM requests r JOIN statuses USING (request_id) WHERE status = 'corridor'
    ), named AS (SELECT 'road ' || c_nationkey AS road_name, unnest([c_custkey, c_custkey + 1]) AS node FROM customer)
    SELECT h.request_id, h.cell, coalesce((SELECT string_agg(DISTINCT road_name, ',' ORDER BY road_name) FROM feasible f JOIN named USING (node)
      WHERE f.request_id = h.request_id AND f.cell = h.cell), '') AS road_names FROM held h""",
    CORRIDOR_SQL,
)
def corridor_roads(spark, sf_dir):
    requests, nodes, edges = roads(spark, sf_dir)
    asked = requests.withColumn("budget_m", F.col("elapsed_s") * F.col("max_speed_kph") / F.lit(3.6))
    feasible = corridor.feasible_nodes(asked, corridor.passable_edges(edges))
    _, cells = corridor.project_corridors(requests, nodes, edges)
    found = corridor.corridor_table(cells, feasible, nodes, edges)
    return found.withColumn("road_names", F.array_join("road_names", ","))


# ------------------------------------------------------------------ audit and streams

@query("audit_sections")
def audit_report(spark, sf_dir):
    """Rows and hash of every audit section before suppression."""
    sections = audit_sections(telemetry(spark, sf_dir), POLICY)
    rows = None
    for name, frame in sections.items():
        hashed = redact.section_hash(frame).withColumn("section", F.lit(name))
        rows = hashed if rows is None else rows.unionByName(hashed)
    return rows


def _event_stream(spark, sf_dir):
    schema = table(spark, sf_dir, "events").schema
    return (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", "events.parquet")
        .option("maxFilesPerTrigger", 1)
        .parquet(sf_dir)
    )


def _run_to_table(stream, out: str, mode: str = "append"):
    """Run a stream over what is there into a table."""
    checkpoint = scratch_path(stream.sparkSession, "stream-checkpoint")
    (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


@query(
    "stream_deduplicated",
    "SELECT event_type AS source, count(DISTINCT user_id || '-' || (epoch_us(ts) // 1000 // 7200000)) AS observations FROM events GROUP BY event_type",
)
def stream_deduplicated(spark, sf_dir):
    """Resends dropped inside the watermark delay, per source."""
    events = _event_stream(spark, sf_dir).select(
        F.col("event_type").alias("source"),
        F.col("ts").cast("timestamp").alias("received_at"),
        F.concat_ws(
            "|",
            "event_type",
            F.concat_ws("-", F.col("user_id").cast("string"), F.floor(epoch_ms("ts") / 7_200_000).cast("string")),
        ).alias("idempotency_key"),
    )
    out = scratch_path(spark, "stream-out")
    _run_to_table(stream_ingest.deduplicated(events, "60 days").select("source"), out)
    return spark.read.schema("source string").parquet(out).groupBy("source").agg(F.count(F.lit(1)).alias("observations"))


@query(
    "stream_import",
    """SELECT 'observation' AS kind, identity_value AS label, 1 AS rows FROM first_lines
    UNION ALL SELECT 'quarantine', code, 2 * count(*) FROM lines WHERE code IS NOT NULL GROUP BY code
    UNION ALL SELECT 'receipt', 'fleet', 2 * count(*) FROM lines WHERE code IS NULL""",
    IMPORT_SQL,
)
def stream_import(spark, sf_dir):
    """The tables of a continuous import of files that come twice: each line is sent again in a later micro-batch."""
    landed, base = scratch_path(spark, "stream-in"), scratch_path(spark, "stream-tables")
    lines = event_lines(spark, sf_dir).select(F.col("line").alias("value"))
    # a packed file is one task, so a micro-batch has a file for each of them
    half = max(spark.sparkContext.defaultParallelism, -(-_file_count(spark, sf_dir) // 2))
    with shuffles_dropped(spark):
        for _ in range(2):
            lines.repartition(2 * half).write.mode("append").text(landed, compression="gzip")
    stream_ingest.stream_ndjson(spark, landed, RUN, base, f"{base}/checkpoint", files_per_batch=half).awaitTermination()
    observations, quarantine, receipts = (read_table(spark, base, name) for name in stream_ingest.TABLES)

    def counted(kind, rows, label):
        return rows.groupBy(F.lit(kind).alias("kind"), label.alias("label")).agg(F.count(F.lit(1)).alias("rows"))

    return (
        counted("observation", observations, F.col("event_identity.value"))
        .unionByName(counted("quarantine", quarantine, F.col("code")))
        .unionByName(counted("receipt", receipts.filter("row_number IS NOT NULL"), F.col("source")))
    )


@query(
    "stream_deadlines",
    """SELECT 'dev_' || user_id AS device_ref, t AS start_ms, later AS end_ms, due AS deadline_ms FROM (
      SELECT user_id, t, due, lead(t) OVER (PARTITION BY user_id ORDER BY t) AS later FROM (
        SELECT user_id, epoch_us(ts) // 1000 AS t, max(epoch_us(ts) // 1000 + CASE event_type WHEN 'error' THEN 10800000
          WHEN 'view' THEN 43200000 ELSE 129600000 END) AS due FROM events GROUP BY ALL))
    WHERE later > due OR (later IS NULL AND due < (SELECT max(epoch_us(ts) // 1000) FROM events))""",
)
def stream_deadlines(spark, sf_dir):
    """Silences that hold after a stream of four batches, each with reports of the whole month: nearly all are late."""
    spark.conf.set(
        "spark.sql.streaming.stateStore.providerClass",
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    )
    patience = (
        F.when(F.col("event_type") == "error", 10_800_000)
        .when(F.col("event_type") == "view", 43_200_000)
        .otherwise(129_600_000)
    )
    reports = table(spark, sf_dir, "events").select(
        F.concat(F.lit("dev_"), F.col("user_id").cast("string")).alias("device_ref"),
        epoch_ms("ts").alias("at_ms"),
        (epoch_ms("ts") + patience).alias("deadline_ms"),
        F.col("ts").cast("timestamp").alias("received_at"),
    )
    landed = scratch_path(spark, "stream-in")
    per_batch = max(1, -(-_file_count(spark, sf_dir) // 4))
    reports.repartition(4 * per_batch, F.xxhash64("device_ref", "at_ms")).write.parquet(landed)
    stream = spark.readStream.schema(reports.schema).option("maxFilesPerTrigger", per_batch).parquet(landed)
    out = scratch_path(spark, "stream-out")
    _run_to_table(deadline.monitor_deadlines(deadline.on_clock(stream, "received_at"), keep_days=None), out)
    return deadline.current_episodes(spark.read.schema(deadline.OUTPUT_SCHEMA).parquet(out))


@query(
    "source_union",
    "SELECT source, count(*) AS events FROM (SELECT event_type AS source FROM events UNION ALL SELECT source FROM documents) GROUP BY source",
)
def source_union(spark, sf_dir):
    """Observations of several inputs as one."""
    a = table(spark, sf_dir, "events").select(F.col("event_type").alias("source"))
    b = table(spark, sf_dir, "documents").select("source")
    return a.unionByName(b).groupBy("source").agg(F.count(F.lit(1)).alias("events"))
