"""Queries that write before they read: files through the file readers, tables through the jobs that change them."""

from __future__ import annotations

from pyspark.sql import functions as F

from quietwatch.catalog import source_queries
from quietwatch.catalog.case_queries import NOW_MS, RETAINED_SQL, holds, retained_items
from quietwatch.catalog.source_queries import IMPORT_SQL, RUN, event_lines
from quietwatch.catalog.views import EPISODES_SQL, POLICY, table, telemetry
from quietwatch.functions.scalars import from_ms, ms
from quietwatch.operators import corridor, episodes, lifecycle, retention
from quietwatch.session import scratch_path, written
from quietwatch.sources import ingest, readers, versions

QUERIES = {}
ORACLE = {}


def query(name: str, sql: str, view: str = "none AS (SELECT 1)"):
    def register(function):
        QUERIES[name] = function
        ORACLE[name] = f"WITH RECURSIVE {view.strip()}\n{sql.strip()}"
        return function

    return register


# ------------------------------------------------------------------ files


@query(
    "ndjson_files",
    """SELECT coalesce(code, 'accepted') AS label, count(*) AS rows FROM (
      SELECT CASE WHEN code IS DISTINCT FROM 'MALFORMED_JSON' AND n % 5000 = 7 THEN 'ROW_TOO_LARGE' ELSE code END AS code FROM lines)
    GROUP BY code UNION ALL SELECT 'last_row', count(*) FROM lines UNION ALL SELECT 'numbers', count(*) FROM lines""",
    IMPORT_SQL,
)
def ndjson_files(spark, sf_dir):
    """NDJSON files with blank lines and rows above the limit, read in many splits; each row has its own number."""
    path = f"{scratch_path(spark, 'lines')}.ndjson"
    n = F.col("row_number") - 1
    padded = F.concat(F.lit('"ext":{"pad":"'), F.repeat(F.lit("x"), 270_000), F.lit('"},"schema_version"'))
    line = F.when(n % 5000 == 7, F.replace("line", F.lit('"schema_version"'), padded)).otherwise(F.col("line"))
    spaced = F.when(n % 10 == 0, F.concat(line, F.lit("\n  \t"))).otherwise(line)
    event_lines(spark, sf_dir).select(spaced.alias("value")).write.text(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        rows = readers.read_batch(spark, [path])
        routed = written(ingest.route(rows, RUN).select("file", "code", "row_number"), "routed")  # cut while splits are small
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    files = routed.groupBy("file").agg(
        F.max("row_number").alias("last_row"), F.count_distinct("row_number").alias("numbers")
    )
    total = lambda name: files.agg(F.lit(name).alias("label"), F.sum(name).alias("rows")).filter("rows IS NOT NULL")
    return (
        routed.groupBy(F.coalesce("code", F.lit("accepted")).alias("label")).agg(F.count(F.lit(1)).alias("rows"))
        .unionByName(total("last_row"))
        .unionByName(total("numbers"))
    )


def _hurt_file(spark, frame, name: str, damage) -> str:
    """A small Parquet file of ``frame`` with its bytes changed, in the shared folder."""
    path = scratch_path(spark, name)
    frame.coalesce(1).write.parquet(path)
    (row,) = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content").collect()
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path}-hurt/part-0.parquet")
    stream = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target)
    stream.write(bytearray(damage(bytes(row["content"]))))
    stream.close()
    return f"{path}-hurt/part-0.parquet"


def _hollow(content: bytes) -> bytes:
    a, b = len(content) // 3, len(content) // 2
    return content[:a] + bytes(b - a) + content[b:]


@query(
    "parquet_files",
    """SELECT CAST(NULL AS VARCHAR) AS error, count(*) AS rows, sum(o_orderkey) AS keys, 1 AS first_row FROM orders
    UNION ALL SELECT 'MALFORMED_PARQUET', 2, NULL, 1""",
)
def parquet_files(spark, sf_dir):
    """Orders as Parquet files, beside one cut short, one with a damaged page and one without rows."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.sha2(F.col("o_orderkey").cast("string"), 256).alias("note"))
    path, bare = scratch_path(spark, "orders"), scratch_path(spark, "no-orders")
    orders.repartition(3).write.parquet(path)
    orders.limit(0).coalesce(1).write.parquet(bare)
    few = orders.filter(F.col("o_orderkey") < 3000)
    cut = _hurt_file(spark, few, "orders-cut", lambda c: c[: len(c) // 2])
    hollow = _hurt_file(spark, few, "orders-hollow", _hollow)
    rows = readers.read_parquet(spark, [path, bare, cut, hollow])
    return rows.groupBy(F.col("parse_error").alias("error")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.try_variant_get("raw", "$.o_orderkey", "bigint")).alias("keys"),
        F.min("row_number").alias("first_row"),
    )


@query(
    "mixed_batch",
    """SELECT 'csv' AS format, count(*) AS rows, sum(c_custkey) AS keys FROM customer
    UNION ALL SELECT 'ndjson', count(*), sum(p_partkey) FROM part
    UNION ALL SELECT 'parquet', count(*), sum(s_suppkey) FROM supplier""",
)
def mixed_batch(spark, sf_dir):
    """One batch of a CSV, an NDJSON and a Parquet input, the reader chosen by the name."""
    paths = []
    for name, key, kind in (("customer", "c_custkey", "csv"), ("part", "p_partkey", "ndjson"), ("supplier", "s_suppkey", "parquet")):
        paths.append(f"{scratch_path(spark, name)}.{kind}")
        rows = table(spark, sf_dir, name).select(F.col(key).alias("key"))
        if kind == "csv":
            rows.write.option("header", "true").csv(paths[-1])
        elif kind == "ndjson":
            rows.select(F.to_json(F.struct("key")).alias("value")).write.text(paths[-1])
        else:
            rows.write.parquet(paths[-1])
    key = F.try_variant_get("raw", "$.key", "string").cast("bigint")
    return (
        readers.read_batch(spark, paths)
        .groupBy(F.regexp_extract("file", r"\.(csv|ndjson|parquet)/", 1).alias("format"))
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(key).alias("keys"))
    )


# ------------------------------------------------------------------ import and versions


@query(
    "reimport",
    "SELECT file, n + 1 AS row_number, identity_value FROM first_lines WHERE n % 3 <> 0",
    IMPORT_SQL,
)
def reimport(spark, sf_dir):
    """A second import beside a table that holds a third of its observations: only the others are new."""
    first = ingest.import_rows(readers.parse_ndjson(event_lines(spark, sf_dir)), RUN).observations
    path = scratch_path(spark, "observations")
    held = first.filter((F.col("row_number") - 1) % 3 == 0)
    ingest.append_month(held.select("idempotency_key", "tenant_id", "received_at"), path)
    existing = ingest.read_month(spark, path, RUN.tenant_id)
    again = ingest.import_rows(readers.parse_ndjson(event_lines(spark, sf_dir)), RUN, existing)
    return again.observations.select("file", "row_number", F.col("event_identity.value").alias("identity_value"))


@query(
    "enriched_times",
    """SELECT arrival, received_ms, device_ms, vendor_ms, received_ms - device_ms AS lag_ms FROM telemetry""",
    EPISODES_SQL,
)
def enriched_times(spark, sf_dir):
    """A derived column beside the three times, which stay as they were."""
    lag = ms("received_at") - ms("device_time")
    rows = versions.enrich(telemetry(spark, sf_dir), {"lag_ms": lag})
    return rows.select(
        "arrival",
        ms("received_at").alias("received_ms"),
        ms("device_time").alias("device_ms"),
        ms("vendor_received_at").alias("vendor_ms"),
        "lag_ms",
    )


@query(
    "versions_of_identity",
    "SELECT identity, version, adapter_version FROM versions WHERE identity = (SELECT max(identity) FROM versions)",
    source_queries.VERSION_SQL,
)
def versions_of_identity(spark, sf_dir):
    stored = source_queries.observation_versions(spark, sf_dir)
    newest = stored.agg(F.max("identity")).first()[0]
    return versions.versions_of(stored, newest).select("identity", "version", "adapter_version")


# ------------------------------------------------------------------ episodes


@query(
    "episode_openings",
    """SELECT episode_id, 1::BIGINT AS version, 'provisional' AS state, type, start_ms, CAST(NULL AS BIGINT) AS end_ms, 'opened' AS cause,
      'expected report did not arrive, missed ' || missed_reports AS reason, start_ms + 86400000 AS final_ms, clock_basis FROM episodes""",
    EPISODES_SQL,
)
def episode_openings(spark, sf_dir):
    """The first version of each sampled episode."""
    found = episodes.with_episode_id(episodes.sample_episodes(telemetry(spark, sf_dir), POLICY))
    opened = lifecycle.open_episodes(found, 86_400)
    return opened.select(
        "episode_id", "version", "state", "type", ms("start_at").alias("start_ms"), ms("end_at").alias("end_ms"), "cause",
        "reason", ms("finalisation_watermark_at").alias("final_ms"), "clock_basis",
    )


@query(
    "episode_upserts",
    """SELECT episode_id, CASE WHEN closed THEN 2 ELSE 1 END::BIGINT AS version, CASE WHEN closed THEN 'retracted' ELSE 'provisional' END AS state,
      CASE WHEN closed THEN 2 ELSE 1 END::BIGINT AS version_count FROM (SELECT episode_id, type = 'gnss_only_loss' AS closed FROM episodes)""",
    EPISODES_SQL,
)
def episode_upserts(spark, sf_dir):
    """Versions appended to a table and read again: the current row of each episode and the history behind it."""
    from quietwatch.streaming import tables

    found = episodes.with_episode_id(episodes.sample_episodes(telemetry(spark, sf_dir), POLICY))
    base = scratch_path(spark, "episode-versions")
    opened = lifecycle.open_episodes(found, 86_400)
    tables.put(opened, base, "versions", 0)
    stored = tables.read_table(spark, base, "versions").drop("epoch")
    asked = stored.filter(F.col("type") == "gnss_only_loss").select(
        "episode_id", F.lit("retracted").alias("to_state"), F.lit("late_data").alias("cause"), F.lit("system").alias("actor"),
        F.lit("a fix came late").alias("reason"), F.col("start_at").alias("at"),
    )
    nothing = spark.createDataFrame([], "episode_id string")
    changed = lifecycle.apply_transitions(lifecycle.current_versions(stored), asked, nothing, from_ms(F.lit(NOW_MS)))
    applied = changed.filter(F.col("status") == "applied").select(*lifecycle.VERSION_COLUMNS)
    tables.put(applied, base, "versions", 1)
    whole = tables.read_table(spark, base, "versions").drop("epoch")
    return lifecycle.current_versions(whole).select("episode_id", "version", "state", "version_count")


# ------------------------------------------------------------------ retention


@query(
    "retention_applied",
    """SELECT data_class, count(*) FILTER (reason IS NOT NULL) AS kept, count(*) FILTER (reason IS NULL) AS tombstones,
      0 AS deleted_again FROM plan GROUP BY data_class""",
    RETAINED_SQL,
)
def retention_applied(spark, sf_dir):
    """Due rows deleted from a partitioned table with a tombstone each; a second run deletes nothing."""
    items = retained_items(spark, sf_dir)
    now = from_ms(F.lit(NOW_MS))
    base = scratch_path(spark, "retained")
    items.write.partitionBy("data_class").parquet(f"{base}/items")
    plan = retention.plan_retention(items, holds(spark, sf_dir), now)
    plan.write.parquet(f"{base}/plan")
    plan = spark.read.parquet(f"{base}/plan")

    def apply(run: str) -> int:
        return retention.apply_retention(
            spark, plan, f"{base}/items", f"{base}/tombstones", f"{base}/staging-{run}", "data_class", run, now, "2024.1"
        )

    apply("first")
    again = apply("second")
    left = spark.read.schema(items.schema).parquet(f"{base}/items")
    kept = left.groupBy("data_class").agg(F.count(F.lit(1)).alias("kept"))
    marks = retention.read_tombstones(spark, f"{base}/tombstones").groupBy("data_class").agg(F.count_distinct("ref").alias("tombstones"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return kept.join(marks, "data_class", "full").select(
        "data_class", zero("kept"), zero("tombstones"), F.lit(again).alias("deleted_again")
    )


# ------------------------------------------------------------------ corridors


@query(
    "corridor_claims",
    "SELECT *, CASE WHEN status = 'corridor' THEN 'possible corridor' END AS claim FROM statuses",
    source_queries.CORRIDOR_SQL,
)
def corridor_claims(spark, sf_dir):
    return corridor.project_corridors(*source_queries.roads(spark, sf_dir))[0]
