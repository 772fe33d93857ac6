"""Peer correlation: bursts of episodes that share a source, provider, network or area."""

from __future__ import annotations

import bisect

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quietwatch.functions.ordered import prefix_states
from quietwatch.functions.scalars import from_ms, ms, ratio

DEFAULT_MINIMUM = 3
DEFAULT_WINDOW_S = 1800

# A block spans several windows, so it holds few anchors and its effect on later blocks is short.
WINDOWS_PER_BLOCK = 8

# Distinct starts up to which the burst of one key may be one row that folds in one task.
PIECE_ROWS = 20_000


def network_identity(mcc: Column, mnc: Column) -> Column:
    return F.concat(mcc.cast("string"), F.lit("-"), F.lpad(mnc.cast("string"), 2, "0"))


def dimension_keys(candidates: DataFrame) -> DataFrame:
    """One row per candidate and correlation dimension; NULL keys correlate with nothing.

    ``candidates``: tenant_id, episode_id, device_ref, asset_ref, source, sim_provider,
    network_identity, cell, start_at.
    """
    pairs = F.explode(
        F.array(
            *[
                F.struct(F.lit(name).alias("dimension"), F.col(column).alias("key"))
                for name, column in (
                    ("source", "source"),
                    ("sim_provider", "sim_provider"),
                    ("network", "network_identity"),
                    ("area", "cell"),
                )
            ]
        )
    ).alias("_d")
    return (
        candidates.select(
            "tenant_id", "episode_id", "device_ref", "asset_ref", ms("start_at").alias("start_ms"), pairs
        )
        .filter(F.col("_d.key").isNotNull())
        .select("*", "_d.dimension", "_d.key")
        .drop("_d")
    )


_KEYS = ["tenant_id", "dimension", "key"]


def _block_effects(window: int, block: int):
    def effects(pdf: pd.DataFrame) -> pd.DataFrame:
        """Last anchor inside the block for every way of entering it, runs of equal ends merged."""
        starts = np.sort(pdf["start_ms"].to_numpy())
        begin = int(pdf["block"].iloc[0]) * block
        entries = np.arange(min(int(np.searchsorted(starts, begin + window)) + 1, starts.size))
        last = entries.copy()
        current = entries
        while True:
            following = np.searchsorted(starts, starts[current] + window, side="right")
            moving = following < starts.size
            if not moving.any():
                break
            current = np.where(moving, following, current)
            last = current
        ends = starts[last]
        final = np.append(ends[1:] != ends[:-1], True)
        head = pdf[[*_KEYS, "block"]].iloc[[0]].reset_index(drop=True)
        head["entry_until"] = [starts[entries][final].tolist()]
        head["last_anchor"] = [ends[final].tolist()]
        return head

    return effects


def _block_entries(window: int):
    def entries(pdf: pd.DataFrame) -> pd.DataFrame:
        """Walk the blocks of one key in order, carrying only the latest anchor."""
        pdf = pdf.sort_values("block")
        carried: list[int | None] = []
        anchor: int | None = None
        for until, last in zip(pdf["entry_until"], pdf["last_anchor"], strict=True):
            carried.append(anchor)
            at = 0 if anchor is None else bisect.bisect_right(list(until), anchor + window)
            if at < len(last):
                anchor = int(last[at])
        out = pdf[[*_KEYS, "block"]].copy()
        out["carried"] = pd.array(carried, dtype="Int64")
        return out

    return entries


def _block_anchors(window: int):
    def anchors(starts_pdf: pd.DataFrame, entry_pdf: pd.DataFrame) -> pd.DataFrame:
        starts = np.sort(starts_pdf["start_ms"].to_numpy())
        carried = entry_pdf["carried"].iloc[0]
        found: list[int] = []
        position = 0
        if not pd.isna(carried):
            found.append(int(carried))
            position = int(np.searchsorted(starts, int(carried) + window, side="right"))
        while position < starts.size:
            found.append(int(starts[position]))
            position = int(np.searchsorted(starts, starts[position] + window, side="right"))
        head = starts_pdf[[*_KEYS, "block"]].iloc[[0]].reset_index(drop=True)
        head["anchors"] = [found]
        return head

    return anchors


def _anchors_by_piece(starts: DataFrame, window: int) -> DataFrame:
    """Anchor of every distinct start of keys of ordinary size.

    A pause longer than the window always starts a new burst, so the pieces between such pauses are
    independent and each folds on its own.
    """
    w = Window.partitionBy(*_KEYS).orderBy("start_ms")
    pause = F.col("start_ms") - F.lag("start_ms").over(w) > window
    pieces = (
        starts.withColumn("_cut", F.coalesce(pause, F.lit(True)).cast("int"))
        .withColumn("_piece", F.sum("_cut").over(w))
        .groupBy(*_KEYS, "_piece")
        .agg(F.array_sort(F.collect_list("start_ms")).alias("_starts"))
    )

    def follow(anchor: Column, start: Column) -> Column:
        return F.when(start - anchor > window, start).otherwise(anchor)

    first = F.get("_starts", F.lit(0))
    before = prefix_states(F.col("_starts"), first, follow, kind="bigint")
    return pieces.select(
        *_KEYS,
        F.inline(
            F.zip_with(
                "_starts",
                before,
                lambda s, a: F.struct(s.alias("start_ms"), follow(a, s).alias("cluster_start_ms")),
            )
        ),
    )


def _anchors_by_block(starts: DataFrame, window: int) -> DataFrame:
    """Anchor of every distinct start of busy keys, one task per time block of a key.

    Each block reports, for every way a chain can enter it, the anchor it leaves with; chains merge
    quickly, so that report is short.  One small pass per key connects the blocks (its size is the
    number of blocks, not of starts), and every block then lists its own anchors.
    """
    block = window * WINDOWS_PER_BLOCK
    keys = "tenant_id string, dimension string, key string, block bigint"
    blocked = starts.withColumn("block", F.floor(F.col("start_ms") / block))
    effects = blocked.groupBy(*_KEYS, "block").applyInPandas(
        _block_effects(window, block),
        f"{keys}, entry_until array<bigint>, last_anchor array<bigint>",
    )
    entries = effects.groupBy(*_KEYS).applyInPandas(_block_entries(window), f"{keys}, carried bigint")
    anchors = (
        blocked.groupBy(*_KEYS, "block")
        .cogroup(entries.groupBy(*_KEYS, "block"))
        .applyInPandas(_block_anchors(window), f"{keys}, anchors array<bigint>")
    )
    anchor = F.array_max(F.filter("anchors", lambda a: a <= F.col("start_ms")))
    return blocked.join(anchors, [*_KEYS, "block"]).select(
        *_KEYS, "start_ms", anchor.alias("cluster_start_ms")
    )


def assign_clusters(
    members: DataFrame, window_s: int = DEFAULT_WINDOW_S, hot_rows: int = PIECE_ROWS
) -> DataFrame:
    """Add ``cluster_start_ms``: the first start of the burst a member belongs to.

    A burst spans at most the window from its *first* start, so the anchors of one key form a chain.
    Only distinct starts matter, and they are reduced before they move.  Keys with more than
    ``hot_rows`` distinct starts (one source can hold a third of all episodes) go through time
    blocks; their list is bounded by rows divided by ``hot_rows``, hence the broadcasts.
    """
    window = window_s * 1000
    starts = members.select(*_KEYS, "start_ms").distinct()
    busy = starts.groupBy(*_KEYS).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > hot_rows)
    if busy.isEmpty():
        anchored = _anchors_by_piece(starts, window)
    else:
        hot = F.broadcast(busy.select(*_KEYS))
        anchored = _anchors_by_piece(starts.join(hot, _KEYS, "left_anti"), window).unionByName(
            _anchors_by_block(starts.join(hot, _KEYS, "left_semi"), window)
        )
    return members.join(anchored, [*_KEYS, "start_ms"])


_CLUSTER = [*_KEYS, "cluster_start_ms"]


def _devices(assigned: DataFrame) -> DataFrame:
    """One row per cluster and device: its copies, and the witness it stands for."""
    return (
        assigned.groupBy(*_CLUSTER, "device_ref")
        .agg(
            F.count(F.lit(1)).alias("copies"),
            F.min_by(
                F.struct("asset_ref"), F.struct("start_ms", F.coalesce("asset_ref", F.lit("")))
            ).alias("_first"),
            F.max("start_ms").alias("last_start_ms"),
        )
        .withColumn("witness", F.coalesce("_first.asset_ref", "device_ref"))
        .drop("_first")
    )


def _witnesses(devices: DataFrame) -> DataFrame:
    return devices.groupBy(*_CLUSTER, "witness").agg(
        F.min("device_ref").alias("counted_as"),
        F.count(F.lit(1)).alias("devices"),
        F.sum("copies").alias("members"),
        F.max("last_start_ms").alias("last_start_ms"),
    )


def clusters(
    assigned: DataFrame,
    minimum: int = DEFAULT_MINIMUM,
    population: DataFrame | None = None,
) -> DataFrame:
    """One row per cluster with its independent witnesses, exclusions and denominator.

    Members collapse to devices and devices to assets in two partial aggregations, so a cluster of
    any size stays spread over tasks until only counts are left.
    ``population``: dimension, key, active_population.
    """
    found = (
        _witnesses(_devices(assigned))
        .groupBy(*_CLUSTER)
        .agg(
            F.max("last_start_ms").alias("window_end_ms"),
            F.sum("members").alias("member_rows"),
            F.sum("devices").alias("member_devices"),
            F.count(F.lit(1)).alias("independent_count"),
        )
        .withColumn("duplicate_devices", F.col("member_rows") - F.col("member_devices"))
        .withColumn("shared_assets", F.col("member_devices") - F.col("independent_count"))
        .withColumn("meets_minimum", F.col("independent_count") >= minimum)
    )
    if population is None:
        return found.withColumn(
            "active_population", F.lit(None).cast("bigint")
        ).withColumn("affected_fraction", F.lit(None).cast("double"))
    return found.join(population, ["dimension", "key"], "left").withColumn(
        "affected_fraction", ratio(F.col("independent_count"), F.col("active_population"))
    )


def exclusions(assigned: DataFrame) -> DataFrame:
    """Named exclusions: repeats of a device, and devices that share an asset with the witness."""
    devices = _devices(assigned)
    repeats = (
        devices.filter(F.col("copies") > 1)
        .withColumn("_n", F.explode(F.sequence(F.lit(2), F.col("copies").cast("int"))))
        .select(
            *_CLUSTER,
            "device_ref",
            F.lit("duplicate_device").alias("reason"),
            F.col("device_ref").alias("counted_as"),
        )
    )
    shared = (
        devices.join(_witnesses(devices).select(*_CLUSTER, "witness", "counted_as"), [*_CLUSTER, "witness"])
        .filter(F.col("device_ref") != F.col("counted_as"))
        .select(*_CLUSTER, "device_ref", F.lit("shares_asset").alias("reason"), "counted_as")
    )
    return repeats.unionByName(shared)


def correlate(
    candidates: DataFrame,
    minimum: int = DEFAULT_MINIMUM,
    window_s: int = DEFAULT_WINDOW_S,
    population: DataFrame | None = None,
) -> DataFrame:
    """Peer clusters; tenants are partitioned apart and never share a cluster."""
    return clusters(assign_clusters(dimension_keys(candidates), window_s), minimum, population)


def single_tenant(candidates: DataFrame, tenant_id: str) -> DataFrame:
    """Refuse input of more than one tenant instead of filtering it silently."""
    return candidates.withColumn(
        "tenant_id",
        F.when(F.col("tenant_id") == tenant_id, F.col("tenant_id")).otherwise(
            F.raise_error(F.lit("refusing to correlate across tenants"))
        ),
    )


def peer_facts(
    candidates: DataFrame, assigned: DataFrame, found: DataFrame
) -> DataFrame:
    """Per episode: witnesses on its source and network, and whether a source incident holds it.

    Each episode carries its cluster from assignment, so this is an equi-join.
    """
    per_episode = (
        assigned.filter(F.col("dimension").isin("source", "network"))
        .select("episode_id", *_CLUSTER)
        .join(found.select(*_CLUSTER, "independent_count", "meets_minimum"), _CLUSTER)
        .groupBy("episode_id")
        .agg(
            F.max(F.when(F.col("dimension") == "source", F.col("independent_count"))).alias("_source"),
            F.max(F.when(F.col("dimension") == "network", F.col("independent_count"))).alias("_network"),
            F.bool_or(
                (F.col("dimension") == "source") & F.col("meets_minimum")
            ).alias("_incident"),
        )
    )
    known = F.col("network_identity").isNotNull()
    return (
        candidates.select("episode_id", "network_identity")
        .join(per_episode, "episode_id", "left")
        .select(
            "episode_id",
            F.struct(
                F.coalesce("_source", F.lit(0)).alias("source_independent_devices"),
                F.when(known, F.coalesce("_network", F.lit(0))).alias("network_independent_devices"),
                known.alias("network_identity_known"),
                F.coalesce("_incident", F.lit(False)).alias("source_health_incident"),
            ).alias("peers"),
        )
    )


def burst_window(cluster_rows: DataFrame) -> DataFrame:
    return cluster_rows.withColumns(
        {"window_start": from_ms("cluster_start_ms"), "window_end": from_ms("window_end_ms")}
    )
