"""Corridor reachability for many episodes at once, and recurring-corridor baselines."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietwatch.functions.scalars import (
    exceeds,
    great_circle_m,
    ratio,
    round_half_up,
    wilson_lower,
)
from quietwatch.session import checkpoint_dir, scratch_path

CLAIM = "possible corridor"
MAX_CELL_RESOLUTION = 6
EARTH_M = 6_371_000.0

# Relative slack that keeps a node of a shortest path in spite of rounding; it only adds candidates.
_SLACK = 1e-9


def passable_edges(edges: DataFrame, profile: str = "motorcycle") -> DataFrame:
    """Directed edges a vehicle class may use: ``node``, ``next_node``, ``length_m``.

    ``edges``: from_node, to_node, length_m, motorcycle_access, car_access, one_way, road_name.
    """
    open_ = edges.filter(F.col("motorcycle_access" if profile == "motorcycle" else "car_access"))
    there = open_.select(
        F.col("from_node").alias("node"), F.col("to_node").alias("next_node"), "length_m"
    )
    back = open_.filter(~F.col("one_way")).select(
        F.col("to_node").alias("node"), F.col("from_node").alias("next_node"), "length_m"
    )
    # Only the shortest of parallel edges can lie on a shortest path.
    return there.unionByName(back).groupBy("node", "next_node").agg(F.min("length_m").alias("length_m"))


def _shorten(
    start: DataFrame,
    edges: DataFrame,
    keys: Sequence[str],
    admit,
    settled=None,
) -> DataFrame:
    """Rounds of frontier relaxation for all keys together, until no distance improves.

    ``start``: keys, node, dist.  ``admit`` filters candidate rows (budget, removed cells).
    ``settled`` drops frontier rows whose key needs no more work.  A round writes the distances it
    improves and nothing else, so what is written follows the nodes reached and not the rounds; of the
    distances written before, it reads again those of the nodes it makes an offer to.  Each round lies in
    the shared folder, so a lost executor repeats one round at most.  The joins of a round are merges: a
    broadcast would send a table that grows with the requests through the driver in every round.
    """
    spark = start.sparkSession
    columns, place = [*keys, "node", "dist"], [*keys, "node"]
    base, first = scratch_path(spark, "distances"), start.select(*columns)

    def keep(rows: DataFrame, number: int) -> DataFrame:
        path = f"{base}/round={number}"
        rows.write.parquet(path)
        return spark.read.schema(first.schema).parquet(path)

    def written() -> DataFrame:
        return spark.read.schema(first.schema).parquet(base).select(*columns)

    frontier, number = keep(first, 0), 0
    while True:
        offers = (
            frontier.join(edges.hint("merge"), "node")
            .select(*keys, F.col("next_node").alias("node"), (F.col("dist") + F.col("length_m")).alias("dist"))
        )
        offers = admit(offers).groupBy(*place).agg(F.min("dist").alias("dist"))
        held = (
            written()
            .join(offers.select(*place).hint("merge"), place, "left_semi")
            .groupBy(*place)
            .agg(F.min("dist").alias("_held"))
        )
        better = (
            offers.join(held.hint("merge"), place, "left")
            .filter(F.col("_held").isNull() | (F.col("dist") < F.col("_held")))
            .select(*columns)
        )
        number += 1
        frontier = keep(better, number)
        if frontier.isEmpty():
            return written().groupBy(*place).agg(F.min("dist").alias("dist")).checkpoint()
        if settled is not None:
            frontier = settled(frontier, written())


def feasible_nodes(requests: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes on some path that fits the budget, with distance from the start and to the goal.

    ``requests``: request_id, from_node, to_node, budget_m.  ``edges`` from ``passable_edges``.
    """
    budget = requests.select("request_id", "budget_m")

    def within(rows: DataFrame) -> DataFrame:
        return rows.join(budget.hint("merge"), "request_id").filter(F.col("dist") <= F.col("budget_m"))

    zero = F.lit(0.0).alias("dist")
    out = _shorten(
        requests.select("request_id", F.col("from_node").alias("node"), zero),
        edges,
        ["request_id"],
        within,
    )
    reverse = edges.select(
        F.col("next_node").alias("node"), F.col("node").alias("next_node"), "length_m"
    )
    # Only nodes already reached from the start can be feasible, so the second search stays inside.
    reached = out.withColumnRenamed("dist", "from_start")

    def inside(rows: DataFrame) -> DataFrame:
        return within(rows.join(reached.hint("merge"), ["request_id", "node"])).filter(
            F.col("dist") + F.col("from_start") <= F.col("budget_m")
        )

    home = _shorten(
        requests.select("request_id", F.col("to_node").alias("node"), zero)
        .join(reached.select("request_id", "node"), ["request_id", "node"], "left_semi"),
        reverse,
        ["request_id"],
        inside,
    )
    return (
        home.withColumnRenamed("dist", "to_goal")
        .join(reached, ["request_id", "node"])
        .join(budget, "request_id")
        .filter(F.col("from_start") + F.col("to_goal") <= F.col("budget_m"))
    )


def unavoidable_cells(
    requests: DataFrame, edges: DataFrame, nodes: DataFrame, feasible: DataFrame
) -> DataFrame:
    """Interior cells every path within budget must cross: ``request_id``, ``cell``.

    A cell off some shortest path is avoided by that path, so only cells that hold a node of a
    shortest path are tried.  Each trial searches again without the cell, inside the feasible
    nodes and pruned by the known distance to the goal, and stops once the goal is reached.
    """
    placed = feasible.join(nodes.select(F.col("node_id").alias("node"), "cell"), "node").checkpoint()
    shortest = placed.groupBy("request_id").agg(
        F.min(F.col("from_start") + F.col("to_goal")).alias("_shortest")
    )
    cell_of = nodes.select("node_id", "cell")
    ends = requests.select("request_id", F.explode(F.array("from_node", "to_node")).alias("node_id")).join(
        cell_of, "node_id"
    ).select("request_id", "cell")
    trials = (
        placed.join(shortest, "request_id")
        .filter(
            F.col("from_start") + F.col("to_goal") <= F.col("_shortest") * (1 + _SLACK)
        )
        .select("request_id", "cell")
        .distinct()
        .join(ends, ["request_id", "cell"], "left_anti")
        .checkpoint()
    )
    keys = ["request_id", "cell"]
    goals = requests.select("request_id", F.col("to_node").alias("node"))
    bound = placed.select("request_id", "node", "to_goal", "budget_m", F.col("cell").alias("_at_cell"))

    def admit(rows: DataFrame) -> DataFrame:
        return (
            rows.join(bound.hint("merge"), ["request_id", "node"])
            .filter(F.col("_at_cell") != F.col("cell"))
            .filter(F.col("dist") + F.col("to_goal") <= F.col("budget_m"))
        )

    def unfinished(frontier: DataFrame, known: DataFrame) -> DataFrame:
        done = known.join(goals.hint("merge"), ["request_id", "node"], "left_semi").select(*keys)
        return frontier.join(done.hint("merge"), keys, "left_anti")

    start = trials.join(
        requests.select("request_id", F.col("from_node").alias("node")), "request_id"
    ).withColumn("dist", F.lit(0.0))
    found = _shorten(start, edges, keys, admit, unfinished)
    avoided = found.join(goals, ["request_id", "node"], "left_semi").select(*keys)
    return trials.join(avoided, keys, "left_anti")


def project_corridors(
    requests: DataFrame,
    nodes: DataFrame,
    edges: DataFrame,
    profile: str = "motorcycle",
    min_interior_cells: int = 1,
) -> tuple[DataFrame, DataFrame]:
    """Corridor status per request, and the cells of each corridor.

    ``requests``: request_id, from_node, to_node, elapsed_s, max_speed_kph.
    ``nodes``: node_id, cell.  A request with an end that is not among them is infeasible.  The second frame has request_id, cell, role, where role is
    ``feasible``, ``endpoint`` or ``unavoidable``.
    """
    asked = requests.withColumn(
        "budget_m", F.col("elapsed_s") * F.col("max_speed_kph") / F.lit(3.6)
    ).checkpoint()
    ways = passable_edges(edges, profile).checkpoint()
    known = nodes.select(F.col("node_id").alias("node"))
    feasible = feasible_nodes(asked, ways).join(known, "node", "left_semi").checkpoint()
    unavoidable = unavoidable_cells(asked, ways, nodes, feasible).checkpoint()

    ends_met = feasible.join(
        asked.select("request_id", "from_node", "to_node"), "request_id"
    ).groupBy("request_id").agg(
        F.count(F.lit(1)).alias("feasible_nodes"),
        F.bool_or(F.col("node") == F.col("from_node")).alias("_from"),
        F.bool_or(F.col("node") == F.col("to_node")).alias("_to"),
    )
    shared = unavoidable.groupBy("request_id").agg(F.count(F.lit(1)).alias("interior_cells"))
    status = (
        F.when(~F.coalesce(F.col("_from") & F.col("_to"), F.lit(False)), F.lit("infeasible"))
        .when(F.col("interior_cells") < min_interior_cells, F.lit("corridor_ambiguous"))
        .otherwise(F.lit("corridor"))
    )
    summary = (
        asked.join(ends_met, "request_id", "left")
        .join(shared, "request_id", "left")
        .withColumn("interior_cells", F.coalesce("interior_cells", F.lit(0)))
        .select(
            "request_id",
            status.alias("status"),
            F.when(status == "corridor", F.lit(CLAIM)).alias("claim"),
            round_half_up(F.col("budget_m")).cast("bigint").alias("budget_m"),
            F.coalesce("feasible_nodes", F.lit(0)).cast("bigint").alias("feasible_nodes"),
            F.col("interior_cells").cast("bigint").alias("interior_cells"),
        )
    )
    held = summary.filter(F.col("status") == "corridor").select("request_id")
    shown = summary.filter(F.col("status") != "infeasible").select("request_id")
    cell_of = nodes.select(F.col("node_id").alias("node"), "cell")
    region = (
        feasible.join(cell_of, "node")
        .select("request_id", "cell")
        .distinct()
        .join(shown, "request_id", "left_semi")
        .withColumn("role", F.lit("feasible"))
    )
    ends = (
        asked.join(held, "request_id", "left_semi")
        .select("request_id", F.explode(F.array("from_node", "to_node")).alias("node"))
        .join(cell_of, "node")
        .select("request_id", "cell")
        .distinct()
        .withColumn("role", F.lit("endpoint"))
    )
    inner = unavoidable.join(held, "request_id", "left_semi").withColumn("role", F.lit("unavoidable"))
    return summary, region.unionByName(ends).unionByName(inner)


def corridor_table(
    cells: DataFrame, feasible: DataFrame, nodes: DataFrame, edges: DataFrame
) -> DataFrame:
    """Road names per corridor cell, from edges that touch a feasible node in it."""
    corridor = cells.filter(F.col("role") != "feasible").select("request_id", "cell").distinct()
    named = edges.filter(F.col("road_name").isNotNull()).select(
        "road_name", F.explode(F.array("from_node", "to_node")).alias("node")
    )
    names = (
        feasible.select("request_id", "node")
        .join(nodes.select(F.col("node_id").alias("node"), "cell"), "node")
        .join(corridor, ["request_id", "cell"], "left_semi")
        .join(named.distinct(), "node")
        .groupBy("request_id", "cell")
        .agg(F.array_sort(F.collect_set("road_name")).alias("road_names"))
    )
    return corridor.join(names, ["request_id", "cell"], "left").withColumn(
        "road_names", F.coalesce("road_names", F.array().cast("array<string>"))
    )


def corridor_baseline(
    exposure: DataFrame, min_assets: int = 5, min_days: int = 3, fleet: DataFrame | None = None
) -> DataFrame:
    """Which cells recur above the fleet rate, with enough data behind the claim.

    ``exposure``: cell, asset_ref, day, traversals, device_hours, blackouts.  ``fleet`` is one row
    with the three totals; by default the totals of the exposure itself.
    """
    totals = [
        F.sum("traversals").alias("traversals"),
        F.sum("device_hours").alias("device_hours"),
        F.sum("blackouts").alias("blackouts"),
    ]
    if fleet is None:
        fleet = exposure.agg(*totals)
    base = fleet.select(
        ratio(F.col("blackouts"), F.col("traversals")).alias("fleet_rate_per_traversal"),
        ratio(F.col("blackouts"), F.col("device_hours")).alias("fleet_rate_per_device_hour"),
    )
    cells = exposure.groupBy("cell").agg(
        F.count_distinct("asset_ref").alias("distinct_assets"),
        F.count_distinct("day").alias("distinct_days"),
        *totals,
    )

    def above(trials: Column, fleet_rate: str) -> Column:
        bound = wilson_lower(F.col("blackouts"), trials)
        return F.col(fleet_rate).isNotNull() & F.coalesce(
            exceeds(bound, F.col(fleet_rate)), F.lit(False)
        )

    by_traversals = (F.col("traversals") > 0) & above(F.col("traversals"), "fleet_rate_per_traversal")
    by_hours = (F.col("device_hours") > 0) & above(
        round_half_up(F.col("device_hours")), "fleet_rate_per_device_hour"
    )
    floor_met = (F.col("distinct_assets") >= min_assets) & (F.col("distinct_days") >= min_days)
    return cells.join(base).select(
        "cell",
        "distinct_assets",
        "distinct_days",
        floor_met.alias("count_floor_met"),
        ratio(F.col("blackouts"), F.col("traversals")).alias("rate_per_traversal"),
        ratio(F.col("blackouts"), F.col("device_hours")).alias("rate_per_device_hour"),
        "fleet_rate_per_traversal",
        "fleet_rate_per_device_hour",
        by_traversals.alias("above_by_traversals"),
        by_hours.alias("above_by_device_hours"),
        (by_traversals != by_hours).alias("denominators_disagree"),
        (floor_met & by_traversals & by_hours).alias("qualified"),
    )


def segment_key(coordinates: Column) -> Column:
    """Stable key of a road segment from its ``lon, lat`` points rounded to six decimals."""
    points = F.transform(
        coordinates, lambda p: F.format_string("%.6f,%.6f", p["lon"], p["lat"])
    )
    return F.concat(F.lit("seg_"), F.substring(F.sha2(F.array_join(points, ";"), 256), 1, 24))


def coarsen(cell_resolution: Column) -> Column:
    """A published cell is never finer than the allowed resolution."""
    return F.least(cell_resolution, F.lit(MAX_CELL_RESOLUTION))


def nearest_node(points: DataFrame, nodes: DataFrame, degrees: float = 0.01) -> DataFrame:
    """Nearest node of each point: ``point_id``, ``node_id``, ``distance_m``; ties take the lower id.

    Points look at their own and the eight neighbouring grid cells; longitude cells divide the full circle and wrap.
    An answer farther away than one cell could be beaten from outside, so those points try again on a grid twice as
    coarse.
    """
    checkpoint_dir(points.sparkSession)
    waiting = points.select("point_id", "lat", "lon")
    settled: DataFrame | None = None
    while True:
        whole_globe = degrees >= 360
        turns = max(1, int(360 // degrees))
        row = F.floor(F.col("lat") / F.lit(degrees))
        place = F.floor(F.col("lon") * F.lit(turns / 360.0))

        def wrapped(cell: Column) -> Column:
            return F.pmod(cell, F.lit(turns).cast("bigint"))

        near = F.array(F.lit(-1), F.lit(0), F.lit(1))
        sides = F.array_distinct(F.transform(near, lambda d: wrapped(place + d)))
        around = (
            waiting.withColumn("_cy", F.explode(sides))
            .withColumn("_dx", F.explode(near))
            .withColumn("_cx", row + F.col("_dx"))
            .drop("_dx")
        )
        gridded = nodes.select(
            "node_id",
            F.col("lat").alias("_nlat"),
            F.col("lon").alias("_nlon"),
            row.alias("_cx"),
            wrapped(place).alias("_cy"),
        )
        distance = great_circle_m(F.col("lat"), F.col("lon"), F.col("_nlat"), F.col("_nlon"))
        best = (
            around.join(gridded, ["_cx", "_cy"])
            .groupBy("point_id", "lat", "lon")
            .agg(F.min(F.struct(distance.alias("distance_m"), "node_id")).alias("_best"))
            .checkpoint()
        )
        # what lies outside is a cell away in latitude, or beyond a meridian that is a cell away
        reach = F.lit(math.radians(degrees) * EARTH_M)
        if turns > 3:
            across = F.cos(F.radians(F.col("lat"))) * F.lit(math.sin(math.radians(min(degrees, 90.0))))
            reach = F.least(reach, F.asin(across) * F.lit(EARTH_M))
        reach = reach * F.lit(1 - _SLACK)
        sure = F.lit(True) if whole_globe else F.col("_best.distance_m") < reach
        done = best.filter(sure).select("point_id", "_best.node_id", "_best.distance_m")
        settled = done if settled is None else settled.unionByName(done)
        waiting = waiting.join(done, "point_id", "left_anti").checkpoint()
        if whole_globe or waiting.isEmpty():
            return settled
        degrees *= 2
