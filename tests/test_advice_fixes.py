"""Nearest nodes on the whole globe, requests with unknown ends and CSV headers of any width."""

import json

import numpy as np
from pyspark.sql import functions as F

from quietwatch.operators import corridor
from quietwatch.sources import readers


def test_nearest_node_on_the_whole_globe(spark):
    rng = np.random.default_rng(5)
    nodes = [(0, 0.0, -179.999), (1, 0.0, 179.5), (2, 89.97, 10.0), (3, 89.95, -150.0), (4, -89.99, 0.0), (5, 60.0, 180.0)]
    nodes += [(10 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 40), rng.uniform(-180, 180, 40)))]
    points = [(0, 0.0, 179.999), (1, 0.0, 179.6), (2, 89.96, -160.0), (3, 89.95, 100.0), (4, -90.0, 77.0), (5, 60.0, 179.0), (6, 60.0, -179.0)]
    points += [(10 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-90, 90, 80), rng.uniform(-180, 180, 80)))]
    points += [(100 + i, float(a), float(o)) for i, (a, o) in enumerate(zip(rng.uniform(-2, 2, 20), rng.uniform(178, 182, 20)))]
    points = [(i, a, o - 360 if o > 180 else o) for i, a, o in points]

    def away(p, q):
        a, b, c, d = np.radians([p[1], q[1], p[2], q[2]])
        h = np.sin((b - a) / 2) ** 2 + np.cos(a) * np.cos(b) * np.sin((d - c) / 2) ** 2
        return 12742000.0 * np.arcsin(min(1, np.sqrt(h)))

    p = spark.createDataFrame(points, "point_id long, lat double, lon double")
    n = spark.createDataFrame(nodes, "node_id long, lat double, lon double")
    want = {x[0]: min((round(float(away(x, y)), 3), y[0]) for y in nodes) for x in points}
    for degrees in (1.0, 50.0):
        got = {r.point_id: (round(r.distance_m, 3), r.node_id) for r in corridor.nearest_node(p, n, degrees).collect()}
        assert got == want
    assert want[0][1] == 0


def test_requests_with_unknown_ends_are_infeasible(spark):
    edges = spark.createDataFrame(
        [(i, i + 1, 100.0, True, True, False, None) for i in range(1, 6)],
        "from_node long, to_node long, length_m double, motorcycle_access boolean, car_access boolean, one_way boolean, road_name string",
    )
    nodes = spark.createDataFrame([(i, i // 2) for i in range(1, 6)], "node_id long, cell long")  # 6 is not placed
    asked = [(1, 1, 5, 60.0, 36.0), (2, 1, 6, 60.0, 36.0), (3, 1, 99, 60.0, 36.0), (4, 6, 1, 60.0, 36.0)]
    requests = spark.createDataFrame(asked, "request_id long, from_node long, to_node long, elapsed_s double, max_speed_kph double")
    status, cells = corridor.project_corridors(requests, nodes, edges)
    assert {r.request_id: r.status for r in status.collect()} == {1: "corridor", 2: "infeasible", 3: "infeasible", 4: "infeasible"}
    assert {r.request_id for r in cells.collect()} == {1}


def test_csv_headers_of_any_width(spark, tmp_path):
    names = [f"n{i}" for i in range(600)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(600))) + "\n1,2\n")
    (tmp_path / "blank.csv").write_text('a,,"c,d",\n1,2,3,4\n5,6,,\n1,2,3\n')
    rows = readers.read_csv(spark, [str(tmp_path / "wide.csv")]).select(F.to_json("raw").alias("j"), "parse_error").collect()
    assert [r.parse_error for r in rows] == [None, "MALFORMED_CSV_ROW"]
    assert json.loads(rows[0].j) == {n: str(i) for i, n in enumerate(names)}
    rows = readers.read_csv(spark, [str(tmp_path / "blank.csv")]).select(F.to_json("raw").alias("j"), "parse_error").collect()
    assert [r.parse_error for r in rows] == [None, None, "MALFORMED_CSV_ROW"]
    assert [json.loads(r.j) for r in rows[:2]] == [{"a": "1", "": "4", "c,d": "3"}, {"a": "5", "": "6"}]
