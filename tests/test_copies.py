"""Copies: networks and tracks that repeat the same places are as much work as one of each, and every copy gets its rows."""

from __future__ import annotations

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from pathloom import queries as core
from pathloom.catalog.network import grid
from pathloom.operators import graph, health, spatial, tracks
from tests.test_oracles import compare, database

#: Keys after which the suppliers' lines, and all that is told by them, repeat.
AGAIN = 3600 * 7 * 17 * 29


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    """The small tables, and the same three times with shifted keys."""
    con, made = duckdb.connect(), []
    for n in (1, 3):
        d = tmp_path_factory.mktemp(f"copies{n}")
        con.execute(f"COPY (SELECT s.* REPLACE (s_suppkey + {AGAIN} * i AS s_suppkey) FROM '/root/testdata/sf0.01/supplier.parquet' s, range({n}) r(i)) TO '{d}/supplier.parquet'")
        con.execute(f"COPY (SELECT e.* REPLACE (event_id + 1000000 * i AS event_id, user_id + 1000000 * i AS user_id) FROM '/root/testdata/sf0.001/events.parquet' e, range({n}) r(i)) TO '{d}/events.parquet'")
        made.append(str(d))
    return made


def met_rows(monkeypatch, run, names=("within",)):
    """The most rows that a join by cells was given on either side while ``run`` ran."""
    most = [0, 0]
    for name in names:
        real = getattr(spatial, name)

        def spy(points, pieces, *args, _real=real, **more):
            most[:] = [max(most[0], points.count()), max(most[1], pieces.count())]
            return _real(points, pieces, *args, **more)

        monkeypatch.setattr(spatial, name, spy)
    run()
    monkeypatch.undo()
    return most


def as_much_work(spark, monkeypatch, folders, name, sides=(0, 1)):
    one, three = [met_rows(monkeypatch, lambda d=d: compare(core.queries()[name](spark, d), database(d), core.oracle_sql()[name])) for d in folders]
    assert one[0] > 0
    for side in sides:
        assert three[side] == one[side], (name, one, three)


def test_nearest_meets_each_place_and_line_once(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "j14_nearest")


def test_line_pairs_search_one_of_equal_lines(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "g9_line_distance")


def test_line_pairs_of_copies_within_their_names(spark):
    at = lambda i, name, y: (i, 0, 0, name, 0.0, y, 10.0, y, 0.0, 10.0)
    rows = [at(1, "a", 0.0), at(2, "a", 0.0), at(3, "a", 2.0), at(4, "b", 0.0), at(5, "b", 0.0), at(6, "a", 50.0)]
    pieces = spark.createDataFrame(rows, "id long, part int, k int, name string, x1 double, y1 double, x2 double, y2 double, from_m double, len double")
    got = {tuple(r) for r in spatial.line_pairs(pieces, 4.0, "id", ("name",)).collect()}
    assert got == {(1, 2, 0.0), (1, 3, 2.0), (2, 3, 2.0), (4, 5, 0.0)}


def test_nearest_k_leaves_out_what_copies_of_a_line_hide(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "g19_nearest_k", sides=(0,))
    p = spark.createDataFrame([(i, 0.0, 0.0) for i in range(5)], "p long, x double, y double")
    q = spark.createDataFrame([(i, 1.0, 0.0, 2.0, 0.0) for i in range(9)], "id long, x1 double, y1 double, x2 double, y2 double")
    found = []
    assert met_rows(monkeypatch, lambda: found.extend(spatial.nearest_k(p, q, ["p"], ["id"], ["id"], 3).select("p", "rank", "id").collect())) == [1, 3]
    assert {tuple(r) for r in found} == {(i, k + 1, k) for i in range(5) for k in range(3)}


def test_locate_meets_each_place_and_line_once(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "g8_locate")


def test_crossings_of_keys_beyond_the_shift(spark, tmp_path):
    duckdb.connect().execute(f"COPY (SELECT s.* REPLACE (s_suppkey + 100000 * i AS s_suppkey) FROM '/root/testdata/sf0.001/supplier.parquet' s, range(3) r(i)) TO '{tmp_path}/supplier.parquet'")
    compare(core.queries()["j12_crossings"](spark, str(tmp_path)), database(tmp_path), core.oracle_sql()["j12_crossings"])


def test_fixes_within_meet_each_place_once(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "j5_within")


def test_share_meets_each_sample_once(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "u3_share_within")


@pytest.mark.parametrize("name", ["x1_late_runs", "m7_tunnels"])
def test_hits_meet_each_node_place_once(spark, monkeypatch, folders, name):
    as_much_work(spark, monkeypatch, folders, name, sides=(0,))


def test_near_misses_meet_each_place_once(spark, monkeypatch, folders):
    as_much_work(spark, monkeypatch, folders, "m12_near_misses", sides=(0,))


def test_a_sum_of_steps_adds_no_piece(spark):
    """25 m of steps that sum to a little more are one piece of 25 m."""
    x = next(k / 100 for k in range(1, 5000) if (k + 2500) / 100 - k / 100 > 25.0)
    points = spark.createDataFrame([(1, 0, 1, x, 0.0), (1, 0, 2, round(x + 25.0, 2), 0.0)], "track long, part int, seq int, x double, y double")
    assert [r["piece"] for r in tracks.track_pieces(points, 25.0).collect()] == [0]


@pytest.mark.parametrize("name", ["h5_refresh", "h5_state"])
def test_refresh_keeps_lines_that_keys_repeat(spark, tmp_path, name):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT s.* REPLACE (s_suppkey + 3600 * i AS s_suppkey) FROM '/root/testdata/sf0.001/supplier.parquet' s, range(3) r(i)) TO '{tmp_path}/supplier.parquet'")
    con.execute(f"COPY (SELECT * FROM '/root/testdata/sf0.001/events.parquet') TO '{tmp_path}/events.parquet'")
    compare(core.queries()[name](spark, str(tmp_path)), database(tmp_path), core.oracle_sql()[name])


def test_nearest_value_pairs_nothing(spark, small):
    """A cell's customers and suppliers are put in order, not joined."""
    assert "Join" not in core.queries()["j8_nearest_value"](spark, small)._jdf.queryExecution().executedPlan().toString()


def test_covering_jobs_are_put_in_order_not_paired(spark):
    """Many jobs of one hour and many instants: the one join left is by the instants' key."""
    draw = random.Random(5)
    jobs = [(i, a, a + draw.choice([0, 5, 60, 4000])) for i in range(400) for a in [draw.randint(0, 9000)]]
    asked = [(i, draw.randint(0, 20000)) for i in range(400)]
    j = spark.createDataFrame(jobs, "id long, a long, b long").selectExpr("id", "timestamp_seconds(a) as started_at", "timestamp_seconds(b) as finished_at")
    got = health.covering_job(spark.createDataFrame(asked, "k long, t long").selectExpr("k", "timestamp_seconds(t) as at"), j, "k", "at")
    want = {k: max(((a, i) for i, a, b in jobs if a <= t <= b), default=(None, None))[1] for k, t in asked}
    assert {r["k"]: r["job_id"] for r in got.collect()} == want and None in want.values()
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_end_cuts_make_few_rows_of_a_long_line(spark, small, monkeypatch):
    made = []

    def spy(points, pieces, reach, *args, cell=0.0, **more):
        made.append((spatial._steps(pieces, reach, max(spatial.BASE * reach, cell)).count(), pieces.count()))
        return spatial.within(points, pieces, reach, *args, cell=cell, **more)

    monkeypatch.setattr(graph, "within", spy)
    parts = graph.graph_parts(grid(spark, small))
    assert graph.t_cuts(parts, 3.0).count() > 0
    assert made[0][0] < 40 * made[0][1], made


@pytest.mark.parametrize("name", ["g8_locate", "j12_crossings", "g9_line_distance"])
def test_pairs_of_copies_are_made_last_and_in_many_tasks(spark, folders, name):
    """What was found for one of each line is joined with all that are the same by broadcast, so the rows made are not
    shuffled, however many lines there are, and tasks share them."""
    df = core.queries()[name](spark, folders[1])
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("rightHint=(strategy=broadcast)") >= 2 - (name == "g8_locate"), plan
    if name == "j12_crossings":
        assert df.select(F.spark_partition_id().alias("p")).distinct().count() > 1


def test_graph_cuts_one_of_equal_lines(spark, monkeypatch):
    """Lines three times over are cut, snapped and sampled once, and each copy gets the same edges; bent copies cut each other where they bend."""
    lines = [("road", [(0, 0), (100, 0)]), ("road", [(0, 40), (50, 40), (50, -40)]), ("cartpath", [(0, 5), (100, 5)]), ("road", [(30, 1), (30, -60)])]
    met, found = [], []

    def spy(points, pieces, *args, **more):
        met[-1].append((points.count(), pieces.count()))
        return spatial.within(points, pieces, *args, **more)

    monkeypatch.setattr(graph, "within", spy)
    for n in (2, 6):
        rows = [(i + 10 * c, layer, None, "x", [[{"x": float(x), "y": float(y)} for x, y in line]]) for c in range(n) for i, (layer, line) in enumerate(lines)]
        met.append([])
        edges, vertices = graph.build_graph(spark.createDataFrame(rows, "id long, layer string, seg_type string, name string, geom array<array<struct<x:double,y:double>>>"))
        got = [(r["id"], r["edge"], r["part_from"], r["part_to"], r["source"], r["target"], round(r["length_m"], 6), r["cost"] > r["length_m"]) for r in edges.collect()]
        assert [x[1] for x in sorted(got, key=lambda r: (r[0], r[2]))] == sorted(x[1] for x in got)
        found.append({i: sorted((a, b, *rest) for k, _, a, b, *rest in got if k == i) for i in {x[0] for x in got}})
        found[-1]["vertices"] = sorted((r["vertex"], round(r["x"], 6), round(r["y"], 6), r["component"]) for r in vertices.collect())
    assert met[0] == met[1]
    assert found[0]["vertices"] == found[1]["vertices"]
    assert all(found[1][i + 10 * c] == found[0][i] for c in range(6) for i in range(4))
    assert round(50 / 130, 6) in [x[0] for x in found[0][1]]  # the bend
