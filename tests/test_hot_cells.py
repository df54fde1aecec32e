"""Distance joins where most pieces lie in one place, and refreshes that match new nodes through stored runs."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import components, matching, skew, spatial
from pathloom.operators.runindex import RunIndex
from pathloom.plans import network, refresh


def by_hand(points, pieces, reach):
    found = set()
    for i, x, y in points:
        for k, x1, y1, x2, y2 in pieces:
            dx, dy = x2 - x1, y2 - y1
            t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            if ((x1 + dx * t - x) ** 2 + (y1 + dy * t - y) ** 2) ** 0.5 <= reach:
                found.add((i, k))
    return found


@pytest.mark.parametrize("most", [0, 200_000])
def test_hot_cells_find_the_same_pairs(spark, monkeypatch, most):
    rnd = random.Random(2)
    points = [(i, rnd.uniform(-60, 60), rnd.uniform(-60, 60)) for i in range(60)] + [(100 + i, rnd.uniform(0, 8), rnd.uniform(0, 8)) for i in range(140)] + [(300 + i, rnd.uniform(41, 46), rnd.uniform(41, 46)) for i in range(20)]
    pieces = [(k, *(rnd.uniform(-80, 80) for _ in range(4))) for k in range(30)] + [(100 + k, 1.0, 1.0 + k / 100, 9.0, 2.0) for k in range(150)] + [(900, 3.0, 3.0, 3.0, 3.0)]
    p, q = spark.createDataFrame(points, "i long, x double, y double"), spark.createDataFrame(pieces, "k long, x1 double, y1 double, x2 double, y2 double")
    monkeypatch.setattr(spatial, "LEAF_PIECES", 20)
    monkeypatch.setattr(spatial, "CELL_PAIRS", 100)
    monkeypatch.setattr(spatial, "MAX_HOT", most)
    hot = spatial.hot_cells(p, q, 5.0).checkpoint()
    rows = hot.collect()
    assert {r["depth"] for r in rows} == {1, 2, 3} and max(r["salts"] for r in rows) > 5
    want = by_hand(points, pieces, 5.0)
    assert {tuple(r) for r in spatial.within(p, q, 5.0, hot=hot).select("i", "k").collect()} == want
    assert {tuple(r) for r in spatial.within(p, q, 5.0).select("i", "k").collect()} == want


def test_a_street_of_most_runs_is_no_one_tasks(spark, monkeypatch):
    runs = spark.range(100_000).select(F.col("id").alias("run"), F.timestamp_seconds(1_700_000_000 - F.col("id")).alias("start_at"), F.lit(0.0).alias("x1"), (F.col("id") % 7 / 10).alias("y1"), F.lit(40.0).alias("x2"), F.lit(0.5).alias("y2"))
    nodes = spark.createDataFrame([(1, 0, k, 10.0 * k, 0.0, 10.0) for k in range(5)] + [(2, 0, k, 10.0 * k, 5000.0, 10.0) for k in range(5)], "segment_id long, part int, seq long, x double, y double, radius double")
    monkeypatch.setattr(spatial, "LEAF_PIECES", 5_000)
    hot = spatial.hot_cells(nodes, runs, 10.0).checkpoint()
    assert hot.count() and hot.agg(F.min("salts")).first()[0] >= 20
    met = spatial.within(nodes, runs, 10.0, hot=hot)
    assert met.count() > 400_000
    segments = spark.createDataFrame([(1, "road", "Path", True, False), (2, "road", "Path", True, False)], "id long, layer string, seg_type string, counted boolean, excluded boolean")
    found = {(r["segment_id"], r["seq"]): r["hit_run"] for r in matching.match(nodes, segments, runs, 10.0).collect()}
    assert found == {(s, k): 99_999 if s == 1 else None for s in (1, 2) for k in range(5)}


ROADS = "key string, oid long, name string, seg_type string, counted boolean, uncounted_reason string, geom array<array<struct<x:double,y:double>>>"


def roads(spark, rows):
    return spark.createDataFrame([(str(k), k, name, "Residential", True, None, [[(0.0, float(y)), (float(m), float(y))]]) for k, name, y, m in rows], ROADS)


def test_refresh_matches_what_changed_and_applies_exclusions(spark, tmp_path):
    settings = network.Settings(graph=network.graph.GraphSettings())
    runs = spark.createDataFrame([(r, dt.datetime(2024, 1, r), -20.0, float(y), 400.0, float(y)) for r, y in ((1, 0), (2, 100), (3, 0), (4, 9000))], "run long, start_at timestamp, x1 double, y1 double, x2 double, y2 double")
    index = RunIndex(spark, f"{tmp_path}/runs", settings.reach, 256.0)
    assert index.near(runs.select(F.col("x1").alias("x"), F.col("y1").alias("y"))).count() == 0
    index.append(runs.where("run < 3"), "a")
    index.append(runs.where("run >= 3"), "b")
    index.append(runs, "b")  # again: stays as it is
    sig = lambda n, at: spark.createDataFrame([("road", n, at)], "layer string, feature_count long, max_oid long").withColumn("max_edited_at", F.lit(None).cast("timestamp"))
    empty = network.import_layer(roads(spark, [(9, "Z", 0, 50)]), None, "road", settings).segments.limit(0)
    nodes = network.make_nodes(empty, settings).withColumns({"hit_at": F.lit(None).cast("timestamp"), "hit_run": F.lit(None).cast("long")})
    state = refresh.State(empty, nodes, *network.build_graph(empty, settings.graph))
    none = spark.createDataFrame([], "layer string, name string, reason string")
    gated = refresh.Exclusions(spark.createDataFrame([("road", "2", "B St", "gated"), ("road", "77", None, "gone")], "layer string, key string, name string, reason string"), none)
    one = refresh.refresh(sig(3, 1), sig(3, 0), lambda layer: roads(spark, [(1, "A St", 0, 100), (2, "B St", 100, 100), (3, "C St", 500, 60)]), state, settings, runs=index, exclusions=gated)
    rows = {r["source_oid"]: r for r in one.state.segments.collect()}
    assert {k: (r["excluded"], r["exclusion_reason"]) for k, r in rows.items()} == {1: (False, None), 2: (True, "gated"), 3: (False, None)}
    hit = lambda made: {(r["source_oid"], r["seq"]): r["hit_run"] for r in made.state.nodes.join(made.state.segments.select(F.col("id").alias("segment_id"), "source_oid"), "segment_id").collect()}
    assert hit(one) == {**{(1, k): 1 for k in range(6)}, **{(2, k): 2 for k in range(6)}, **{(3, k): None for k in range(4)}}

    two = refresh.refresh(sig(3, 2), sig(3, 1), lambda layer: roads(spark, [(1, "A St", 0, 101), (2, "B St", 100, 100), (4, "A St", 0, 101)]), one.state, settings, runs=index, exclusions=gated)
    assert hit(two) == {**{(1, k): 1 for k in range(7)}, **{(2, k): 2 for k in range(6)}}
    said = [r["line"] for r in two.report.orderBy("place").collect()]
    assert said[0] == "cart paths: unchanged; roads: 0 added, 1 changed, 1 removed"
    assert "  stored 2, counted 1 (0.06 mi), excluded 1, nodes 13" in said and "  duplicates 1: 4 of 1" in said
    assert "  warning: orphan exclusion 77" in said
    assert "  road miles covered: 0.06 of 0.10 -> 0.06 of 0.06 mi" in said
    assert {r["dropped_key"]: r["canonical_key"] for r in two.state.copies.collect()} == {"4": "1"}

    kept = refresh.refresh(sig(2, 3), sig(3, 2), lambda layer: roads(spark, [(1, "A St", 0, 101), (2, "B St", 100, 100)]), two.state, settings, runs=index)
    assert {r["source_oid"]: r["excluded"] for r in kept.state.segments.collect()} == {1: False, 2: True}  # none given: as it was
    freed = refresh.refresh(sig(2, 4), sig(2, 3), lambda layer: roads(spark, [(1, "A St", 0, 101), (2, "B St", 100, 100)]), kept.state, settings, runs=index, exclusions=refresh.Exclusions(gated.by_key.limit(0), none))
    assert not freed.state.segments.where("excluded").count()


def test_index_reads_only_the_blocks_of_its_nodes(spark, tmp_path, monkeypatch):
    runs = spark.createDataFrame([(r, dt.datetime(2024, 1, 1), 1000.0 * r, 0.0, 1000.0 * r + 50, 0.0) for r in range(20)], "run long, start_at timestamp, x1 double, y1 double, x2 double, y2 double")
    index = RunIndex(spark, f"{tmp_path}/runs", 20.0, 500.0)
    index.append(runs, "a")
    points = spark.createDataFrame([(3010.0, 5.0), (7040.0, -5.0)], "x double, y double")
    near = index.near(points)
    assert {r["run"] for r in near.collect()} == {3, 7}
    assert "PartitionFilters: [block" in near._jdf.queryExecution().toString() or "PartitionFilters: [isnotnull(block" in near._jdf.queryExecution().toString()
    monkeypatch.setattr("pathloom.operators.runindex.MAX_BLOCKS", 1)
    assert {r["run"] for r in index.near(points).collect()} == {3, 7}


@pytest.mark.parametrize("heavy", [0, 100_000])
def test_components_with_hubs(spark, monkeypatch, heavy):
    monkeypatch.setattr("pathloom.operators.skew.MAX_HEAVY", heavy)
    rnd = random.Random(8)
    rows = [(0, k) for k in range(1, 400)] + [(k, k + 1) for k in range(1000, 1060)] + [(rnd.randint(2000, 2400), rnd.randint(2000, 2400)) for _ in range(150)] + [(7, None), (3000, 3000), (1060, 5)]
    links = spark.createDataFrame(rows, "src long, dst long").repartition(6)
    got = dict(map(tuple, components.connected_components(links, hub=20).collect()))
    assert got == dict(map(tuple, components.connected_components(links).collect()))
    words = spark.createDataFrame([("b", "a"), ("c", "b"), ("z", "y")], "src string, dst string")
    assert dict(map(tuple, components.connected_components(words, hub=1).collect())) == {"a": "a", "b": "a", "c": "a", "y": "y", "z": "y"}


def test_a_key_of_most_rows_stays_where_it_is(spark):
    rows = spark.range(50_000).select(F.when(F.col("id") < 40_000, 1).otherwise(F.col("id")).alias("k"), "id")
    table = rows.groupBy("k").agg(F.count("*").alias("n"), F.min("id").alias("least")).checkpoint()
    joined = skew.join_by_key(rows, table, ["k"], 1000)
    assert joined.count() == 50_000 and joined.where("k = 1").agg(F.max("least")).first()[0] == 0
    assert "BroadcastHashJoin" in joined._jdf.queryExecution().executedPlan().toString() or "Broadcast" in joined._jdf.queryExecution().toString()
