"""Hand-built geometry in metres, with results that can be worked out on paper."""

from __future__ import annotations

import datetime as dt
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from pathloom.functions import geometry as g
from pathloom.functions.projection import to_utm
from pathloom.operators import clean, coverage, cues, graph, health, matching, routing, spatial, tracks
from pathloom.plans import network as plans
from pathloom.sources import exports, features

SEGMENT = "id long, layer string, seg_type string, name string, counted boolean, excluded boolean, uncounted_reason string, source_oid long, geom array<array<struct<x:double,y:double>>>"
SETTINGS = plans.Settings(path_end=20.0, path=20.0, road=20.0, wide=30.0, divided=("DIVIDED RD",))


def segments(spark, *rows):
    """Rows (id, layer, parts, type, name, counted, excluded), the later ones optional."""
    full = []
    for r in rows:
        i, layer, parts, kind, name, counted, excluded = (*r, *(None, None, True, False)[len(r) - 3 :])
        full.append((i, layer, kind, name, counted, excluded, None, i, [[(float(x), float(y)) for x, y in p] for p in parts]))
    return spark.createDataFrame(full, SEGMENT).withColumn("length_m", g.feature_length(F.col("geom")))


def points(spark, runs):
    """Fixes of runs {id: [(x, y), ...]}, a fix every 10 m at most."""
    rows = []
    for run, line in runs.items():
        seq = 0
        for (x1, y1), (x2, y2) in zip(line, line[1:]):
            n = max(1, int(((x2 - x1) ** 2 + (y2 - y1) ** 2) ** 0.5 // 10))
            for k in range(n):
                rows.append((run, seq, x1 + (x2 - x1) * k / n, y1 + (y2 - y1) * k / n))
                seq += 1
        rows.append((run, seq, float(line[-1][0]), float(line[-1][1])))
    return spark.createDataFrame(rows, "track long, seq int, x double, y double")


def starts(spark, *ids):
    return spark.createDataFrame([(i, dt.datetime(2024, 1, i)) for i in ids], "track long, start_at timestamp")


def hits(spark, seg, runs):
    found = plans.recompute(seg, points(spark, runs), starts(spark, *runs), SETTINGS)
    return {(r["segment_id"], r["part"], r["seq"]): r["hit_run"] for r in found.collect()}


def test_nodes_at_even_steps(spark):
    seg = segments(spark, (1, "cartpath", [[(0, 0), (100, 0)]], "Path"), (2, "cartpath", [[(0, 0), (30, 0), (30, 35)], [(0, 0), (0.5, 0)], [(5, 5), (5, 25)]], "Path"))
    nodes = plans.make_nodes(seg, SETTINGS).orderBy("segment_id", "part", "seq").collect()
    assert [n["x"] for n in nodes if n["segment_id"] == 1] == pytest.approx([0, 20, 40, 60, 80, 100])
    bent = [(n["part"], n["x"], n["y"]) for n in nodes if n["segment_id"] == 2]
    assert [b[0] for b in bent] == [0] * 5 + [2] * 2  # the tiny part has none
    assert bent[2][1:] == pytest.approx((30, 2.5)) and bent[4][1:] == pytest.approx((30, 35))


@pytest.mark.parametrize(("line", "want"), [([0, 50, 150], [150.0]), ([0, 50, 150.5, 200], [50.0, 49.5]), ([0, 20, 150, 300, 320], [20.0, 20.0]), ([0, 0, 0], []), ([0, 200], [])])
def test_split_at_gaps(spark, line, want):
    fixes = spark.createDataFrame([(1, i, float(x), 0.0) for i, x in enumerate(line)], "track long, seq int, x double, y double")
    parts = g.pieces(tracks.split_track(fixes, 100.0), ("track", "part")).where("last").orderBy("part").collect()
    assert [p["part_m"] for p in parts] == pytest.approx(want) and [p["part"] for p in parts] == list(range(len(want)))


def test_classify_by_fixes(spark):
    box = spark.createDataFrame([(7, 0.0, 0.0, 1000.0, 1000.0), (5, 500.0, 0.0, 600.0, 100.0)], "network_id int, x_min double, y_min double, x_max double, y_max double")
    fixes = spark.createDataFrame([(1, 0, 10.0, 10.0), (1, 1, 20.0, 20.0), (2, 0, -5.0, 500.0), (2, 1, 1005.0, 500.0), (3, 0, 1.0, 1.0), (4, 0, 550.0, 50.0), (4, 1, 5000.0, 1.0)], "track long, seq int, x double, y double")
    found = tracks.classify(spark.range(1, 6).withColumnRenamed("id", "track"), fixes, tracks.box_corners(box).select("network_id", "corners")).collect()
    assert {r["track"]: (r["status"], r["network_id"]) for r in found} == {1: ("city", 7), 2: ("outside", None), 3: ("no_gps", None), 4: ("city", 5), 5: ("no_gps", None)}


def test_radius_is_inclusive_and_earliest_wins(spark):
    seg = segments(spark, (1, "cartpath", [[(0, 0), (100, 0)]], "Path"), (2, "road", [[(0, 500), (100, 500)]], "Residential"))
    assert set(hits(spark, seg, {3: [(0, 20), (100, 20)], 1: [(0, 520.01), (100, 520.01)]}).values()) == {3, None}
    both = hits(spark, seg, {9: [(0, 1), (100, 1)], 4: [(0, -1), (50, -1)]})
    assert [both[1, 0, k] for k in range(6)] == [4, 4, 4, 4, 9, 9]


def test_tunnel_rule(spark):
    tunnel, path = [[(0, 0), (100, 0)]], [[(0, 0), (100, 0)]]
    detour = [(0, 0), (0, 90), (100, 90), (100, 0)]
    for kind, want in (("Tunnel", [5] * 6), ("Path", [5, 5, None, None, 5, 5])):
        found = hits(spark, segments(spark, (1, "cartpath", tunnel if kind == "Tunnel" else path, kind)), {5: detour})
        assert [found[1, 0, k] for k in range(6)] == want
    mixed = hits(spark, segments(spark, (1, "cartpath", tunnel, "Tunnel")), {8: detour, 2: [(40, 30), (40, 0), (60, 0), (60, 30)]})
    assert [mixed[1, 0, k] for k in range(6)] == [8, 2, 2, 2, 2, 8]


def test_completion_and_coverage(spark):
    seg = segments(spark, (1, "cartpath", [[(0, 0), (40, 0)]], "Path"), (2, "cartpath", [[(0, 300), (40, 300)]], "Path"), (3, "cartpath", [[(0, 0), (40, 0)]], "Path", None, True, True), (4, "road", [[(0, 600), (100, 600)], [(0, 900), (40, 900)]], "Residential"))
    nodes = plans.recompute(seg, points(spark, {1: [(0, 0), (40, 0)], 2: [(0, 600), (40, 600)], 3: [(80, 600), (81, 600)], 6: [(0, 900), (40, 900)]}), starts(spark, 1, 2, 3, 6), SETTINGS).checkpoint()
    m = plans.completion(seg, nodes).first()
    assert (m["cartpath_complete"], m["cartpath_total"], m["cartpath_complete_m"], m["cartpath_total_m"], m["cartpath_pct"]) == (1, 2, 40, 80, 50)
    shown = coverage.coverage(seg, nodes).select("id", "state", "piece_m").collect()
    by = {(r["id"], r["state"]): 0.0 for r in shown}
    for r in shown:
        by[r["id"], r["state"]] += r["piece_m"]
    assert by[1, "complete"] == 40 and by[2, "not_run"] == pytest.approx(40) and by[3, "excluded"] == 40
    assert by[4, "run"] + by.get((4, "not_run"), 0) == pytest.approx(140) and m["road_covered_m"] == pytest.approx(by[4, "run"])
    assert matching.not_run(nodes, seg).where("segment_id = 2").count() == 2


def test_near_miss_buckets(spark):
    rows = [(i, "cartpath", [[(i * 1000, 0), (i * 1000 + 20, 0)]], "Path") for i in range(3)]
    seg = segments(spark, *rows)
    runs = {1: [(-5, 23), (25, 23)], 2: [(995, 50), (1025, 50)], 3: [(1995, 500), (2025, 500)]}
    nodes = plans.recompute(seg, points(spark, runs), starts(spark, 1, 2, 3), SETTINGS)
    got = matching.near_misses(nodes, seg, plans.runs_of(points(spark, runs), starts(spark, 1, 2, 3), SETTINGS), (10, 15, 20, 25, 60)).collect()
    assert {r["bucket"]: r["n"] for r in got} == {"<10 m": 0, "<15 m": 0, "<20 m": 0, "<25 m": 2, "<60 m": 2, "farther": 2}


FEATURE = "key string, oid long, name string, seg_type string, counted boolean, uncounted_reason string, geom array<array<struct<x:double,y:double>>>"


def layer(spark, *rows):
    return spark.createDataFrame([(k, o, n, "T", True, None, [[(float(x), float(y)) for x, y in p] for p in parts] if parts else None) for k, o, n, parts in rows], FEATURE)


def test_import_drops_copies_and_slivers_and_marks_changes(spark):
    first = layer(spark, ("a", 7, "A", [[(0, 0), (30, 40)]]), ("b", 22510, "A", [[(30, 40), (0, 0)]]), ("c", 3, "C", [[(0, 0), (5, 0)], [(9, 0), (9, 9)]]), ("d", 10900, "C", [[(9, 9), (9, 0)], [(5, 0), (0, 0)]]), ("e", 5, "E", [[(1, 0), (31, 40)]]), ("f", 6, "F", [[(0, 0), (0.34, 0)]]), ("g", 8, "G", None))
    got = plans.import_layer(first, None, "road")
    assert sorted((r["oid"], r["kept_oid"]) for r in got.duplicates.collect()) == [(10900, 3), (22510, 7)]
    assert [round(r["length_m"], 2) for r in got.slivers.collect()] == [0.34] and [r["oid"] for r in got.no_geometry.collect()] == [8]
    stored = got.segments.checkpoint()
    assert {r["source_key"]: r["length_m"] for r in stored.collect()}["a"] == 50
    again = plans.import_layer(layer(spark, ("a", 7, "A", [[(0, 0), (30, 41)]]), ("e", 5, "E", [[(31, 40), (1, 0)]]), ("h", 9, "H", [[(0, 0), (9, 9)]])), stored, "road")
    assert {r["key"]: r["change"] for r in again.changes.collect()} == {"a": "changed", "c": "removed", "e": "same", "h": "added"}
    ids = {r["source_key"]: r["id"] for r in stored.collect()}
    now = {r["source_key"]: (r["id"], r["city_change"]) for r in again.segments.collect()}
    assert now == {"a": (ids["a"], "changed"), "e": (ids["e"], None), "h": (max(ids.values()) + 1, "added")}
    for bad in (first.limit(0), first.unionByName(first)):
        with pytest.raises(RuntimeError):
            plans.import_layer(bad, None, "road")


def test_second_carriageways(spark):
    two = layer(spark, ("p", 10, "DIVIDED RD", [[(0, 0), (200, 0)]]), ("q", 11, "DIVIDED RD", [[(200, 15), (0, 15)]]), ("r", 12, "Other", [[(0, 5), (200, 5)]]))
    got = plans.import_layer(two, None, "road", SETTINGS)
    assert [r["key"] for r in got.twins.collect()] == ["q"]
    assert {r["source_key"]: r["counted"] for r in got.segments.collect()} == {"p": True, "q": False, "r": True}
    far = layer(spark, ("p", 10, "DIVIDED RD", [[(0, 0), (200, 0)]]), ("q", 11, "DIVIDED RD", [[(200, 45), (0, 45)]]))
    assert plans.import_layer(far, None, "road", SETTINGS).twins.count() == 0


CASES = [  # parts (layer, line, type), the edges' lengths, components
    ([("road", [(0, 0), (100, 0)], None), ("road", [(102.5, 0), (200, 0)], None)], [98.8, 101.2], 1),
    ([("road", [(0, 0), (100, 0)], None), ("road", [(103.5, 0), (200, 0)], None)], [96.5, 100.0], 2),
    ([("road", [(0, 0), (100, 0)], None), ("road", [(50, 0), (50, 60)], None)], [50.0, 50.0, 60.0], 1),
    ([("road", [(0, 0), (100, 0)], None), ("road", [(50, -50), (50, 50)], None)], [50.0] * 4, 1),
    ([("road", [(0, 0), (100, 0)], None), ("road", [(50, -2), (50, 50)], None)], [50.0, 50.0, 50.7], 1),
    ([("cartpath", [(0, 0), (100, 0)], "Bridge"), ("road", [(50, -50), (50, 50)], None)], [100.0, 100.0], 2),
    ([("cartpath", [(0, 0), (100, 0)], "Tunnel"), ("road", [(50, -50), (50, 50)], None)], [100.0, 100.0], 2),
    ([("road", [(0, 0), (200, 0)], None), ("cartpath", [(0, 0), (0, 10), (200, 10), (200, 0)], "Path"), ("road", [(1000, 0), (1100, 0)], None)], [100.0, 200.0, 220.0], 2),
]


@pytest.fixture(scope="module")
def many(spark):
    """All cases far apart in one graph; segment 10 * case + i."""
    rows = [(10 * k + i, layer, [[(x, y + 10_000 * k) for x, y in line]], kind) for k, (parts, _, _) in enumerate(CASES) for i, (layer, line, kind) in enumerate(parts)]
    seg = segments(spark, *rows)
    edges, vertices = graph.build_graph(seg)
    return seg, edges, vertices.checkpoint()


def test_graph(many):
    _, edges, vertices = many
    at = edges.join(vertices.select(F.col("vertex").alias("source"), "component"), "source").collect()
    for k, (_, want, components) in enumerate(CASES):
        own = [r for r in at if r["id"] // 10 == k]
        assert sorted(round(r["length_m"], 1) for r in own) == pytest.approx(want, abs=0.06), k
        assert len({r["component"] for r in own}) == components, k
        assert sum(r["part_to"] - r["part_from"] for r in own) == pytest.approx(len({r["id"] for r in own}))


def test_paths_beside_roads_are_preferred(many):
    seg, edges, vertices = many
    y = 70_000.0
    ask = edges.sparkSession.createDataFrame([(1, 0.0, y, 200.0, y), (2, 10.0, y - 5, 10.0, y - 5), (3, 0.0, y, 1050.0, y), (4, 0.0, y + 500, 0.0, y)], "request long, ax double, ay double, bx double, by double")
    got = {r["request"]: (r["reached"], r["length_m"]) for r in routing.legs(ask, edges, 50.0).collect()}
    assert got[1] == ("ok", pytest.approx(220)) and got[2] == ("ok", pytest.approx(0)) and got[3][0] == "island" and got[4][0] == "far"
    found = graph.islands(edges, vertices, seg).collect()
    assert [r["length_m"] for r in found if r["main"]] == [pytest.approx(420)] and len(found) == sum(c for _, _, c in CASES)


def test_finish_tour(spark):
    seg = segments(spark, (1, "road", [[(0, 0), (100, 0)]], "Residential"), (2, "road", [[(100, 0), (100, 20)]], "Residential"), (9, "road", [[(900, 900), (950, 900)]], "Residential"))
    edges, vertices = graph.build_graph(seg)
    left = spark.createDataFrame([(1, 0, 0.0, 1.0), (2, 0, 0.0, 1.0), (9, 0, 0.0, 1.0)], "segment_id long, part int, a double, b double")
    ask = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 5000.0)], "request long, x double, y double")
    picked = spark.createDataFrame([(1, 1), (1, 2), (1, 9), (2, 1)], "request long, segment_id long")
    legs, summary = routing.finish_routes(ask, picked, edges, vertices, left, 50.0)
    assert {r["request"]: (r["state"], r["skipped"]) for r in summary.collect()} == {1: ("ok", 1), 2: ("far", 0)}
    assert sum(r["deadhead"] + r["length_m"] for r in legs.collect()) == pytest.approx(240)


def test_tour_is_near_the_best():
    ends = [(1, 2), (3, 4), (5, 6)]
    place = {0: 0, 1: 10, 2: 20, 3: 30, 4: 40, 5: -10, 6: -20}
    cost = {(a, b): float(abs(x - y)) for a, x in place.items() for b, y in place.items()}
    order = routing._tour(ends, 0, cost)
    at, total = 0, 0.0
    for k, way in order:
        a, b = ends[k] if way else ends[k][::-1]
        total, at = total + cost[at, a] + cost[a, b], b
    assert total + cost[at, 0] == 120


def test_turns_and_cues(spark):
    angles = {0: "straight", 15: "straight", 20: "straight", 30: "slight_right", -30: "slight_left", 90: "right", -90: "left", 150: "sharp_right", 175: "u_turn"}
    got = spark.createDataFrame([(float(a),) for a in angles], "a double").select("a", cues.classify_turn("a").alias("c")).collect()
    assert {r["a"]: r["c"] for r in got} == angles
    at = lambda x, y: (40 + y / 111_195, -84 + x / 85_180)
    line = [at(x, 0) for x in range(0, 101, 10)] + [at(100, y) for y in range(10, 101, 10)]
    pts = spark.createDataFrame([(1, i, *p) for i, p in enumerate(line)], "route long, seq int, lat double, lon double")
    edge = spark.createDataFrame([(1, 2, "road", 100.0), (2, 3, "road", 100.0), (2, 4, "road", 90.0)], "source long, target long, layer string, length_m double")
    place = spark.createDataFrame([(1, *at(0, 0)), (2, *at(100, 0)), (3, *at(100, 100)), (4, *at(190, 0))], "vertex long, lat double, lon double")
    on = spark.createDataFrame([(1, i, 1 if i <= 10 else 2, 2 if i <= 10 else 3, "road") for i in range(len(line))], "route long, seq int, source long, target long, layer string")
    got = cues.course_points(pts, cues.junctions(on), edge, place).collect()
    assert [(r["seq"], r["cue"]) for r in got] == [(10, "left")] and got[0]["cum_m"] == pytest.approx(100, abs=0.5)


def test_projection_of_a_known_place(spark):
    x, y = to_utm(F.lit(-79.387139), F.lit(43.642567), 32617)
    r = spark.range(1).select(x.alias("x"), y.alias("y")).first()
    assert (r["x"], r["y"]) == (pytest.approx(630084.3, abs=0.5), pytest.approx(4833438.6, abs=0.5))


def test_health_and_alerts(spark):
    now = dt.datetime(2024, 5, 10, 12)
    rows = [("a", 1, "ok", now - dt.timedelta(hours=35), None, "fine"), ("b", 2, "ok", now - dt.timedelta(hours=37), None, "fine"), ("c", 3, "failed", now, "boom for url 'http://x'\nmore", None), ("c", 4, "running", None, None, None), ("d", 5, "failed", now - dt.timedelta(hours=2), "x", None), ("d", 6, "ok", now - dt.timedelta(hours=1), None, "fine")]
    jobs = spark.createDataFrame(rows, "source string, id long, status string, finished_at timestamp, error string, summary string")
    got = {r["source"]: (r["state"], r["problem"]) for r in plans.status(jobs, F.lit(now)).collect()}
    assert {k: v[0] for k, v in got.items()} == {"a": "ok", "b": "stale", "c": "failing", "d": "ok"} and got["c"][1] == "c failing: boom"
    none = spark.createDataFrame([], "source string, since timestamp, alerted_at timestamp, recovered_at timestamp, closed_at timestamp")
    state = lambda s: spark.createDataFrame([("a", s)], "source string, state string")
    e, n = health.step_episodes(none, state("failing"), F.lit(now))
    assert [r["notice"] for r in n.collect()] == ["alert"]
    e = health.mark_sent(e, n.select("source", "notice"), F.lit(now))
    assert health.step_episodes(e, state("failing"), F.lit(now))[1].count() == 0
    e2, n2 = health.step_episodes(e, state("ok"), F.lit(now))
    assert [r["notice"] for r in n2.collect()] == ["recovered"] and e2.first()["closed_at"] is None
    assert health.mark_sent(e2, n2, F.lit(now)).first()["closed_at"] is not None


def test_course_file_reads_back(spark):
    raw = exports.fit_course("Näme", [(40.0, -84.0, 0.0), (40.001, -84.0, 111.2)], [(40.0, -84.0, 0.0, "left")], 1_700_000_000, 0.3)
    assert raw[8:12] == b".FIT" and exports.fit_crc(raw) == 0 and struct.unpack("<I", raw[4:8])[0] == len(raw) - 16
    assert exports.fit_crc(b"123456789") == 0xBB3D
    assert read_course(raw) == [(0, 1), (31, 1), (19, 1), (21, 1), (20, 2), (32, 1), (21, 1)]
    assert b"N?me" in raw and b"left" in raw
    own = exports.fit_course("x" * 80, [(40.0, -84.0, 0.0)], [(40.0, -84.0, 0.0, "sharp_left")], 1_700_000_000, 0.3, generic=False)
    assert b"x" * 63 + b"\0" in own and len(own) == len(exports.fit_course("x", [(40.0, -84.0, 0.0)], [(40.0, -84.0, 0.0, "sharp_left")], 1_700_000_000, 0.3))


def read_course(raw):
    """(message, rows) in order, by the format's own definitions."""
    at, end, kinds, found = raw[0], len(raw) - 2, {}, []
    while at < end:
        head = raw[at]
        if head & 0x40:
            number, n = struct.unpack("<HB", raw[at + 3 : at + 6])
            kinds[head & 15] = (number, sum(raw[at + 7 + 3 * i] for i in range(n)))
            found.append([number, 0])
            at += 6 + 3 * n
        else:
            found[-1][1] += 1
            at += 1 + kinds[head][1]
    assert at == end
    return [tuple(x) for x in found]


def test_sources_refuse_bad_bodies(spark):
    page = lambda body: spark.createDataFrame([(body,)], "body string")
    with pytest.raises(Exception, match="the service answered"):
        features.parse_features(page('{"error": {"code": 1}}')).collect()
    stream = lambda body: spark.createDataFrame([(1, body)], "activity long, body string")
    for bad in ('[{"type":"latlng","data":[1],"data2":[1,2]}]', '[{"type":"latlng","data":[91],"data2":[1]}]', '[{"type":"latlng","data":["x"],"data2":[1]}]', '[{"type":"latlng","data":[true],"data2":[1]}]'):
        with pytest.raises(Exception):
            features.parse_fixes(stream(bad)).collect()
    assert features.load_settings("n: {a: 1, z: 2}", "n", {"a"}) == ({"a": 1}, ["unknown setting z"])
    for text, network in (("n: {a: 1}", "m"), ("n: {}", "n")):
        with pytest.raises(ValueError):
            features.load_settings(text, network, {"a"})


def test_pages_are_tried_again():
    import io
    import urllib.error

    waits, answers = [], [urllib.error.HTTPError("u", 503, "x", {}, None), urllib.error.HTTPError("u", 429, "x", {"Retry-After": "7"}, None), io.BytesIO(b"ok")]

    def opener(url):
        a = answers.pop(0)
        if isinstance(a, Exception):
            raise a
        return a

    assert features.fetch("u", opener=opener, sleep=waits.append) == "ok" and waits == [1.0, 7.0]
    answers[:] = [urllib.error.HTTPError("u", 404, "x", {}, None)]
    with pytest.raises(urllib.error.HTTPError):
        features.fetch("u", opener=opener, sleep=waits.append)


def test_cells_find_what_a_full_comparison_finds(spark):
    import random

    rng = random.Random(4)
    pts = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(150)]
    lines = [(i, rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-50, 50), rng.uniform(-50, 50)) for i in range(40)]
    p, q = spark.createDataFrame(pts, "pid int, x double, y double"), spark.createDataFrame(lines, "lid int, x1 double, y1 double, x2 double, y2 double")
    want = p.crossJoin(q).where(g.point_piece_distance("x", "y", "x1", "y1", "x2", "y2") <= 3).select("pid", "lid")
    got = spatial.within(p, q, 3.0).select("pid", "lid").distinct()
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() > 50


def test_exclusions_of_a_copy(spark):
    seg = segments(spark, (1, "cartpath", [[(0, 0), (9, 0)]], "Path", "A")).withColumn("source_key", F.lit("k1"))
    key = spark.createDataFrame([("cartpath", "k2", "A", "closed")], "layer string, key string, name string, reason string")
    dup = spark.createDataFrame([("cartpath", "k2", "k1")], "layer string, dropped_key string, canonical_key string")
    out, warn = clean.apply_exclusions(seg, key, spark.createDataFrame([], "layer string, name string, reason string"), dup)
    assert out.first()["exclusion_reason"] == "closed" and [r["warning"] for r in warn.collect()] == ["duplicate"]


def douglas_peucker(points, tolerance):
    """The rule as it is written in books, for comparison."""
    if len(points) < 3:
        return list(points)
    (ax, ay), (bx, by) = points[0], points[-1]
    dx, dy = bx - ax, by - ay
    square = dx * dx + dy * dy
    off = []
    for x, y in points[1:-1]:
        t = min(1, max(0, ((x - ax) * dx + (y - ay) * dy) / square)) if square else 0
        off.append(math.hypot(x - ax - t * dx, y - ay - t * dy))
    far = max(range(len(off)), key=lambda i: off[i])
    if off[far] <= tolerance:
        return [points[0], points[-1]]
    return douglas_peucker(points[: far + 2], tolerance)[:-1] + douglas_peucker(points[far + 1 :], tolerance)


def test_simplified_lines(spark):
    rng = random.Random(5)
    made = [[(rng.uniform(0, 40), rng.uniform(0, 20)) for _ in range(n)] for n in (0, 1, 2, 3, 5, 30, 200)] + [[(0.0, 0.0), (5.0, 5.0), (0.0, 0.0)], None]
    rows = spark.createDataFrame([(i, m) for i, m in enumerate(made)], "id int, line array<struct<x:double,y:double>>")
    got = {r["id"]: r["s"] for r in rows.select("id", g.simplify(F.col("line"), 3.0).alias("s")).collect()}
    for i, line in enumerate(made):
        assert (None if got[i] is None else [tuple(p) for p in got[i]]) == (None if line is None else douglas_peucker(line, 3.0))
    assert rows.where("id < 0").select(g.simplify(F.col("line"), 3.0).alias("s")).count() == 0


@pytest.mark.parametrize("text", ["paths: []", "roads: 3", "roads: [{name: Elm}]", "roads: [{reason: x}]", "roads: [{object_id: true, reason: x}]", "roads: [{object_id: '7', reason: x}]", "cartpaths: [{reason: x}]", "cartpaths: [{global_id: a, reason: ' '}]", "cartpaths: [{global_id: a, reason: x, note: y}]"])
def test_bad_exclusions_are_refused(text):
    with pytest.raises(ValueError):
        features.load_exclusions(text)


def test_exclusions_may_be_empty():
    assert features.load_exclusions("") == [] and features.load_exclusions("roads:") == []


def test_requests_are_bounded(spark):
    rows = spark.createDataFrame([(1, i, 40.0, -84.0) for i in range(5)] + [(2, 0, 40.0, None), (2, 1, 40.0, 3.0), (3, 0, 40.0, 3.0), (3, 1, 40.0, 181.0), (4, 0, 0.0, 0.0), (4, 1, 0.0, 0.0)], "request int, seq int, lat double, lon double")
    got = {r["request"]: r["problem"] for r in routing.check_requests(rows, most=4).collect()}
    assert got == {1: "more than 4 points", 2: "latitude or longitude out of range", 3: "latitude or longitude out of range", 4: None}


def test_null_rows_and_empty_tables_in_maintenance(spark):
    rows = spark.createDataFrame([(1, None), (2, -1.0), (3, 1.0)], "k int, v double")
    kept, gone = clean.delete(rows, F.col("v") < 0)
    assert {r["k"] for r in kept.collect()} == {1, 3} and [r["k"] for r in gone.collect()] == [2]
    counts = spark.createDataFrame([("a", 3), ("b", 2)], "layer string, n long")
    assert {r["line"] for r in health.change_lines(counts.where("false"), counts, "layer", "n").collect()} == {"a: 0 → 3", "b: 0 → 2"}
    assert health.change_lines(counts, counts, "layer", "n").isEmpty()


def test_entry_points_of_nothing(spark, tmp_path):
    """No segments, no tracks, no requests: empty results, no errors."""
    from pathloom.operators.runindex import RunIndex
    from pathloom.plans import network as plan

    none = segments(spark, (1, "road", [[(0, 0), (100, 0)]])).limit(0).withColumn("length_m", F.lit(0.0))
    one = segments(spark, (1, "road", [[(0, 0), (100, 0)]])).withColumn("length_m", F.lit(100.0))
    points = spark.createDataFrame([], "track long, seq long, x double, y double")
    acts = spark.createDataFrame([], "track long, start_at timestamp")
    assert plan.recompute(none, points, acts).count() == 0
    assert plan.recompute(one, points, acts).where("hit_at is not null").count() == 0
    assert plan.completion(none, plan.recompute(none, points, acts)).first()["road_total"] == 0
    index = RunIndex(spark, f"{tmp_path}/runs", 30.0)
    assert plan.match_changed(plan.make_nodes(one), one, index).where("hit_run is null").count() == plan.make_nodes(one).count()
    edges, vertices = plan.build_graph(none)
    assert edges.count() == vertices.count() == 0
    asked = spark.createDataFrame([(1, 0.0, 0.0, 5.0, 0.0)], "request long, ax double, ay double, bx double, by double")
    assert [r["reached"] for r in plan.route_leg(asked, edges).collect()] == ["far"] and plan.route_leg(asked.limit(0), edges).count() == 0
    left = spark.createDataFrame([], "segment_id long, part int, a double, b double")
    legs, summary = plan.finish_routes(spark.createDataFrame([(1, 0.0, 0.0)], "request long, x double, y double"), spark.createDataFrame([(1, 1)], "request long, segment_id long"), edges, vertices, left, 50.0)
    assert legs.count() == 0 and [r["state"] for r in summary.collect()] == ["far"]
    route = spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 50.0, 0.0)], "route long, seq long, x double, y double")
    parts = spark.createDataFrame([], "id long, part int, part_m double")
    assert [r["new_m"] for r in plan.new_ground(route, edges, parts, left).collect()] == [0.0]
    assert routing.new_ground_lines(route, edges, parts, left).count() == 0
