"""Tables whose schema changes, collections over many files, nearest things without a reach."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from pathloom.operators import spatial
from pathloom.sources import courses, exports
from pathloom.sources.migrations import Step, VersionedTable, WrongSteps

ONE = Step(1, "miles", lambda df: df.withColumn("miles", F.col("m") / 1609.344))
TWO = Step(2, "network", lambda df: df.withColumn("network_id", F.lit(1).cast("long")).drop("m"))


def test_old_parts_are_lifted(spark, tmp_path):
    folder = str(tmp_path / "t")
    old = VersionedTable(spark, folder, [])
    old.append(spark.createDataFrame([(1, 1609.344)], "id long, m double"))
    assert old.read().columns == ["id", "m"] and old.version() == 0
    mid = VersionedTable(spark, folder, [ONE])
    assert mid.migrate() == [1] and mid.migrate() == []
    mid.append(spark.createDataFrame([(2, 0.0, 5.0)], "id long, m double, miles double"))
    new = VersionedTable(spark, folder, [TWO, ONE])
    assert new.read().columns == ["id", "m", "miles"]  # not applied yet
    assert new.migrate() == [2] and new.migrate() == [] and VersionedTable(spark, folder, [ONE, TWO]).migrate() == []
    new.append(spark.createDataFrame([(3, 7.0, 2)], "id long, miles double, network_id long"))
    assert sorted(map(tuple, new.read().select("id", "miles", "network_id").collect())) == [(1, 1.0, 1), (2, 5.0, 1), (3, 7.0, 2)]
    for steps in ([ONE], [Step(1, "other", ONE.lift), TWO]):
        with pytest.raises(WrongSteps):
            VersionedTable(spark, folder, steps).read()
    with pytest.raises(WrongSteps):
        VersionedTable(spark, folder, [TWO])


def test_a_collection_over_many_files(spark, tmp_path):
    rows = [(k, [[(float(k), 1.0), (2.0, 3.0)]], f'n"{k}') for k in range(200)]
    df = spark.createDataFrame(rows, "id long, geom array<array<struct<x:double,y:double>>>, name string").repartition(5)
    made = exports.geojson_features(df, "geom", ["id", "name"]).withColumn("id", F.get_json_object("feature", "$.properties.id").cast("long"))
    for n, some in ((200, made), (1, made.where("id = 7")), (0, made.where("id < 0"))):
        folder = tmp_path / str(n)
        exports.write_collection(some, str(folder), ["id"])
        files = sorted(folder.glob("*/part-*"))
        whole = json.loads("".join(f.read_text() for f in files))
        assert len(whole["features"]) == n and [f["properties"]["id"] for f in whole["features"]] == sorted(f["properties"]["id"] for f in whole["features"])
        assert n < 200 or len(files) > 5


@pytest.mark.parametrize("start", [None, 0.5])
def test_nearest_k_on_clustered_points(spark, start):
    rnd = random.Random(5)
    spot = lambda c, r: (c + rnd.uniform(-r, r), c + rnd.uniform(-r, r))
    points = [(i, *spot(rnd.choice([0, 1000, 90_000]), 5)) for i in range(40)]
    ends = [(k % 25, spot(rnd.choice([0, 0, 0, 1003]), 4), spot(0, 1)) for k in range(60)]
    pieces = [(i, *a, a[0] + b[0], a[1] + b[1]) for i, a, b in ends] + [(30, 1.0, 1.0, 1.0, 1.0), (31, 1.0, 1.0, 1.0, 1.0)]
    p, q = spark.createDataFrame(points, "p long, x double, y double"), spark.createDataFrame(pieces, "id long, x1 double, y1 double, x2 double, y2 double")
    got = {}
    for r in spatial.nearest_k(p, q, ["p"], ["id"], ["id"], 4, start).collect():
        got.setdefault(r["p"], {})[r["rank"]] = (r["id"], r["dist"])
    for i, x, y in points:
        best = {}
        for k, x1, y1, x2, y2 in pieces:
            dx, dy = x2 - x1, y2 - y1
            t = 0 if dx == dy == 0 else max(0, min(1, ((x - x1) * dx + (y - y1) * dy) / (dx * dx + dy * dy)))
            best[k] = min(best.get(k, 1e99), ((x1 + dx * t - x) ** 2 + (y1 + dy * t - y) ** 2) ** 0.5)
        want = sorted(best.items(), key=lambda z: (z[1], z[0]))[:4]
        assert [got[i][r][0] for r in (1, 2, 3, 4)] == [k for k, _ in want]
        assert [got[i][r][1] for r in (1, 2, 3, 4)] == pytest.approx([d for _, d in want])
    few = spatial.nearest_k(p.limit(3), q.where("id < 2"), ["p"], ["id"], ["id"], 4, start).groupBy("p").count().collect()
    assert [r["count"] for r in few] == [2, 2, 2]
    assert spatial.nearest_k(p, q.limit(0), ["p"], ["id"], ["id"], 4).count() == 0


def test_course_files_read_back(spark):
    raw = exports.fit_course("Näme", [(40.0, -84.0, 0.0), (40.001, -84.5, 111.2)], [(40.0, -84.0, 0.0, "sharp_left")], 1_700_000_000, 0.3, generic=False)
    df = spark.createDataFrame([(1, bytearray(raw)), (2, None)], "route long, fit binary")
    rows = courses.read_courses(df).orderBy("place").collect()
    assert {r["route"] for r in rows} == {1} and [r["message"] for r in rows] == [0, 31, 19, 21, 20, 20, 32, 21]
    points = [r for r in rows if r["message"] == 20]
    assert [(round(r["lat"], 6), round(r["lon"], 6), r["metres"], r["time_s"]) for r in points] == [(40.0, -84.0, 0.0, 1_700_000_000), (40.001, -84.5, 111.2, 1_700_000_033)]
    cue = next(r for r in rows if r["message"] == 32)
    assert (cue["kind"], cue["text"]) == (20, "sharp_left") and rows[1]["text"] == "N?me"
    for bad in (raw[:-1], raw[:40] + bytes([raw[40] ^ 1]) + raw[41:], b"x" * 40, b""):
        with pytest.raises(ValueError):
            list(courses.messages(bad))
