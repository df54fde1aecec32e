"""Streams give what the batch operators give."""

from __future__ import annotations

import datetime as dt
import random

import pandas as pd
from pyspark.sql import functions as F

from pathloom.operators import tracks
from pathloom.streaming import updates

FIXES = "track long, seq long, x double, y double"


def run(stream, folder):
    stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination(120)


def test_split_is_that_of_whole_tracks(spark, tmp_path):
    rnd, rows = random.Random(6), []
    for track in range(12):
        x = 0.0
        for seq in range(rnd.choice([0, 1, 2, 40])):
            x += rnd.choice([0.0, 0.0, 50.0, 100.0, 100.5, 300.0])
            rows.append((track, seq, x, 1.0))
    rows += [(50, k, 5.0, 5.0) for k in range(9)] + [(51, 0, 0.0, 0.0), (51, 1, 0.0, 0.0), (51, 2, 500.0, 0.0), (51, 3, 500.0, 0.0), (51, 4, 501.0, 0.0)]
    for k in range(4):  # a batch for each quarter of the places in a track
        some = [r for r in rows if min(3, r[1] // 3) == k]
        spark.createDataFrame(some, FIXES).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        run(updates.split_stream(spark.readStream.schema(FIXES).parquet(f"{tmp_path}/in"), 100.0), tmp_path)
    want = sorted(tuple(r) for r in tracks.split_track(spark.createDataFrame(rows, FIXES), 100.0).select("track", "part", "seq", "x").collect())
    got = sorted(tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").select("track", "part", "seq", "x").collect())
    assert got == want and {r[0] for r in got} >= {51} and 50 not in {r[0] for r in got}


class Value:
    def __init__(self):
        self.value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(Value):
    def get(self):
        return iter(self.value)

    def appendList(self, rows):
        self.value = [*(self.value or []), *rows]


class Handle:
    def __init__(self):
        self.timers = []

    def getValueState(self, *_):
        return Value()

    def getListState(self, *_):
        return Rows()

    def registerTimer(self, at):
        self.timers.append(at)

    def listTimers(self):
        return iter(self.timers)

    def deleteTimer(self, at):
        self.timers.remove(at)


def test_an_idle_track_ends_its_part_and_holds_little(spark):
    import pandas as pd

    class Clock:
        def getCurrentProcessingTimeInMs(self):
            return 1000

    made, handle = updates.GapSplitter(100.0, 60_000), Handle()
    made.init(handle)
    frame = lambda rows: iter([pd.DataFrame(rows, columns=["seq", "x", "y"])])
    rows = lambda out: [tuple(r) for f in out for r in f[["part", "seq"]].itertuples(index=False)]
    assert rows(made.handleInputRows((1,), frame([(0, 0.0, 0.0), (1, 0.0, 0.0)]), Clock())) == []
    assert len(made.held.value) == 2 and handle.timers == [61_000]
    for k in range(50):  # many batches: nothing more is held
        assert len(rows(made.handleInputRows((1,), frame([(2 + k, 10.0 * (k + 1), 0.0)]), Clock()))) == (3 if k == 0 else 1)
        assert not made.held.value and len(handle.timers) == 1
    assert list(made.handleExpiredTimer((1,), Clock(), None)) == []
    assert made.last.get() == (None, None, 1, False, False)
    assert rows(made.handleInputRows((1,), frame([(60, 510.0, 0.0), (61, 511.0, 0.0)]), Clock())) == [(1, 60), (1, 61)]


def test_late_runs_replace_later_hits_and_write_one_bucket(spark, tmp_path):
    keys = ["segment_id", "part", "seq"]
    none = F.lit(None)
    table = updates.HitTable(spark, f"{tmp_path}/hits", keys, buckets=8, compact_after=3)
    nodes = spark.range(40).select(F.col("id").alias("segment_id"), F.lit(0).alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(2).cast("long"))).alias("seq"), (F.col("id") * 1.5).alias("x"))
    table.create(nodes.withColumn("hit_at", none.cast("timestamp")).withColumn("hit_run", none.cast("long")))
    schema = "segment_id long, part int, seq long, hit_at timestamp, hit_run long"
    batches = [[(1, 0, 0, dt.datetime(2024, 6, 1), 6)], [(1, 0, 0, dt.datetime(2024, 5, 1), 5), (1, 0, 1, dt.datetime(2024, 5, 1), 5), (1, 0, 2, None, None)], [(1, 0, 0, dt.datetime(2024, 7, 1), 7), (9, 0, 0, dt.datetime(2024, 7, 1), 7)], [(9, 0, 1, dt.datetime(2024, 8, 1), 8), (9, 0, 0, dt.datetime(2024, 7, 1), 3)]]
    written = []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        updates.follow(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), table.merge, f"{tmp_path}/c").awaitTermination(120)
        written.append((table._whole("hits"), table._whole("base")))
    hit = lambda df: {(r["segment_id"], r["seq"]): r["hit_run"] for r in df.where("hit_run is not null").collect()}
    want = {(1, 0): 5, (1, 1): 5, (9, 0): 3, (9, 1): 8}
    assert hit(table.read()) == want and table.read().count() == 120 and "x" in table.read().columns
    assert written[0] == ([1], [0]) and written[2][1] == [0, 3]
    one, two = (len([n for n in table._names(f"{tmp_path}/hits/hits/version={v}") if n.startswith("bucket=")]) for v in (1, 3))
    assert one == 1 and two <= 2  # a batch of one hit writes one bucket
    assert len([n for n in table._names(f"{tmp_path}/hits/base/version=3") if n.startswith("bucket=")]) <= 2
    assert hit(table.read([9])) == {k: v for k, v in want.items() if k[0] == 9} and table.read([9]).count() == 3
    table.merge(spark.createDataFrame([(1, 0, 0, dt.datetime(2020, 1, 1), 1)], schema), 2)  # a batch that comes again
    assert hit(table.read()) == want
    table.compact()
    table.compact()
    assert hit(table.read()) == want and table.version() == 4
    table.merge(spark.createDataFrame([(30, 0, 0, dt.datetime(2020, 1, 1), 1)], schema), 4)
    table.compact()
    assert hit(table.read()) == {**want, (30, 0): 1} and table.read().count() == 120


def test_a_track_takes_two_trips_to_the_store():
    """A batch of a track reads and writes its state once; what is held is asked for only where something is."""

    class State:
        def __init__(self):
            self.value, self.calls = None, 0

        def get(self):
            self.calls += 1
            return self.value

        def exists(self):
            self.calls += 1
            return self.value is not None

        def update(self, value):
            self.calls, self.value = self.calls + 1, value

        def appendList(self, rows):
            self.calls, self.value = self.calls + 1, [*(self.value or ()), *rows]

        def clear(self):
            self.calls, self.value = self.calls + 1, None

    split = updates.GapSplitter(40.0, None)
    split.last, split.held = State(), State()
    batches = [[(1, 0.0), (2, 0.0)], [(3, 0.0)], [(4, 10.0)], [(6, 30.0), (5, 20.0)], [(7, 90.0)], [(8, 200.0), (9, 210.0)]]
    got, calls = [], []
    for rows in batches:
        before = split.last.calls + split.held.calls
        frame = pd.DataFrame({"seq": [r[0] for r in rows], "x": [r[1] for r in rows], "y": 0.0})
        for out in split.handleInputRows((5,), iter([frame]), None):
            got += list(out.itertuples(index=False, name=None))
        calls.append(split.last.calls + split.held.calls - before)
    assert [(r[0], r[1], r[2]) for r in got] == [(5, 0, k) for k in range(1, 7)] + [(5, 1, 8), (5, 1, 9)]
    assert calls[3] == 2 and max(calls) <= 4, calls
