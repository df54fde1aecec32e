"""Tracks as streams: fixes split by distance, activities taken once, hits kept earliest, episodes followed.

Late runs replace later hits however late they come, so no watermark is set on them; state is a table of buckets, to which
each micro-batch adds what it found.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from pathloom.operators.matching import merge_hits

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "track {track}, part int, seq long, x double, y double"


class GapSplitter(StatefulProcessor):
    """State of a track: its last fix, how many parts it has given out, whether the open part has length; and the rows of
    the open part while it has none, which are given out when it gets some and dropped if it ends before."""

    def __init__(self, gap: float, idle_ms: int | None):
        self.gap, self.idle_ms = gap, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "x double, y double, parts int, there boolean, long boolean")
        self.held = handle.getListState("held", "seq long, x double, y double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        x, y, parts, there, long = self.last.get() or (None, None, 0, False, False)
        frames = list(rows)
        batch = frames[0] if len(frames) == 1 else pd.concat(frames)
        seqs, xs, ys = (batch[n].to_numpy() for n in ("seq", "x", "y"))
        order = seqs.argsort(kind="stable")
        held, waits = [], there and not long  # an open part without length is held; each call to the state is a trip to the store
        out = {"part": [], "seq": [], "x": [], "y": []}

        def give(seq, px, py):
            for name, value in zip(("part", "seq", "x", "y"), (parts - 1, seq, px, py)):
                out[name].append(value)

        for seq, px, py in zip(seqs[order].tolist(), xs[order].tolist(), ys[order].tolist()):
            step = ((px - x) ** 2 + (py - y) ** 2) ** 0.5 if there else None
            if step is not None and step > self.gap:
                held, long = [], False  # what was held is a part without length
                if waits:
                    self.held.clear()
                    waits = False
            elif step and not long:
                parts, long = parts + 1, True
                for row in [*(self.held.get() if waits else ()), *held]:
                    give(*row)
                held = []
                if waits:
                    self.held.clear()
                    waits = False
            if long:
                give(seq, px, py)
            else:
                held.append((seq, px, py))
            x, y, there = px, py, True
        if held:
            self.held.appendList(held)
        self.last.update((x, y, parts, there, long))
        if self.idle_ms is not None:
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield pd.DataFrame({"track": [key[0]] * len(out["seq"]), **out})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        """The track's open part ends here: what comes later begins another. Only its number stays."""
        if self.last.exists():
            self.last.update((None, None, self.last.get()[2], False, False))
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def split_stream(fixes: DataFrame, gap: float, idle_ms: int | None = None) -> DataFrame:
    """``(track, part, seq, x, y)`` of a stream of fixes ``(track, seq, x, y)`` that arrives in order of ``seq`` within a track.

    A new part begins where consecutive fixes are more than ``gap`` apart; parts without length give no rows, and the others
    are numbered from 0: over the whole stream the rows are those of :func:`tracks.split_track`. A part's rows are given out
    as soon as it has length. With ``idle_ms`` a track that gets no fix for so long has its open part ended. A micro-batch's
    fixes of one track are sorted in memory, so the source's trigger bounds them; what is kept of a track is a fix, and the
    fixes at one place that a part begins with. The state is in RocksDB, which the session must name as its state
    store; it is set here where Spark's own default is in place.
    """
    conf = fixes.sparkSession.conf
    if "RocksDB" not in conf.get("spark.sql.streaming.stateStore.providerClass"):
        conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    kind = dict(fixes.dtypes)["track"]
    rows = fixes.select("track", F.col("seq").cast("long").alias("seq"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    return rows.groupBy("track").transformWithStateInPandas(GapSplitter(gap, idle_ms), OUT.format(track=kind), "append", "none" if idle_ms is None else "processingTime")


def once(activities: DataFrame, key: str = "id") -> DataFrame:
    """Each activity once, though listings overlap and are read again."""
    return activities.dropDuplicates([key])


class HitTable:
    """Nodes with their earliest hits, in buckets of their first key, merged when they are read.

    ``merge`` is for ``foreachBatch``: it adds a batch's best hits as a small table of their own, in the buckets that they
    fall in. Readers take the earliest of the base and all batches since; ``compact`` merges the buckets that have any
    into new bases, and writes no other bucket. Batch n is version n + 1, so a batch that comes again finds its version
    there and changes nothing. A version counts when it is whole.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], buckets: int = 64, compact_after: int = 16):
        self.spark, self.folder, self.keys, self.buckets, self.compact_after = spark, folder, keys, buckets, compact_after
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.fs = self.path(folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.keys[0]).cast("string")), F.lit(self.buckets)).cast("int"))

    def _names(self, folder: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.path(folder))) if self.fs.exists(self.path(folder)) else []

    def _whole(self, kind: str) -> list[int]:
        names = [n for n in self._names(f"{self.folder}/{kind}") if n.startswith("version=")]
        return sorted(int(n[8:]) for n in names if self.fs.exists(self.path(f"{self.folder}/{kind}/{n}/_SUCCESS")))

    def create(self, nodes: DataFrame) -> None:
        self._with_bucket(nodes).repartition("bucket").write.partitionBy("bucket").parquet(f"{self.folder}/base/version=0")

    def _bases(self) -> dict[int, int]:
        """Each bucket's base: its newest whole version. Later batches are still to be merged."""
        found = {}
        for v in self._whole("base"):
            for n in self._names(f"{self.folder}/base/version={v}"):
                if n.startswith("bucket="):
                    found[int(n[7:])] = v
        return found

    def version(self) -> int:
        return max([*self._whole("base"), *self._whole("hits")])

    def read(self, only: list | None = None) -> DataFrame:
        """All nodes, or those whose first key is one of ``only``, whose buckets alone are read."""
        bases = self._bases()
        wanted = set(bases)
        if only is not None:
            named = self.spark.createDataFrame([(x,) for x in only], f"{self.keys[0]} {self._key_type()}")
            wanted &= {r["bucket"] for r in self._with_bucket(named).select("bucket").distinct().collect()}
        rows = None
        for v in sorted({bases[b] for b in wanted} or set(bases.values())):
            one = self.spark.read.option("basePath", f"{self.folder}/base/version={v}").parquet(f"{self.folder}/base/version={v}")
            one = one.where(F.col("bucket").isin([b for b in wanted if bases[b] == v]))
            rows = one if rows is None else rows.unionByName(one)
        late = self._since(bases, wanted)
        rows = merge_hits(rows, late, self.keys) if late is not None else rows
        return (rows if only is None else rows.where(F.col(self.keys[0]).isin(only))).drop("bucket")

    def _key_type(self) -> str:
        newest = self._whole("base")[-1]
        return dict(self.spark.read.parquet(f"{self.folder}/base/version={newest}").dtypes)[self.keys[0]]

    def _since(self, bases: dict[int, int], wanted: set[int]) -> DataFrame | None:
        """The earliest hit of each node in batches that its bucket's base does not hold yet."""
        late = None
        for v in self._whole("hits"):
            here = [b for n in self._names(f"{self.folder}/hits/version={v}") if n.startswith("bucket=") and (b := int(n[7:])) in wanted and bases[b] < v]
            if here:
                one = self.spark.read.option("basePath", f"{self.folder}/hits/version={v}").parquet(*[f"{self.folder}/hits/version={v}/bucket={b}" for b in here])
                late = one if late is None else late.unionByName(one)
        return None if late is None else self._best(late)

    def _best(self, hits: DataFrame) -> DataFrame:
        return hits.groupBy(*self.keys).agg(F.min(F.struct("hit_at", "hit_run")).alias("h")).select(*self.keys, "h.*")

    def merge(self, hits: DataFrame, batch: int) -> None:
        """Add a batch's hits; nothing of the nodes is rewritten but, every ``compact_after`` batches, the buckets that have any."""
        if batch + 1 in self._whole("hits") or batch + 1 <= max(self._whole("base")):
            return
        self._with_bucket(self._best(hits.where("hit_at is not null"))).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/hits/version={batch + 1}")
        if (batch + 1) % self.compact_after == 0:
            self.compact()

    def compact(self) -> None:
        """Merge the buckets that have batches into new bases; what they replace is deleted at the next compaction, as readers may still hold it."""
        bases, version = self._bases(), self.version()
        if version in self._whole("base"):
            return
        for kind in ("base", "hits"):  # of the compaction before this one
            for v in self._whole(kind):
                old = [b for n in self._names(f"{self.folder}/{kind}/version={v}") if n.startswith("bucket=") and (v < bases[b := int(n[7:])] or kind == "hits" and v == bases[b])]
                for b in old:
                    self.fs.delete(self.path(f"{self.folder}/{kind}/version={v}/bucket={b}"), True)
        touched = {int(n[7:]) for v in self._whole("hits") for n in self._names(f"{self.folder}/hits/version={v}") if n.startswith("bucket=") and bases[int(n[7:])] < v}
        rows = None
        for v in sorted({bases[b] for b in touched}):
            one = self.spark.read.option("basePath", f"{self.folder}/base/version={v}").parquet(f"{self.folder}/base/version={v}").where(F.col("bucket").isin([b for b in touched if bases[b] == v]))
            rows = one if rows is None else rows.unionByName(one)
        if rows is not None:
            merge_hits(rows, self._since(bases, touched), self.keys).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/base/version={version}")


def follow(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str):
    """Run what has arrived through ``each`` in micro-batches, then stop."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
