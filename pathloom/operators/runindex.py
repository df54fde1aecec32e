"""Stored runs by place, so that new nodes meet only the runs that pass near them.

The index is a table partitioned by square block: each straight piece of a run is in every block that holds a point
within ``reach`` of it. It is written once for each batch of runs, as a part of its own that counts when it is whole,
and read by the blocks of the nodes in question: Spark lists and reads those folders only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.spatial import piece_cells

#: Blocks that a read names; a read of more takes all of them and joins by block.
MAX_BLOCKS = 5_000
COLUMNS = "run {run}, start_at timestamp, x1 double, y1 double, x2 double, y2 double"


def _fs(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path, path(folder).getFileSystem(spark._jsc.hadoopConfiguration())


class RunIndex:
    """Straight pieces of runs ``(run, start_at, x1, y1, x2, y2)``, each run in one batch.

    ``reach`` is the farthest that a node may be from a run that hits it, ``size`` the side of a block in metres.
    """

    def __init__(self, spark: SparkSession, folder: str, reach: float, size: float = 2048.0, run_type: str = "long"):
        self.spark, self.folder, self.reach, self.size = spark, folder, float(reach), float(size)
        self.schema = f"{COLUMNS.format(run=run_type)}, block string"

    def append(self, runs: DataFrame, batch: str) -> None:
        """Add a batch of runs; one of the same name that is whole already stays as it is, one that is not is written again."""
        path, fs = _fs(self.spark, self.folder)
        part = f"{self.folder}/batch={batch}"
        if fs.exists(path(f"{part}/_SUCCESS")):
            return
        cells = piece_cells(runs.select("run", "start_at", "x1", "y1", "x2", "y2"), self.reach, self.size)
        placed = cells.select("run", "start_at", "x1", "y1", "x2", "y2", F.concat_ws("_", "cx", "cy").alias("block")).distinct()
        placed.hint("rebalance", "block").write.mode("overwrite").partitionBy("block").parquet(part)  # a block of most runs is split

    def batches(self) -> list[str]:
        path, fs = _fs(self.spark, self.folder)
        names = [x.getPath().getName() for x in fs.listStatus(path(self.folder))] if fs.exists(path(self.folder)) else []
        return sorted(f"{self.folder}/{n}" for n in names if n.startswith("batch=") and fs.exists(path(f"{self.folder}/{n}/_SUCCESS")))

    def blocks_of(self, points: DataFrame) -> DataFrame:
        """``(block)``: each block that a point ``(x, y)`` lies in, once."""
        cell = lambda v: F.floor(F.col(v) / self.size)
        return points.select(F.concat_ws("_", cell("x"), cell("y")).alias("block")).distinct()

    def near(self, points: DataFrame) -> DataFrame:
        """The pieces of all runs that may be within ``reach`` of a point of ``points``; one may come more than once."""
        whole = self.batches()
        if not whole:
            return self.spark.createDataFrame([], self.schema).drop("block")
        table = None
        for part in whole:
            one = self.spark.read.schema(self.schema).option("basePath", part).parquet(part)
            table = one if table is None else table.unionByName(one)
        blocks = self.blocks_of(points)
        named = [r["block"] for r in blocks.limit(MAX_BLOCKS + 1).collect()]  # names of places, not rows
        kept = table.where(F.col("block").isin(named)) if len(named) <= MAX_BLOCKS else table.join(blocks, "block", "left_semi")
        return kept.drop("block")
