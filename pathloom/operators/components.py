"""Connected components by alternating large-star and small-star rounds."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.operators.skew import join_by_key

#: Links beyond which a vertex is a hub.
HUB = 100_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or the context's own where that is not set.

    In local mode a new one is made if there is neither; on a cluster, whose machines share no folder by themselves,
    RuntimeError.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        if not context.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context._jsc.sc().getCheckpointDir().get().rstrip("/")


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return tuple(row)


def contracted(edges: DataFrame) -> DataFrame:
    """``(u, v)``, u > v, with the components of ``edges (u, v)``: in each partition every vertex is linked to the smallest
    that its links there lead to."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent: dict = {}

        def root(x):
            while (up := parent.setdefault(x, x)) != x:
                parent[x] = x = parent[up]
            return x

        for frame in frames:
            for u, v in zip(frame["u"].tolist(), frame["v"].tolist()):
                a, b = root(u), root(v)
                if a != b:
                    parent[max(a, b)] = min(a, b)
        rows = [(x, root(x)) for x in list(parent)]
        kept = [(x, r) for x, r in rows if x != r]
        for at in range(0, len(kept), 10_000):
            yield pd.DataFrame(kept[at : at + 10_000], columns=["u", "v"])

    return edges.mapInPandas(run, edges.schema)


def connected_components(links: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60, hub: int | None = None) -> DataFrame:
    """``(vertex, component)`` for every vertex that a link of ``links`` names; the component is its smallest vertex.

    Links are undirected; repeated links and self links are allowed, links with a null end are ignored, no links give
    no rows. Each round lets every vertex hand its neighbours the smallest vertex it knows: first the larger
    neighbours, then the smaller ones. The links stay as many as before or fewer, so a round is two shuffles of the
    links; rounds are logarithmic in the size of a component. Lineage is cut by ``checkpoint()`` in each round.

    With ``hub``, links are first contracted inside their partitions, to as many as there are vertices in each at most, and
    a vertex of more than ``hub`` links is never one task's: its smallest vertex is broadcast to where its links are.
    """
    spark = links.sparkSession
    shared_folder(spark)
    kind = links.schema[src].dataType
    links = links.select(src, dst).checkpoint()  # it is read twice
    vertices = links.select(F.explode(F.array(src, dst)).alias("vertex")).where("vertex is not null").distinct()
    edges = (
        links.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    edges = (contracted(edges) if hub else edges).checkpoint()
    before = None
    counted = [F.count("*").alias("n")] if hub else []
    meet = lambda rows, least: join_by_key(rows, least.checkpoint(), ["u"], hub) if hub else rows.join(least, "u")
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), *counted)
        large = meet(both.where("v > u"), least).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = large.checkpoint() if hub else large
        least = large.groupBy("u").agg(F.min("v").alias("m"), *counted)
        small = meet(large, least).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.where("u != v").unionByName(least.select("u", F.col("m").alias("v")))
        edges = small.distinct().checkpoint()
        now = _state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = edges.groupBy(F.col("u").alias("vertex")).agg(F.min("v").alias("component"))
    return vertices.join(found, "vertex", "left").select("vertex", F.coalesce("component", "vertex").cast(kind).alias("component"))
